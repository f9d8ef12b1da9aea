"""Pipeline metrics and alert rules as table operators.

Samples are a long table (metric, ts, value).  Latest values come from a
partially aggregated max over (ts, value) -- never a sort of all samples --
and rules are a small table joined by metric name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import SILVER_RULES

RULE_SCHEMA = T.StructType([
    T.StructField("rule", T.StringType()), T.StructField("metric", T.StringType()),
    T.StructField("less_than", T.DoubleType()), T.StructField("lookback_seconds", T.IntegerType()),
    T.StructField("no_data_alerts", T.BooleanType()), T.StructField("severity", T.StringType()),
    T.StructField("service", T.StringType()), T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
])

# ---------------------------------------------------------------------------
# Three availability rules (metric < 1 within the last 60 s; no
# data also alerts) with their severity and service labels.  The last rule's
# service and job labels differ from the original deployment's names.
DEFAULT_RULES = [
    ("database down", "healthcare_postgres_up", 1.0, 60, True, "critical", "postgresql-rds", None),
    ("warehouse down", "healthcare_databricks_up", 1.0, 60, True, "warning", "databricks", None),
    ("application down", "up", 1.0, 60, True, "critical", "application", {"job": "application"}),
]
# Metric names of the snapshot.
TOTAL_METRICS = {"patients": "healthcare_simulator_patients_total",
                 "appointments": "healthcare_simulator_appointments_total",
                 "transactions": "healthcare_simulator_transactions_total"}
PASS_RATE_METRIC = "healthcare_simulator_silver_integrity_percentage"
# Quality gauge colour steps: below 70 red, 70 to below 90 orange, 90 and up green.
QUALITY_STEPS = [(None, "red"), (70.0, "orange"), (90.0, "green")]
# ---------------------------------------------------------------------------


def rules_frame(spark: SparkSession, rules=None) -> DataFrame:
    """The rules as a table; a rule without labels applies to every sample."""
    rows = [tuple(r) + (None,) * (len(RULE_SCHEMA) - len(r)) for r in (DEFAULT_RULES if rules is None else rules)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def metrics_snapshot(frames: dict[str, DataFrame]) -> DataFrame:
    """Long table (metric, kind, value): patient / appointment / transaction
    totals (counters) and the Silver pass rate over the tables with Silver
    rules (gauge)."""
    # one pass over each table: its rows and, with a Silver rule, the rows that pass
    parts = [frames[t].agg(F.count(F.lit(1)).alias("n"), (F.count_if(SILVER_RULES[t]()) if t in SILVER_RULES
                                                          else F.lit(None)).cast("bigint").alias("s"))
             .withColumn("t", F.lit(t)) for t in TOTAL_METRICS]
    ruled = F.when(F.col("s").isNotNull(), F.col("n"))
    folded = reduce(DataFrame.unionByName, parts).agg(
        *[F.max(F.when(F.col("t") == t, F.col("n"))).cast("double").alias(t) for t in TOTAL_METRICS],
        F.when(F.sum(ruled) > 0, F.sum("s") * 100.0 / F.sum(ruled)).otherwise(F.lit(100.0)).cast("double").alias("rate"))
    rows = [(m, "counter", F.col(t)) for t, m in TOTAL_METRICS.items()] + [(PASS_RATE_METRIC, "gauge", F.col("rate"))]
    return folded.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(k).alias("kind"), v.alias("value"))
                                             for m, k, v in rows])).alias("x")).select("x.*")


def metric_last_value(samples: DataFrame) -> DataFrame:
    """Last non-null sample per metric (latest ts; ties by the larger value)."""
    s = samples.where(F.col("value").isNotNull())
    best = F.max(F.struct("ts", "value")).alias("_b")
    return s.groupBy("metric").agg(best).select("metric", F.col("_b.ts").alias("ts"),
                                                F.col("_b.value").alias("value"))


def metric_series(samples: DataFrame, metric: str, since=None, until=None) -> DataFrame:
    """One metric's samples in time order within a look-back window."""
    s = samples.where(F.col("metric") == metric)
    if since is not None:
        s = s.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    if until is not None:
        s = s.where(F.col("ts") <= F.lit(until).cast("timestamp"))
    return s.select("ts", "value").orderBy("ts", "value")


#: Grid points that one task fills; a metric's points are dealt out by time.
GRID_CHUNK = 4096


def metric_grid(samples: DataFrame, since, until, step: int, carry: int | None = None, metrics=None) -> DataFrame:
    """Every metric on a time grid: metric, ts (``since``, then every ``step`` seconds
    up to ``until``), value and age (seconds since the sample).  A point shows the last
    non-null sample at or before it (of equal times the greatest value), carried
    forward for at most ``carry`` seconds (none: without end) and only from samples
    in [``since``, ``until``]; value and age are null where there is none.

    Samples are first reduced to one per metric and step (summed up before the
    shuffle); the grid is then filled in chunks of time: what a chunk inherits is the
    last value of the chunks before it, one row each, so that a metric with very many
    points is no hot key."""
    a, b = F.unix_micros(F.lit(since).cast("timestamp")), F.unix_micros(F.lit(until).cast("timestamp"))
    width = F.lit(step * 1_000_000)
    at = F.unix_micros("ts")
    s = samples.where(F.col("value").isNotNull() & (at >= a) & (at <= b))
    if metrics is not None:
        s = s.where(F.col("metric").isin(list(metrics)))
    # the point at which a sample is first seen
    point = F.ceil((at - a) / width).cast("bigint")
    last = s.groupBy("metric", point.alias("point")).agg(F.max(F.struct(at.alias("us"), F.col("value").alias("value"))).alias("own"))
    names = last.select("metric").distinct()  # from the reduced samples: they are read once
    chunks = names.select("metric", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((b - a) / width / GRID_CHUNK))).alias("chunk"))
    grid = chunks.select("metric", "chunk", F.explode(F.sequence(F.col("chunk") * GRID_CHUNK, F.least(
        F.col("chunk") * GRID_CHUNK + GRID_CHUNK - 1, F.floor((b - a) / width)))).alias("point"))
    last = last.withColumn("chunk", F.floor(F.col("point") / GRID_CHUNK))
    ends = last.groupBy("metric", "chunk").agg(F.max_by("own", "point").alias("end"))
    before = Window.partitionBy("metric").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    inherited = chunks.join(ends, ["metric", "chunk"], "left").select(
        "metric", "chunk", F.last("end", ignorenulls=True).over(before).alias("inherited"))
    inside = Window.partitionBy("metric", "chunk").orderBy("point").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(last, ["metric", "chunk", "point"], "left").join(inherited, ["metric", "chunk"]).withColumn(
        "seen", F.coalesce(F.last("own", ignorenulls=True).over(inside), F.col("inherited")))
    now = a + F.col("point") * width
    fresh = F.col("seen").isNotNull() & ((now - F.col("seen.us") <= carry * 1_000_000) if carry is not None else F.lit(True))
    return filled.select("metric", F.timestamp_micros(now).alias("ts"), F.when(fresh, F.col("seen.value")).alias("value"),
                         F.when(fresh, (now - F.col("seen.us")) / 1_000_000).alias("age"))


def threshold_alerts(samples: DataFrame, rules: DataFrame, now) -> DataFrame:
    """Per rule: the latest value of its metric within [now - lookback, now] among
    the samples that carry the rule's labels (samples may have a ``labels`` map; a
    rule without labels takes every sample); state Alerting when that value is
    below the limit, or when there is no sample and no-data alerts are on; NoData /
    Normal otherwise.  Samples may have a text ``error``: the metric could not be read
    then, and a rule whose latest row is such a one is Alerting too (without a value).
    The joins carry no hint: the planner sees both sizes."""
    now_c = F.lit(now).cast("timestamp")
    max_look = rules.agg(F.max("lookback_seconds")).scalar()
    own = F.col("labels") if "labels" in samples.columns else F.lit(None).cast("map<string,string>")
    s = samples.withColumn("_error", read_error(samples)).where(
        (F.col("value").isNotNull() | F.col("_error")) & (F.col("ts") <= now_c)
        & (F.col("ts") >= now_c - F.make_dt_interval(secs=max_look))).select(
        "metric", "ts", F.when(~F.col("_error"), F.col("value")).alias("value"), "_error", own.alias("_own"))
    wanted = rules.select("rule", "metric", "lookback_seconds", F.col("labels").alias("_wanted"))
    match = F.col("_wanted").isNull() | F.forall(F.map_entries("_wanted"), lambda e: F.coalesce(
        F.try_element_at(F.col("_own"), e["key"]) == e["value"], F.lit(False)))
    j = s.join(wanted, "metric").where(
        match & (F.col("ts") >= now_c - F.make_dt_interval(secs=F.col("lookback_seconds"))))
    # of equal times an error counts, else the greatest value
    latest = j.groupBy("rule").agg(F.max(F.struct("ts", "_error", "value")).alias("_b"))
    out = rules.join(latest, "rule", "left").select(
        "rule", "metric", F.col("_b.ts").alias("ts"), F.col("_b.value").alias("value"),
        "less_than", "severity", "service", "no_data_alerts", F.col("_b._error").alias("_error"))
    state = (F.when(F.col("ts").isNull(),
                    F.when(F.col("no_data_alerts"), F.lit("Alerting")).otherwise(F.lit("NoData")))
             .when(F.col("_error") | (F.col("value") < F.col("less_than")), F.lit("Alerting")).otherwise(F.lit("Normal")))
    return out.withColumn("state", state).drop("no_data_alerts", "_error")


def read_error(samples: DataFrame) -> Column:
    """Whether a row tells of an error instead of a value (column ``error``, if any)."""
    return F.col("error").isNotNull() if "error" in samples.columns else F.lit(False)


def threshold_band(col, steps=QUALITY_STEPS) -> Column:
    """Colour band of a value: the last step whose lower bound the value reaches."""
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for bound, label in reversed(steps):
        cond = F.lit(True) if bound is None else c >= F.lit(bound)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def status_text(col) -> Column:
    """1 -> UP, 0 -> DOWN."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c >= 1, F.lit("UP")).otherwise(F.lit("DOWN"))


def overall_health(db_up_col) -> Column:
    c = F.col(db_up_col) if isinstance(db_up_col, str) else db_up_col
    return F.when(c >= 1, F.lit("healthy")).otherwise(F.lit("degraded"))


def sync_report(report: DataFrame) -> DataFrame:
    """Per table: success, rows, duration (the refresh job's report), plus the
    run's totals in every row."""
    return report.select("table", "success", "rows", "duration_ms", "error",
                         report.agg(F.sum("rows")).scalar().alias("total_rows"))


def sync_status(report: DataFrame) -> DataFrame:
    """NEVER when there was no run (empty report), SUCCESS when every table
    succeeded, PARTIAL when some did, FAILED when none did; last_sync_time is when
    the run's last table finished (null: never)."""
    agg = report.agg(F.count(F.lit(1)).alias("tables"), F.count_if(F.col("success")).alias("succeeded"),
                     F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("rows_synced"),
                     F.max("finished_at").alias("last_sync_time"))
    status = (F.when(F.col("tables") == 0, F.lit("NEVER"))
              .when(F.col("succeeded") == F.col("tables"), F.lit("SUCCESS"))
              .when(F.col("succeeded") > 0, F.lit("PARTIAL")).otherwise(F.lit("FAILED")))
    return agg.select("tables", "succeeded", "rows_synced", status.alias("overall_status"), "last_sync_time")
