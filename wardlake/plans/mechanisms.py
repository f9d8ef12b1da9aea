"""Registered queries of operators that keep state between runs or between parts of
an input: streams with timers and bounded state, set-aside records, month-wise
merges, split reads, pages by number, the metric grid, guarded SQL, key blocks.

The streaming ones run over landing files written from the given tables, in several
arrivals, one availableNow run each on one checkpoint.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scalars as X
from ..operators import metrics, partitioned, registers, upsert
from ..session import dropping_shuffles, input_bytes, remove_path, scratch_path
from ..sources import tables
from ..sources.fixtures import Hospital, load_hospital
from ..streaming import alerts, insurers, integrity
from ..streaming import incremental as inc
from . import presets
from .registry import ALERT_RULES, _number, _raw, _tx_out, planted, register, upsert_fixture

FIRST_ARRIVAL = datetime(2024, 6, 1)


def _arrive(df: DataFrame, folder: str, hour: float) -> str:
    """Write a landing file that arrives ``hour`` hours after the first one."""
    at = F.lit(str(FIRST_ARRIVAL + timedelta(hours=hour))).cast("timestamp")
    df.withColumn("_arrived", at).write.mode("append").parquet(folder)
    return folder


def _staged(df: DataFrame, path: str) -> DataFrame:
    """The rows as a table: arrivals cut from it do not build them again."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _arriving(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


# -- streams -------------------------------------------------------------------------

ALERT_START = "2024-01-10 00:00:00"


@_raw("stream_threshold_alerts")
def _q_stream_threshold_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a rule's state from ALERT_START on, over three arrivals of
    samples; the last one ends with a sample that moves event time past all others."""
    samples = load_hospital(spark, sf_dir).metric_samples
    rules = metrics.rules_frame(spark, ALERT_RULES)
    base = scratch_path(spark, "stream-alerts")
    end = spark.sql("SELECT 'end' AS metric, TIMESTAMP'2024-03-01 00:00:00' AS ts, 0D AS value, cast(null AS map<string,string>) AS labels")
    cuts = ["2024-01-01", "2024-01-08", "2024-01-20", "2025-01-01"]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = samples.where((F.col("ts") >= a) & (F.col("ts") < b))
        (part if i < 2 else part.unionByName(end)).write.mode("overwrite").parquet(f"{base}/landing/a{i}")
        stream = spark.readStream.schema(samples.schema).parquet(f"{base}/landing/*")
        alerts.stream_threshold_alerts(stream, rules, f"{base}/alerts", f"{base}/ck", ALERT_START).awaitTermination()
    return alerts.read_alerts(spark, f"{base}/alerts").where("kind = 'change'").select(
        "service", "rule", "severity", X.iso_timestamp("at").alias("at"), "state", "reason", "value")


@_raw("stream_check_foreign_key")
def _q_stream_check_foreign_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charges without a patient: a third of the patients come with the first charges,
    a third an hour later, a third have been there before, some never come."""
    frames, n = planted(load_hospital(spark, sf_dir)), _number()
    base = scratch_path(spark, "stream-orphans")
    link = _staged(frames["transactions"].select("id", "patient_id"), f"{base}/all")
    people = frames["patients"].where(n % 5 != 0).select("id").distinct()
    known = f"{base}/known"
    people.where(n % 3 == 2).write.parquet(known)
    end = spark.sql("SELECT 'TX-end' AS id, 'PT-end' AS patient_id")

    def run():
        integrity.stream_orphans(
            _arriving(spark, f"{base}/charges", "id string, patient_id string, _arrived timestamp"),
            _arriving(spark, f"{base}/people", "id string, _arrived timestamp"), "patient_id", f"{base}/orphans", f"{base}/ck",
            lambda s: s.read.schema("id string").parquet(known), bound="2 hours").awaitTermination()

    for hour in (0, 1):
        _arrive(link.where(_number() % 2 == hour), f"{base}/charges", hour)
        _arrive(people.where(n % 3 == hour), f"{base}/people", hour)
        run()
    _arrive(end, f"{base}/charges", 10)  # the bound has passed
    _arrive(end.select(F.col("patient_id").alias("id")), f"{base}/people", 10)
    run()
    return integrity.read_found(spark, f"{base}/orphans", "id string, patient_id string")


@_raw("stream_check_unique_key")
def _q_stream_check_unique_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of charges that arrive twice, some in the same file, some half an hour apart."""
    h, n = load_hospital(spark, sf_dir), _number()
    base = scratch_path(spark, "stream-keys")
    ids = _staged(h.transactions.select("id"), f"{base}/all")
    again = ids.where(n % 41 == 0)
    arrivals = [(0, ids.unionByName(again.where(n % 2 == 0))), (0.5, again.where(n % 2 == 1)), (9, spark.sql("SELECT 'TX-end' AS id"))]
    for hour, df in arrivals:
        _arrive(df, f"{base}/landing", hour)
        integrity.stream_repeated_keys(_arriving(spark, f"{base}/landing", "id string, _arrived timestamp"), f"{base}/found",
                                       f"{base}/ck").awaitTermination()
    return integrity.read_found(spark, f"{base}/found", "id string, occurrences bigint")


@_raw("stream_dedupe")
def _q_stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze after three arrivals, of which the second holds the first once more."""
    base = scratch_path(spark, "stream-once")
    tx = _staged(load_hospital(spark, sf_dir).transactions, f"{base}/all")
    first = F.col("type").isin("Consultation", "Lab Fee")
    schema = S.bronze_schema("transactions").add("_arrived", "timestamp")
    for hour, part in enumerate([tx.where(first), tx.where(first), tx.where(~first)]):
        _arrive(tables.to_bronze(part, "transactions"), f"{base}/landing", hour)
        inc.stream_bronze_append(spark, f"{base}/landing", "transactions", f"{base}/bronze", f"{base}/ck",
                                 source=_arriving(spark, f"{base}/landing", schema), once_within="6 hours",
                                 count_state=False).awaitTermination()
    return _tx_out(tables.read_bronze_table(spark, f"{base}/bronze", "transactions"))


@_raw("stream_gold_insurance_utilization")
def _q_stream_gold_insurance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The insurer view after three arrivals; a third of the patients first come with
    another insurer, and half of them come after their first charges."""
    h, n = load_hospital(spark, sf_dir), _number()
    base = scratch_path(spark, "stream-insurers")
    tx = _staged(h.transactions, f"{base}/all")
    before = h.patients.withColumn("insurance_provider", F.when(n % 3 == 0, F.lit("Before")).otherwise(F.col("insurance_provider")))
    people = [before.where(n % 2 == 0), before.where(n % 2 == 1), h.patients.where(n % 3 == 0)]
    kinds = [["Consultation", "Lab Fee"], ["Pharmacy"], ["Emergency Services"]]
    schema = S.bronze_schema("patients").add("version", "integer")
    for i, (pt, kind) in enumerate(zip(people, kinds)):
        tables.to_bronze(pt, "patients").withColumn("version", F.lit(i)).write.mode("append").parquet(f"{base}/patients")
        tables.to_bronze(tx.where(F.col("type").isin(kind)), "transactions").write.mode("append").parquet(f"{base}/charges")
        insurers.stream_insurance_utilization(
            spark.readStream.schema(S.bronze_schema("transactions")).parquet(f"{base}/charges"),
            spark.readStream.schema(schema).parquet(f"{base}/patients"), f"{base}/view", f"{base}/ck").awaitTermination()
    return insurers.read_insurance_utilization(spark, f"{base}/view")


# -- sources and sinks ---------------------------------------------------------------

@_raw("load_bronze_csv_rejects")
def _q_load_bronze_csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records per reason (null: good rows) after a load of charges of which some have
    a bad amount, too few fields or a bad date."""
    tx, n = load_hospital(spark, sf_dir).transactions, _number()
    base = scratch_path(spark, "csv-rejects")
    df = tables.csv_text_frame(tx, "transactions").withColumns({
        "date": F.when(n % 11 == 0, F.lit("soon")).otherwise(X.iso_timestamp("date")),
        "amount": F.when(n % 7 == 0, F.lit("1,5")).otherwise(F.col("amount"))})
    fields = [F.coalesce(F.when(F.col(c).contains(","), F.concat(F.lit('"'), F.col(c), F.lit('"'))).otherwise(F.col(c)), F.lit("NULL"))
              for c in df.columns]
    line = F.when(n % 13 == 0, F.concat_ws(",", *fields[:5])).otherwise(F.concat_ws(",", *fields))
    df.select(line.alias("value")).write.text(f"{base}/landing")
    good = tables.load_bronze_csv(spark, f"{base}/landing", "transactions", f"{base}/bronze")
    bad = tables.read_rejected(spark, f"{base}/bronze", "transactions")
    return good.select(F.lit(None).cast("string").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(
        F.count(F.lit(1)).alias("records"))


@_raw("merge_upsert_by_month")
def _q_merge_upsert_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_path(spark, "merge-by-month")
    with dropping_shuffles(spark):
        target, source = upsert_fixture(_staged(load_hospital(spark, sf_dir).transactions, f"{base}/all"))
        partitioned.write_by_month(tables.to_bronze(target, "transactions"), f"{base}/table",
                                   slices=partitioned.slices_of(input_bytes(spark, f"{base}/all")))
        source = _staged(tables.to_bronze(source, "transactions"), f"{base}/source")
    remove_path(spark, f"{base}/all")
    partitioned.merge_by_month(spark, f"{base}/table", source)
    remove_path(spark, f"{base}/source")
    return _tx_out(partitioned.read_by_month(spark, f"{base}/table"))


@_raw("jdbc_snapshot_split")
def _q_jdbc_snapshot_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers read in parts by their name, a text key with one long prefix."""
    return tables.jdbc_snapshot(spark, f"{sf_dir.rstrip('/')}/customer.parquet", "customer",
                                ["c_custkey", "c_name", "c_mktsegment"], split_by="c_name", num_partitions=6)


@register("append_with_keys_blocks")
def _append_with_keys_blocks(h: Hospital) -> DataFrame:
    """Two batches of new patients, numbered through reserved blocks; the first is
    written again and keeps its numbers."""
    spark, numbers = h.patients.sparkSession, scratch_path(h.patients.sparkSession, "numbers")
    parts = [h.patients.where(_number() % 2 == k).select("id", "name") for k in (0, 1)]
    first, second, again = [upsert.append_with_keys(spark, h.patients, parts[k], "PT", 6, order_by=["name", "id"], numbers=numbers,
                                                    batch_id=f"batch {k}").select("id", "name") for k in (0, 1, 0)]
    return first.intersect(again).unionByName(second)


# -- registers, metrics, SQL ---------------------------------------------------------

@register("page_by_number")
def _page_by_number(h: Hospital) -> DataFrame:
    """The first, a middle and the last page of the Lab Fee charges."""
    spark, order = h.transactions.sparkSession, [("date", True), ("id", True)]
    df = registers.filter_transactions(h.transactions, type="Lab Fee")
    path = scratch_path(spark, "page-index")
    registers.page_index(df, order, path)
    index = spark.read.parquet(path)
    last = index.agg(F.max("page")).first()[0] or 1
    pages = [registers.page_by_number(df, order, index, p).select(F.lit(p).cast("bigint").alias("page"), "id", X.iso_timestamp("date").alias("date"))
             for p in sorted({1, last // 2 + 1, last})]
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p)
    return out


@register("metric_grid")
def _metric_grid(h: Hospital) -> DataFrame:
    """Every metric each hour of a week, carried forward for half an hour."""
    return metrics.metric_grid(h.metric_samples, "2024-01-08 00:00:00", "2024-01-15 00:00:00", 3600, 1800).withColumns({
        "ts": X.iso_timestamp("ts"), "age": F.round("age", 3)})


ADHOC_STATEMENTS = {
    "count": "SELECT id FROM transactions WHERE amount > 1000",
    "with": "WITH t AS (SELECT patient_id, sum(amount) s FROM transactions GROUP BY patient_id) SELECT * FROM t WHERE s > 5000",
    "write": "INSERT INTO patients SELECT * FROM patients",
    "drop": "DROP VIEW patients",
    "java": "SELECT reflect('java.lang.System', 'currentTimeMillis') FROM patients",
    "file": "SELECT * FROM parquet.`/data/patients`",
    "error": "SELECT raise_error('no') FROM patients",
}


@register("adhoc_status")
def _adhoc_status(h: Hospital) -> DataFrame:
    """Status, row count before the cap and rows returned of ad hoc statements."""
    spark = h.patients.sparkSession
    presets.register_views(spark, h.as_dict())
    out = []
    for name, sql in ADHOC_STATEMENTS.items():
        try:
            res = presets.adhoc_sql(spark, sql, 50)
            rows = res.row_count()
            out.append((name, res.status, rows, min(rows, 50), res.duration_ms >= 0))
        except presets.NotASelect:
            out.append((name, "REFUSED", None, None, None))
    return spark.createDataFrame(out, "name string, status string, row_count bigint, returned bigint, timed boolean")
