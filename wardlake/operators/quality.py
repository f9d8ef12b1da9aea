"""Silver rules and data-quality checks (the table constraints as checks).

Every check is one aggregation or one anti join; none collects rows.  Unique
key checks count per key with partial aggregation, so a hot key is reduced
map-side before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.scalars import with_lineage


def silver_patients_rule() -> F.Column:
    return (F.col("id").isNotNull() & F.col("name").isNotNull()
            & (F.col("age") > 0) & (F.col("age") < 120))


def silver_transactions_rule() -> F.Column:
    return F.col("id").isNotNull() & (F.col("amount") > 0)


SILVER_RULES = {"patients": silver_patients_rule, "transactions": silver_transactions_rule}


def silver_patients(bronze: DataFrame, lineage: bool = True) -> DataFrame:
    """id and name present, 0 < age < 120, plus the lineage timestamp."""
    out = bronze.where(silver_patients_rule())
    return with_lineage(out) if lineage else out


def silver_transactions(bronze: DataFrame, lineage: bool = True) -> DataFrame:
    """id present, amount > 0, plus the lineage timestamp."""
    out = bronze.where(silver_transactions_rule())
    return with_lineage(out) if lineage else out


def check_unique_key(df: DataFrame, keys=("id",)) -> DataFrame:
    """Keys that occur more than once, with their count."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).where(F.col("occurrences") > 1)


def check_not_null(df: DataFrame, cols) -> DataFrame:
    """One pass: per required column, the number of null values (long form)."""
    cols = list(cols)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {stack}) AS (column, nulls)")


def check_domain(df: DataFrame, col: str, values, key: str = "id") -> DataFrame:
    """Rows whose ``col`` is outside the allowed values (nulls are the not-null
    check's business)."""
    return df.where(F.col(col).isNotNull() & ~F.col(col).isin(list(values))).select(key, col)


def check_domains(df: DataFrame, table: str, overrides: dict | None = None) -> DataFrame:
    """All domain rules of a table as (column, value, rows) violations, in one pass:
    each row explodes into its violations (mostly none), which are then counted."""
    domains = dict(S.DOMAINS.get(table, {}))
    domains.update(overrides or {})
    if not domains:
        return df.sparkSession.createDataFrame([], "column string, value string, rows bigint")
    bad = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(list(v)),
                  F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")))
           for c, v in domains.items()]
    return (df.select(F.explode(F.filter(F.array(*bad), lambda x: x.isNotNull())).alias("x")).select("x.*")
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows")))


def check_all_constraints(frames: dict[str, DataFrame]) -> DataFrame:
    """Every declared constraint of every table as (table, rule, column, value,
    rows) violations: required columns (value null), key values that occur more
    than once (rows = occurrences), values outside a domain."""
    parts = []
    for t, df in frames.items():
        def found(rule, c, value, wrong):
            return F.when(wrong, F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("column"), value.cast("string").alias("value")))

        # one pass: each row explodes into its violations (mostly none)
        bad = [found("not null", c, F.lit(None), F.col(c).isNull()) for c in S.REQUIRED[t]] + [
            found("domain", c, F.col(c), F.col(c).isNotNull() & ~F.col(c).isin(list(v))) for c, v in S.DOMAINS.get(t, {}).items()]
        rows = df.select(F.explode(F.filter(F.array(*bad), lambda x: x.isNotNull())).alias("x")).groupBy(
            "x.rule", "x.column", "x.value").agg(F.count(F.lit(1)).alias("rows"))
        keys = check_unique_key(df.where(F.col("id").isNotNull())).select(
            F.lit("unique").alias("rule"), F.lit("id").alias("column"), F.col("id").alias("value"), F.col("occurrences").alias("rows"))
        parts.append(rows.unionByName(keys).select(F.lit(t).alias("table"), "rule", "column", "value", "rows"))
    return reduce(DataFrame.unionByName, parts)


def check_foreign_key(child: DataFrame, parent: DataFrame, fk: str, pk: str = "id",
                      key: str = "id") -> DataFrame:
    """Child rows whose non-null ``fk`` has no parent row (null links allowed)."""
    p = parent.select(F.col(pk).alias(fk))
    return child.where(F.col(fk).isNotNull()).join(p, fk, "left_anti").select(key, fk)


FOREIGN_KEYS = [("appointments", "patient_id", "patients"), ("appointments", "doctor_id", "doctors"),
                ("transactions", "patient_id", "patients"), ("transactions", "appointment_id", "appointments")]


def check_all_foreign_keys(frames: dict[str, DataFrame]) -> DataFrame:
    """Orphan counts for the four links (one row per link)."""
    parts = [check_foreign_key(frames[c], frames[p], fk).agg(F.count(F.lit(1)).alias("orphans"))
             .select(F.lit(c).alias("child"), F.lit(fk).alias("fk"), F.lit(p).alias("parent"), "orphans")
             for c, fk, p in FOREIGN_KEYS]
    return reduce(DataFrame.unionByName, parts)


# Column defaults from the table definitions.
DEFAULTS = {
    "departments": {"beds_total": 0, "beds_occupied": 0, "kpi_satisfaction": 0.0, "avg_wait_time": 0},
    "doctors": {"experience": 0, "consultation_fee": 0, "utilization": 0},
    "patients": {},
    "appointments": {"duration": S.DEFAULT_DURATION, "revenue_generated": 0},
    "transactions": {"amount": 0, "insurance_coverage": 0},
}
# Columns that default to the time of the run.
NOW_DEFAULTS = {"patients": ["registration_date"]}


def fill_defaults(df: DataFrame, table: str) -> DataFrame:
    """Missing values get the declared defaults (0 / 0.0 / 30 minutes / now)."""
    out = {}
    for c, v in DEFAULTS[table].items():
        if c in df.columns:
            out[c] = F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType))
    for c in NOW_DEFAULTS.get(table, []):
        if c in df.columns:
            out[c] = F.coalesce(F.col(c), F.current_timestamp())
    return df.withColumns(out) if out else df


def dedupe_latest(df: DataFrame, keys=("id",), order_col: str = "date") -> DataFrame:
    """One row per key: the one with the newest ``order_col`` (ties: the greatest
    row).  Written as a max over a struct, which aggregates partially map-side:
    a key holding a third of all rows never lands whole in one task."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rest = [c for c in df.columns if c not in keys and c != order_col]
    best = F.max(F.struct(F.col(order_col).alias(order_col), *[F.col(c) for c in rest])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def silver_pass_rate(bronze: DataFrame, rule: F.Column) -> DataFrame:
    """100 * rows passing the Silver rule / Bronze rows, in one pass."""
    agg = bronze.agg(F.count(F.lit(1)).alias("bronze_rows"), F.count_if(rule).alias("silver_rows"))
    return agg.select("bronze_rows", "silver_rows",
                      F.when(F.col("bronze_rows") > 0, F.col("silver_rows") * 100.0 / F.col("bronze_rows"))
                      .otherwise(F.lit(100.0)).cast("double").alias("pass_rate"))
