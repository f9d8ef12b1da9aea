"""Column expressions (all built-in Spark functions; nothing leaves the JVM)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S

ISO_MS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def month_bucket(col) -> Column:
    """timestamp -> 'YYYY-MM' (session zone, UTC)."""
    return F.date_format(_c(col), "yyyy-MM")


def day_bucket(col) -> Column:
    """timestamp -> 'YYYY-MM-DD'."""
    return F.date_format(_c(col), "yyyy-MM-dd")


def iso_timestamp(col) -> Column:
    """timestamp -> ISO-8601 UTC text with milliseconds, e.g. 2001-02-03T04:05:06.000Z."""
    return F.date_format(_c(col), ISO_MS)


def round_half_up(col, digits: int = 0) -> Column:
    """Half toward +infinity (floor(x*10^d + 0.5) / 10^d).

    Spark's ``round`` goes half away from zero (round(-2.5) = -3); this matches the
    reference's rounding (-2.5 -> -2).  The half is a decimal, so decimals are
    rounded exactly at any size.  With digits=0 the result is a bigint."""
    c = _c(col)
    half = F.lit(Decimal("0.5"))
    if digits == 0:
        return F.floor(c + half).cast("bigint")
    scale = 10 ** digits
    return (F.floor(c * F.lit(scale) + half) / F.lit(scale)).cast("double")


def null_to_zero(col) -> Column:
    """COALESCE(agg, 0) for aggregates over empty input."""
    return F.coalesce(_c(col), F.lit(0))


def conditional_value(cond: Column, value, otherwise=0) -> Column:
    """CASE WHEN cond THEN value ELSE otherwise END."""
    return F.when(cond, _c(value)).otherwise(F.lit(otherwise))


def completed_revenue(status="status", revenue="revenue_generated") -> Column:
    return conditional_value(_c(status) == "Completed", revenue, 0)


def out_of_pocket(amount="amount", coverage="insurance_coverage") -> Column:
    """What the patient pays: amount - insurance coverage (exact decimals)."""
    return _c(amount) - _c(coverage)


def utilization_band(col="utilization", limit: int = S.UTILIZATION_HIGH) -> Column:
    return F.when(_c(col) > limit, F.lit("high")).otherwise(F.lit("normal"))


def entity_key(prefix: str, n, width: int | None = None) -> Column:
    """prefix + number zero-padded to at least ``width`` digits (never truncated:
    ``lpad`` would cut 1234567 to 123456)."""
    w = S.KEY_WIDTH.get(prefix, 6) if width is None else width
    return F.format_string(f"{prefix}%0{w}d", _c(n).cast("bigint"))


def entity_number(key, prefix: str) -> Column:
    """Inverse of ``entity_key``: the numeric part of a key (null when not numeric)."""
    return F.substring(_c(key), len(prefix) + 1, 1 << 30).try_cast("bigint")


def with_lineage(df: DataFrame, col: str = "_silver_processed_at") -> DataFrame:
    """Silver lineage column (processing time)."""
    return df.withColumn(col, F.current_timestamp())


def to_api_names(df: DataFrame, table: str) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in S.API_NAMES[table].items() if k in df.columns})


def to_storage_names(df: DataFrame, table: str) -> DataFrame:
    inv = {v: k for k, v in S.API_NAMES[table].items()}
    return df.withColumnsRenamed({k: v for k, v in inv.items() if k in df.columns})


def to_api_types(df: DataFrame, table: str) -> DataFrame:
    """API value types: money and decimals -> double, counts -> int, timestamps ->
    ISO-8601 text.  Works on storage or API names."""
    names = S.API_NAMES[table]
    ts_cols = set(S.TIMESTAMP_COLUMNS[table]) | {names.get(c, c) for c in S.TIMESTAMP_COLUMNS[table]}
    out = {}
    for f in df.schema.fields:
        if f.name in ts_cols:
            out[f.name] = iso_timestamp(f.name)
        elif f.dataType.typeName() == "decimal":
            out[f.name] = F.col(f.name).cast("double")
    return df.withColumns(out) if out else df


# Growth history: JSON array of {timestamp, patientsCount, appointmentsCount, transactionsCount}
GROWTH_SCHEMA = "array<struct<timestamp:string,patientsCount:int,appointmentsCount:int,transactionsCount:int>>"


def parse_growth_history(df: DataFrame, json_col: str = "record_growth_history") -> DataFrame:
    """JSON array column -> one row per month."""
    return (df.select(F.explode(F.from_json(F.col(json_col), GROWTH_SCHEMA)).alias("h"))
            .select("h.timestamp", "h.patientsCount", "h.appointmentsCount", "h.transactionsCount"))


def pack_growth_history(df: DataFrame, json_col: str = "record_growth_history") -> DataFrame:
    """Month rows -> one JSON array ordered by month, all months of the history
    (one row per calendar month)."""
    st = F.struct("timestamp", "patientsCount", "appointmentsCount", "transactionsCount")
    return df.agg(F.to_json(F.array_sort(F.collect_list(st))).alias(json_col))
