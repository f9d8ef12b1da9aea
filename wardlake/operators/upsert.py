"""Upserts on Parquet tables: insert-if-absent, MERGE by id and date, keyed
appends.

Parquet has no MERGE; the merge is a full outer join on the key, which Spark
plans as one shuffle of both sides on the key (or none, when both sides are
already bucketed/partitioned on it).  Keys are unique on each side after
de-duplication, so the join cannot fan out or skew on a key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import key_blocks
from .quality import dedupe_latest


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def dedupe_first(df: DataFrame, keys=("id",), order_col: str | None = None) -> DataFrame:
    """One row per key: the earliest by ``order_col`` (ties and no order: the
    least row) -- a min over a struct, partially aggregated map-side."""
    keys = _keys(keys)
    rest = [c for c in df.columns if c not in keys and c != order_col]
    lead = [F.col(order_col).alias(order_col)] if order_col else []
    best = F.min(F.struct(*lead, *[F.col(c) for c in rest])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def insert_ignore(target: DataFrame, batch: DataFrame, keys=("id",), order_col: str | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT (key) DO NOTHING: batch rows whose key is new are
    appended (one per key inside the batch); existing rows are untouched."""
    keys = _keys(keys)
    # known keys go first, so only the new rows are reduced to one per key
    new = batch.select(*target.columns).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(dedupe_first(new, keys, order_col))


def merge_upsert(target: DataFrame, source: DataFrame, keys=("id",), order_col: str = "date",
                 update_cols=("amount", "insurance_coverage", "payment_type", "date"),
                 dedupe_source: bool = True) -> DataFrame:
    """MERGE INTO target USING source ON key
         WHEN MATCHED AND target.order_col < source.order_col THEN UPDATE update_cols
         WHEN NOT MATCHED THEN INSERT *
    Matched but not newer: the target row stays as it is; columns outside
    ``update_cols`` never change on a match.  The source is first reduced to
    its newest row per key (a MERGE needs one source row per key)."""
    keys = _keys(keys)
    cols = target.columns
    src = source.select(*cols)
    if dedupe_source:
        src = dedupe_latest(src, keys, order_col)
    rest = [c for c in cols if c not in keys]
    t = target.select(*keys, *[F.col(c).alias(f"_t_{c}") for c in rest], F.lit(True).alias("_t_in"))
    s = src.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in rest], F.lit(True).alias("_s_in"))
    j = t.join(s, keys, "full_outer")
    t_missing = F.col("_t_in").isNull()
    newer = F.col("_s_in") & (F.col(f"_t_{order_col}") < F.col(f"_s_{order_col}"))
    out = []
    for c in cols:
        if c in keys:
            out.append(F.col(c))
        elif c in update_cols:
            out.append(F.when(t_missing | newer, F.col(f"_s_{c}")).otherwise(F.col(f"_t_{c}")).alias(c))
        else:
            out.append(F.when(t_missing, F.col(f"_s_{c}")).otherwise(F.col(f"_t_{c}")).alias(c))
    return j.select(*out)


def merge_stats(target: DataFrame, source: DataFrame, keys=("id",), order_col: str = "date") -> DataFrame:
    """What a merge would do: source rows, matches, updates (newer), inserts."""
    keys = _keys(keys)
    src = dedupe_latest(source.select(*target.columns), keys, order_col)
    t = target.select(*keys, F.col(order_col).alias("_td"))
    j = src.select(*keys, F.col(order_col).alias("_sd")).join(t, keys, "left")
    return j.agg(F.count(F.lit(1)).alias("source_rows"),
                 F.count_if(F.col("_td").isNotNull()).alias("matched"),
                 F.count_if(F.col("_td") < F.col("_sd")).alias("updated"),
                 F.count_if(F.col("_td").isNull()).alias("inserted"))


def append_with_keys(spark: SparkSession, target: DataFrame, batch: DataFrame, prefix: str,
                     width: int = 6, key: str = "id", order_by=None, numbers: str | None = None,
                     batch_id: str | None = None) -> DataFrame:
    """Number a new batch after the existing rows: key = prefix + (max existing
    number + position in batch), zero-padded to at least ``width`` digits.

    Positions are assigned without a single-partition window: each partition
    counts its rows (one small aggregate, at most #partitions rows), a running
    sum over those counts gives each partition its offset, and rows add their
    index inside the partition.  The tagged batch (partition id and in-partition
    position stored as columns) is written once as a table under the shared
    checkpoint folder, which cuts the lineage: both passes read the same stored
    positions even if an executor is lost in between.

    ``order_by`` numbers the batch in that (unique) order: a range-partitioned
    distributed sort puts partition i's rows before partition i+1's, so the
    same offsets give the global position.  Without it, rows are numbered in
    arrival (partition) order, as the reference numbers inserts."""
    from ..session import scratch_path
    if order_by is not None:
        batch = batch.orderBy(*([order_by] if isinstance(order_by, str) else order_by))
    tagged = batch.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    stage = scratch_path(spark, "append-batch")
    tagged.write.mode("overwrite").parquet(stage)
    b = spark.read.parquet(stage)
    counts = b.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    num = F.regexp_extract(F.col(key), r"(\d+)$", 1).try_cast("bigint")
    base = target.agg(F.coalesce(F.max(num), F.lit(0)).alias("base"))
    if numbers is not None:
        base = F.lit(key_blocks.reserve(spark, numbers, batch_id or uuid.uuid4().hex, b.count(),
                                        lambda: base.first()["base"]) - 1)
    else:
        base = base.scalar()  # scalar subquery
    local_idx = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    numbered = b.join(offsets, "_pid").withColumn("_n", base + F.col("_off") + local_idx + 1)
    out = numbered.withColumn(key, F.format_string(f"{prefix}%0{width}d", F.col("_n")))
    return out.drop("_pid", "_mid", "_off", "_n")
