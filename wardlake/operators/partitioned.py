"""MERGE into a table laid out by month that rewrites only the months it touches.

Which months hold a key of the source is not known from the source: its dates are
new.  So only the key column of the target is read, in the range of the source's
least and greatest key (a pushed filter, which skips row groups), through a blocked
Bloom filter of the source's keys where that is small enough to broadcast, and what
passes is joined exactly; a month with a match is read and merged, all others keep
their files.  The months that the source's own dates lie in are read too, as they
may get rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..session import dropping_shuffles, input_bytes, remove_path
from ..sources.tables import split_bounds
from ..streaming import batches
from .upsert import dedupe_latest, merge_upsert

MONTH = "month"
NO_MONTH = "none"
#: Bits of one block of the Bloom filter (fixed by Spark's bitmap functions).
BLOCK_BITS = 32768
BITS_PER_KEY = 10
PROBES = 4
#: The filter is broadcast up to this size; beyond it the keys are joined directly.
BLOOM_LIMIT = 32 << 20
#: Bytes of Parquet files for one range of keys, and how many ranges there are at most
#: (each makes a file in every month): a merge finds them sorted by key, but holds the
#: table twice; a first write passes over all its rows for each.
SLICE_BYTES = 32 << 20
MERGE_SLICES, WRITE_SLICES = 16, 4


def month_of(col: str = "date") -> Column:
    return F.coalesce(F.date_format(col, "yyyy-MM"), F.lit(NO_MONTH)).alias(MONTH)


def slices_of(size: int, most: int = WRITE_SLICES) -> int:
    """Ranges of keys for ``size`` bytes of files."""
    return min(max(-(-size // SLICE_BYTES), 1), most)


def key_slices(keys: DataFrame, key: str, n: int) -> list[Column]:
    """Conditions for at most ``n`` ranges of keys of about equal size; every row meets
    one of them, rows without the key the first."""
    cuts, k = split_bounds(keys, key, n) if n > 1 else [], F.col(key)
    if not cuts:
        return [F.lit(True)]
    return [(k < F.lit(cuts[0])) | k.isNull(), *[(k >= F.lit(a)) & (k < F.lit(b)) for a, b in zip(cuts, cuts[1:])], k >= F.lit(cuts[-1])]


def _write(df: DataFrame, path: str, date_col: str, mode: str) -> None:
    (df.withColumn(MONTH, month_of(date_col)).repartitionByRange(MONTH, "id").sortWithinPartitions(MONTH, "id").write.mode(mode)
     .option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(MONTH).parquet(path))


def write_by_month(df: DataFrame, path: str, date_col: str = "date", mode: str = "overwrite", slices: int = 1) -> None:
    """Write a table with one folder per month; rows sorted by key inside a file, so
    that key filters skip row groups.  Range partitions of (month, key) give few files
    a month and split a month that is too large for one task.

    With ``slices`` the rows of so many ranges of keys are shuffled one after the other
    (each evaluates ``df``) and staged beside the months, which are replaced at the end;
    ``append`` takes one pass."""
    if slices < 2 or mode != "overwrite":
        return _write(df, path, date_col, mode)
    spark, stage = df.sparkSession, f"{path.rstrip('/')}/_stage-{uuid.uuid4().hex[:12]}"
    with dropping_shuffles(spark):
        for part in key_slices(df, "id", slices):
            _write(df.where(part), stage, date_col, "append")
    _move_months(spark, path.rstrip("/"), stage)
    remove_path(spark, stage)


def _month_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the month folders at ``path``."""
    fs, p = batches._fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith(f"{MONTH}="))


def _move_months(spark: SparkSession, path: str, stage: str) -> None:
    """Put the staged months in the place of those at ``path``.  What has been moved is
    gone from the stage, so a run that was cut off can be done again."""
    for name in _month_folders(spark, stage):
        remove_path(spark, f"{path}/{name}")
        fs, old = batches._fs(spark, f"{stage}/{name}")
        if not fs.rename(old, batches._fs(spark, f"{path}/{name}")[1]):
            raise RuntimeError(f"{stage}/{name} could not be moved to {path}")
    spark.catalog.refreshByPath(path)


def read_by_month(spark: SparkSession, path: str, table: str = "transactions") -> DataFrame:
    """The table with its month column."""
    return spark.read.schema(S.bronze_schema(table).add(MONTH, "string")).parquet(path)


def _probes(key: Column) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BLOCK_BITS)) for i in range(1, PROBES + 1)])


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """Blocked Bloom filter as a table (block, bits): all probes of a key lie in one
    block, so a lookup is one join on the block's number."""
    # the bitmap aggregate counts bits from 0
    return keys.select(_block(F.col(key), blocks).alias("block"), F.explode(_probes(F.col(key))).alias("bit")).groupBy("block").agg(
        F.bitmap_construct_agg("bit").alias("bits"))


def may_contain(df: DataFrame, key: str, bits: DataFrame, blocks: int) -> DataFrame:
    """Rows of ``df`` whose key may be in the filter (none that is gets lost)."""
    byte = lambda b: F.conv(F.hex(F.substring(F.col("bits"), (F.floor(b / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.forall(_probes(F.col(key)), lambda b: F.getbit(byte(b), F.pmod(b, F.lit(8)).cast("int")) == 1)
    return df.withColumn("block", _block(F.col(key), blocks)).join(F.broadcast(bits), "block").where(hit).drop("block", "bits")


def touched_months(target: DataFrame, source: DataFrame, key: str = "id", bloom_limit: int = BLOOM_LIMIT) -> list[str]:
    """Months of the target that hold a key of the source."""
    low, high, n = source.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n:
        return []
    rows = target.where(F.col(key).between(low, high)).select(key, MONTH)
    blocks = -(-n * BITS_PER_KEY // BLOCK_BITS)
    if blocks * BLOCK_BITS // 8 <= bloom_limit:
        # a row number keeps the optimiser from joining exactly before it filters
        rows = may_contain(rows, key, bloom(source, key, blocks), blocks).where(F.monotonically_increasing_id() >= 0)
    found = rows.join(source.select(key).distinct(), key, "left_semi").select(MONTH).distinct()
    return sorted(r[0] for r in found.collect())  # months: as many as the calendar has


_MERGING = "_merging"
_EMPTIED = "_emptied"


def _publish(spark: SparkSession, path: str, stage: str, months: list[str], table: str, key: str) -> None:
    """Replace ``months`` by the staged rows (again, if need be)."""
    emptied = f"{stage}/{_EMPTIED}"
    if not batches.exists(spark, emptied):  # before the first month leaves the stage
        left = set(_month_folders(spark, stage))
        batches.put(spark, emptied, "\n".join(m for m in months if f"{MONTH}={m}" not in left).encode())
    for month in filter(None, batches.get(spark, emptied).decode().split("\n")):  # all rows have moved to other months
        remove_path(spark, f"{path}/{MONTH}={month}")
    _move_months(spark, path, stage)
    remove_path(spark, f"{path}/{_MERGING}")
    remove_path(spark, stage)


def finish_merge(spark: SparkSession, path: str, table: str = "transactions", key: str = "id") -> bool:
    """Complete a merge that was cut off while it replaced months."""
    path = path.rstrip("/")
    if not batches.exists(spark, f"{path}/{_MERGING}"):
        return False
    stage, *months = batches.get(spark, f"{path}/{_MERGING}").decode().split("\n")
    _publish(spark, path, stage, months, table, key)
    return True


def merge_by_month(spark: SparkSession, path: str, source: DataFrame, table: str = "transactions", key: str = "id",
                   order_col: str = "date", update_cols=("amount", "insurance_coverage", "payment_type", "date"),
                   bloom_limit: int = BLOOM_LIMIT) -> list[str]:
    """``upsert.merge_upsert`` of ``source`` into the table at ``path``; returns the
    months that were rewritten.  The source is read once and stored while the merge runs.

    One merge at a time.  The merged rows are staged beside the months (in a folder
    that readers skip) and a note is left before any month is replaced; a run that
    is cut off then is completed by the next merge or by ``finish_merge``."""
    path, names = path.rstrip("/"), S.bronze_schema(table).names
    finish_merge(spark, path, table, key)
    target = read_by_month(spark, path, table)
    # reduced once: the months, the keys and the merge all read it
    reduced, stage = [f"{path}/_{n}-{uuid.uuid4().hex[:12]}" for n in ("source", "stage")]
    with dropping_shuffles(spark):
        (dedupe_latest(source.select(*names), [key], order_col).sortWithinPartitions(key).write.option("compression", "zstd").parquet(reduced))
        src = spark.read.schema(S.bronze_schema(table)).parquet(reduced)
        own = [r[0] for r in src.select(month_of(order_col)).distinct().collect()]
        others = {n.partition("=")[2] for n in _month_folders(spark, path)} - set(own)
        touched = touched_months(target.where(F.col(MONTH).isin(sorted(others))), src, key, bloom_limit) if others else []
        months = sorted({*touched, *own})
        if not months:
            remove_path(spark, reduced)
            return []
        old = target.where(F.col(MONTH).isin(months)).select(*names)
        size = input_bytes(spark, reduced, *[f"{path}/{n}" for n in _month_folders(spark, path) if n.partition("=")[2] in months])
        for part in key_slices(old.select(key).unionByName(src.select(key)), key, slices_of(size, MERGE_SLICES)):
            merged = merge_upsert(old.where(part), src.where(part), key, order_col, update_cols, dedupe_source=False)
            _write(merged, stage, order_col, "append")
    remove_path(spark, reduced)
    batches.put(spark, f"{path}/{_MERGING}", "\n".join([stage, *months]).encode())
    _publish(spark, path, stage, months, table, key)
    return months
