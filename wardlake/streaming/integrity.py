"""Keys and links checked while rows arrive.

A micro-batch stores its rows in a folder of its own beside the checkpoint, and
decides what the watermark has passed since the micro-batch before, by one batch
query over these folders; nothing is decided twice, also when a batch is replayed.
Folds leave out what is decided, so the folders hold the rows of the bound only.

* ``stream_orphans``: charges (or appointments) whose parent has not come.  Parents
  may arrive up to the bound later *or* earlier.  Parents that came longer ago are in
  the parent table: what is left over is anti-joined with it before it is reported.
* ``stream_repeated_keys``: keys that arrive more than once within a gap, by session
  windows.
* dropping repeated rows instead: ``incremental.stream_bronze_append`` with
  ``once_within``.

Arrival is the column ``_arrived``; the watermark is ``delay`` behind the slowest stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from . import batches
from .incremental import _start


def _watermark(rows: DataFrame, sides: list[Column], delay: str) -> Column | None:
    """``delay`` before the last arrival of the slowest side; None before each has a row."""
    found = rows.agg(*[F.max(F.when(x, F.unix_micros("_arrived"))) for x in sides]).first()
    return None if None in tuple(found) else F.timestamp_micros(F.lit(min(found))) - F.expr(f"INTERVAL {delay}")


def _decide(df: DataFrame, batch_id: int, checkpoint: str, out_dir: str, sides: list[Column], span: str, delay: str,
            found: Callable[[DataFrame, Column, Column], DataFrame], still_open: Callable[[DataFrame, Column], DataFrame],
            fold_every: int) -> None:
    """Store a micro-batch's rows and write what ``found`` returns for all stored rows,
    the watermark before and the watermark now."""
    s, store = df.sparkSession, f"{checkpoint.rstrip('/')}/arrived"
    query, schema = batches.query_id(s, checkpoint), df.schema
    batches.write_batch(df, store, query, batch_id)
    read = s.read.schema(schema)
    paths = batches.committed(s, store)
    before = [p for p in paths if not p.rstrip("/").endswith(f"query={query}/batch={batch_id}")]
    rows = read.parquet(*paths)
    old = _watermark(read.parquet(*before), sides, delay) if before else None
    new = _watermark(rows, sides, delay)
    if new is None:
        return
    old = F.timestamp_micros(F.lit(0)) if old is None else old
    # nothing ends before the first stored arrival's span
    if rows.where((F.col("_arrived") + F.expr(f"INTERVAL {span}") > old) & (F.col("_arrived") + F.expr(f"INTERVAL {span}") <= new)).isEmpty():
        return
    batches.write_batch(found(rows, old, new), out_dir, query, batch_id)
    if batch_id % fold_every == fold_every - 1:
        batches.fold(s, store, schema, lambda kept: still_open(kept, new))


def awaited_parents(rows: DataFrame, old: Column, new: Column, fk: str, key: str = "id", bound: str = "1 hour") -> DataFrame:
    """key, ``fk`` and _arrived of the child rows whose bound ends after ``old`` and up
    to ``new`` and that have no parent row (``_pk``) that arrived at most ``bound`` before
    or after.  Null links are fine."""
    span = F.expr(f"INTERVAL {bound}")
    due = rows.where(F.col("_pk").isNull() & F.col(fk).isNotNull()).where(
        (F.col("_arrived") + span > old) & (F.col("_arrived") + span <= new)).select(key, fk, "_arrived")
    # a parent's arrivals once each: a file that comes again adds nothing
    p = rows.where(F.col("_pk").isNotNull()).select("_pk", F.col("_arrived").alias("_came")).distinct()
    near = (F.col(fk) == F.col("_pk")) & (F.col("_came") >= F.col("_arrived") - span) & (F.col("_came") <= F.col("_arrived") + span)
    return due.join(p, near, "left_anti")


def stream_orphans(child: DataFrame, parent: DataFrame, fk: str, out_dir: str, checkpoint: str,
                   known: Callable[[SparkSession], DataFrame | None], pk: str = "id", key: str = "id",
                   bound: str = "1 hour", delay: str = "10 minutes", available_now: bool = True,
                   fold_every: int = 100) -> StreamingQuery:
    """Write the orphans of every micro-batch.  ``known`` reads the parent table as
    it is then (Bronze, say); it decides about parents from before the bound."""
    c = child.select(key, fk, "_arrived")
    schema = c.schema
    p = parent.where(F.col(pk).isNotNull()).select(F.col(pk).alias("_pk"), "_arrived")
    rows = c.withColumn("_pk", F.lit(None).cast(p.schema["_pk"].dataType)).unionByName(p, allowMissingColumns=True)
    is_parent = F.col("_pk").isNotNull()

    def apply(df: DataFrame, batch_id: int) -> None:
        def found(stored: DataFrame, old: Column, new: Column) -> DataFrame:
            df, table = awaited_parents(stored, old, new, fk, key, bound), known(stored.sparkSession)
            return df if table is None else df.join(table.select(F.col(pk).alias(fk)), fk, "left_anti").select(*schema.names)

        span = F.expr(f"INTERVAL {bound}")  # a parent counts for charges up to a bound after it, which wait as long again
        _decide(df, batch_id, checkpoint, out_dir, [~is_parent, is_parent], bound, delay, found, lambda kept, new: kept.where(
            F.when(is_parent, F.col("_arrived") + span + span > new).otherwise(F.col("_arrived") + span > new)), fold_every)
        if batch_id % fold_every == fold_every - 1:
            batches.fold(df.sparkSession, out_dir, schema)

    return _start(rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint), available_now)


def sessions(rows: DataFrame, keys: list[str], gap: str) -> DataFrame:
    """Per key and session (arrivals each less than ``gap`` after the one before): rows, start and end."""
    # start and end as aggregates: a filter on the window itself would be applied to rows before they are merged
    return rows.groupBy(*keys, F.session_window("_arrived", gap).alias("session")).agg(
        F.sum("_n").alias("occurrences"), F.min("_arrived").alias("_start"), (F.max("_arrived") + F.expr(f"INTERVAL {gap}")).alias("_end")).drop("session")


def stream_repeated_keys(df: DataFrame, out_dir: str, checkpoint: str, keys=("id",), gap: str = "1 hour",
                         delay: str = "10 minutes", available_now: bool = True, fold_every: int = 100) -> StreamingQuery:
    """Write the repeated keys of every micro-batch (read with ``read_found``): keys
    with more than one row, each less than ``gap`` after the one before, and their
    count, when the watermark has passed the session."""
    keys = [keys] if isinstance(keys, str) else list(keys)

    def found(rows: DataFrame, old: Column, new: Column) -> DataFrame:
        return sessions(rows, keys, gap).where((F.col("occurrences") > 1) & (F.col("_end") > old) & (F.col("_end") <= new)).select(
            *keys, "occurrences")

    def still_open(rows: DataFrame, new: Column) -> DataFrame:
        waits = sessions(rows, keys, gap).where(F.col("_end") > new).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_start", "_end")
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        return rows.join(waits, [*same, F.col("_arrived") >= F.col("_start"), F.col("_arrived") < F.col("_end")], "left_semi")

    def apply(batch: DataFrame, batch_id: int) -> None:
        once = batch.where(F.col("_arrived").isNotNull()).groupBy(*keys, "_arrived").agg(F.count(F.lit(1)).alias("_n"))
        _decide(once, batch_id, checkpoint, out_dir, [F.lit(True)], gap, delay, found, still_open, fold_every)

    return _start(df.select(*keys, "_arrived").writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint), available_now)


def read_found(spark: SparkSession, out_dir: str, schema) -> DataFrame:
    """What the streams above have reported."""
    paths = batches.committed(spark, out_dir)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
