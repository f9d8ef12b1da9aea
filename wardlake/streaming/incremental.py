"""Incremental Bronze append and Silver upsert on Structured Streaming.

* ``stream_bronze_append``: new landing files -> typed Bronze rows, one folder per
  micro-batch (see ``batches``) under the generation of the newest refresh; CSV
  records that do not parse are set aside; optionally rows that arrive again within
  a bound are dropped.
* ``stream_silver_upsert``: each micro-batch of Bronze transactions passes the
  Silver rule, is reduced to its newest row per id and written to a folder of its
  own.  The current Silver is one aggregate per id over all committed folders: the
  columns a MERGE never changes come from the earliest arrival, the update columns
  from the newest date (equal dates: the earlier arrival; a stored null date is kept,
  an incoming null date is never newer).  That equals applying the MERGE batch by
  batch, needs no state besides the folders, and is the same when a batch is
  replayed or read twice.
* ``compact_silver`` writes the current rows as one more folder and removes the
  ones it covers; the aggregate is idempotent, so a crash in between is harmless.
* ``stream_pipeline_counts`` / ``stream_gold_dept_totals``: running aggregates in
  complete mode; every batch writes the whole (small) result.
"""

from __future__ import annotations

from contextlib import ExitStack
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schemas as S
from ..operators.quality import SILVER_RULES, dedupe_latest
from ..operators.upsert import dedupe_first
from ..session import setting
from ..sources import tables
from . import batches

UPDATE_COLUMNS = ("amount", "insurance_coverage", "payment_type", "date")


#: Micro-batch folders after which a stream puts them into one.
FOLD_EVERY = 100


def bronze_stream(spark: SparkSession, landing_dir: str, table: str, fmt: str = "parquet",
                  api_names: bool = False, max_files_per_trigger: int | None = None, multi_line: bool = False,
                  one_line: bool = False, keep_bad: bool = False, arrival: bool = False) -> DataFrame:
    """Streaming read of landing files for ``table`` with the declared schema.
    ``fmt="csv"`` reads exported CSV (see ``tables.parsed_csv``); records that do not
    parse are left out unless ``keep_bad`` adds the columns file, raw and reason.
    ``arrival`` adds ``_arrived``, the time of the landing file."""
    options = {"maxFilesPerTrigger": max_files_per_trigger} if max_files_per_trigger else {}
    if fmt == "csv":
        df = tables.parsed_csv(spark, table, landing_dir, multi_line, one_line, stream=True, **options)
        return df if keep_bad else df.where("reason is null").select(*S.bronze_schema(table).names)
    schema = S.api_schema(table) if api_names else S.bronze_schema(table)
    df = spark.readStream.schema(schema).format(fmt).options(**options).load(landing_dir)
    arrived = [F.col("_metadata.file_modification_time").alias("_arrived")] if arrival else []
    names = S.API_NAMES[table] if api_names else {}
    return df.select(*[F.col(names.get(f.name, f.name)).cast(f.dataType).alias(f.name) for f in S.bronze_schema(table).fields],
                     *arrived)


def _start(writer, available_now: bool) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


#: State on local disk with a bounded cache, not on the heap: keys grow with the input.
STATE_STORE = {"providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
               "rocksdb.boundedMemoryUsage": "true", "rocksdb.changelogCheckpointing.enabled": "true",
               "rocksdb.trackTotalNumberOfRows": "false"}


def with_state_store(spark: SparkSession, start, counted: bool = True):
    """Start a query on the RocksDB state store; the session's own settings stay as
    they are.  Without ``counted`` rows of the state are not counted, which saves a
    lookup for every write."""
    with ExitStack() as settings:
        for name, value in STATE_STORE.items():
            if not (counted and name.endswith("NumberOfRows")):
                settings.enter_context(setting(spark, f"spark.sql.streaming.stateStore.{name}", value))
        return start()


def stream_bronze_append(spark: SparkSession, landing_dir: str, table: str, bronze_dir: str,
                         checkpoint: str, fmt: str = "parquet", api_names: bool = False,
                         available_now: bool = True, max_files_per_trigger: int | None = None,
                         multi_line: bool = False, one_line: bool = False, once_within: str | None = None, keys=("id",),
                         source: DataFrame | None = None, fold_every: int = FOLD_EVERY, count_state: bool = True) -> StreamingQuery:
    """Pick up new landing files and append them to Bronze, each file once (the
    checkpoint's log) and each micro-batch once (its folder).

    ``once_within`` ("1 day") also drops rows whose key has arrived before within
    that time: a landing file that is delivered again adds no row.  The state holds
    the keys of that time only; arrival is the landing file's time, or ``_arrived``
    of ``source``, a streaming frame that is then read instead of the folder.  The
    query's progress tells the rows of the state, unless ``count_state`` is off, which
    saves a lookup for every key."""
    if once_within and fmt == "csv" and source is None:
        raise ValueError("arrival times are read from Parquet and JSON landing files")
    df = source if source is not None else bronze_stream(
        spark, landing_dir, table, fmt, api_names, max_files_per_trigger, multi_line, one_line, keep_bad=fmt == "csv",
        arrival=bool(once_within))
    if once_within:
        df = df.withWatermark("_arrived", once_within).dropDuplicatesWithinWatermark(list(keys))
    df = tables.sorted_out(df, table)

    def apply(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        tables.add_batch(batch, table, bronze_dir, "stream", batches.query_id(s, checkpoint), batch_id)
        if batch_id % fold_every == fold_every - 1:
            gen = tables.generation(s, bronze_dir, table)
            batches.fold(s, f"{bronze_dir.rstrip('/')}/{table}/stream/gen={gen}", tables.batch_schema(table), partition_by=["part"])

    def start() -> StreamingQuery:
        return _start(df.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint), available_now)

    return with_state_store(spark, start, count_state) if once_within else start()


def _stored_schema(table: str) -> T.StructType:
    return T.StructType([*S.bronze_schema(table).fields, T.StructField("_arrived", T.TimestampType())])


def silver_upsert_batch(spark: SparkSession, batch: DataFrame, batch_id: int, silver_dir: str,
                        table: str = "transactions", order_col: str = "date", keys=("id",),
                        op: str = "merge", apply_rule: bool = True, query: str = "batch") -> None:
    """Store one batch of changes: Silver rule, one row per key, arrival time.

    The same (query, batch_id) overwrites the same folder.  ``op="merge"`` keeps a
    key's newest row, ``"insert_ignore"`` its earliest (read with the same op);
    ``apply_rule=False`` skips the Silver rule (for non-Silver tables)."""
    rule = SILVER_RULES.get(table) if apply_rule else None
    clean = (batch.where(rule()) if rule else batch).select(*S.bronze_schema(table).names)
    one = dedupe_first if op == "insert_ignore" else dedupe_latest
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    arrived = F.lit(now.isoformat(sep=" ")).cast("timestamp")
    batches.write_batch(one(clean, list(keys), order_col).withColumn("_arrived", arrived), silver_dir, query, batch_id)


def _stored(spark: SparkSession, silver_dir: str, table: str) -> DataFrame:
    paths = batches.committed(spark, silver_dir)
    if not paths:
        return spark.createDataFrame([], _stored_schema(table))
    return spark.read.schema(_stored_schema(table)).parquet(*paths)


def _current(stored: DataFrame, table: str, order_col: str, keys, update_cols) -> DataFrame:
    """One row per key, with the arrival of its first row: a min and a max over
    structs.  A folder holds a key once, so nothing could be summed up before the
    shuffle: the rows are dealt as they are, not as three structs."""
    stored = stored.repartition(*keys)
    fixed = [c for c in S.storage_columns(table) if c not in keys and c not in update_cols]
    first = F.min(F.struct("_arrived", *fixed)).alias("f")
    if not update_cols:
        return stored.groupBy(*keys).agg(first).select(*keys, "f.*")
    rest = [c for c in update_cols if c != order_col]
    # of equal dates the earlier arrival is the greater struct
    early = (-F.unix_micros("_arrived")).alias("_early")
    newest = F.max(F.struct(F.col(order_col), early, *rest)).alias("u")
    # a MERGE compares dates: a row that was stored without one is never older
    stays = F.min(F.struct(F.col("_arrived"), F.col(order_col), *rest)).alias("s")
    undated = F.col(f"s.{order_col}").isNull()
    return stored.groupBy(*keys).agg(first, newest, stays).select(*keys, "f.*", *[
        F.when(undated, F.col(f"s.{c}")).otherwise(F.col(f"u.{c}")).alias(c) for c in (order_col, *rest)])


def read_silver(spark: SparkSession, silver_dir: str, table: str = "transactions", order_col: str = "date",
                keys=("id",), update_cols=UPDATE_COLUMNS, op: str = "merge") -> DataFrame:
    """The current Silver table over all committed batches."""
    cols = () if op == "insert_ignore" else tuple(update_cols)
    return _current(_stored(spark, silver_dir, table), table, order_col, list(keys), cols).select(
        *S.storage_columns(table))


def compact_silver(spark: SparkSession, silver_dir: str, table: str = "transactions", order_col: str = "date",
                   keys=("id",), update_cols=UPDATE_COLUMNS, op: str = "merge") -> None:
    """Write the current rows as one folder in place of those they come from."""
    cols = () if op == "insert_ignore" else tuple(update_cols)
    batches.fold(spark, silver_dir, _stored_schema(table), lambda stored: _current(
        stored, table, order_col, list(keys), cols).select(*_stored_schema(table).names), keep_last=False)


def stream_silver_upsert(spark: SparkSession, bronze_source: DataFrame, silver_dir: str, checkpoint: str,
                         table: str = "transactions", available_now: bool = True, **kw) -> StreamingQuery:
    """foreachBatch upsert of a streaming Bronze source into Silver."""
    def apply(df: DataFrame, batch_id: int) -> None:
        s = df.sparkSession
        silver_upsert_batch(s, df, batch_id, silver_dir, table, query=batches.query_id(s, checkpoint), **kw)

    return _start(bronze_source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint), available_now)


def _complete_sink(agg: DataFrame, out_dir: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    """Write the whole result of a running aggregate with every micro-batch and
    keep the last two."""
    def apply(df: DataFrame, batch_id: int) -> None:
        s = df.sparkSession
        query = batches.query_id(s, checkpoint)
        batches.write_batch(df, out_dir, query, batch_id)
        old = [p for p in batches.committed(s, out_dir) if f"query={query}/" in p
               and int(p.rsplit("batch=", 1)[1]) < batch_id - 1]
        batches.remove(s, old)

    return _start(agg.writeStream.outputMode("complete").foreachBatch(apply).option("checkpointLocation", checkpoint), available_now)


def read_complete(spark: SparkSession, out_dir: str, schema: str) -> DataFrame:
    """The newest result of a running aggregate (empty before the first batch)."""
    path = batches.latest(spark, out_dir)
    return spark.createDataFrame([], schema) if path is None else spark.read.schema(schema).parquet(path)


COUNTS_SCHEMA = "table string, rows bigint"
DEPT_TOTALS_SCHEMA = "department string, total_revenue decimal(20,2), transaction_count bigint"


def stream_pipeline_counts(streams: dict[str, DataFrame], out_dir: str, checkpoint: str,
                           available_now: bool = True) -> StreamingQuery:
    """Running row counts per table (read with ``read_complete``)."""
    tagged = None
    for name, df in streams.items():
        t = df.select(F.lit(name).alias("table"))
        tagged = t if tagged is None else tagged.unionByName(t)
    return _complete_sink(tagged.groupBy("table").agg(F.count(F.lit(1)).alias("rows")), out_dir, checkpoint, available_now)


def stream_gold_dept_totals(bronze_tx: DataFrame, out_dir: str, checkpoint: str,
                            available_now: bool = True) -> StreamingQuery:
    """The Gold department summary kept current as charges arrive: a stateful
    streaming aggregation (state = one row per department)."""
    agg = bronze_tx.groupBy("department").agg(F.sum("amount").cast("decimal(20,2)").alias("total_revenue"),
                                               F.count(F.lit(1)).alias("transaction_count"))
    return _complete_sink(agg, out_dir, checkpoint, available_now)
