"""Scans, snapshots, CSV/JSON exports, Bronze loads and the full Bronze refresh.

Everything is read and written by executors; the driver only holds plans and
the five-row refresh report.
"""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.scalars import to_api_names, to_api_types, to_storage_names

CSV_TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"


# -- scans ------------------------------------------------------------------

def scan(df: DataFrame, table: str, order: str = "id", api_types: bool = True) -> DataFrame:
    """Full table in the API shape (camelCase, numbers as numbers, ISO
    timestamps), ordered by ``order`` (storage name)."""
    out = df.select(*S.storage_columns(table)).orderBy(order)
    out = to_api_names(out, table)
    return to_api_types(out, table) if api_types else out


def scan_patients(df: DataFrame) -> DataFrame:
    return scan(df, "patients")


def scan_appointments(df: DataFrame) -> DataFrame:
    return scan(df, "appointments")


def scan_doctors(df: DataFrame) -> DataFrame:
    """Doctor register / export: fee as a number, utilization as an int."""
    return scan(df, "doctors")


def scan_departments(df: DataFrame, order: str = "id") -> DataFrame:
    """Departments ordered by id (export) or by name (register)."""
    return scan(df, "departments", order=order)


def scan_transactions(df: DataFrame) -> DataFrame:
    return scan(df, "transactions")


# -- relational snapshot ----------------------------------------------------

#: Keys that are sampled for each part of a split read (bounds what the driver holds).
KEYS_PER_PART = 200


def split_bounds(keys: DataFrame, column: str, parts: int, per_part: int = KEYS_PER_PART) -> list:
    """At most ``parts - 1`` rising values that cut the key column into parts of about
    equal size: quantiles of a random sample of ``parts * per_part`` keys (a fixed
    bound).  Ids are text, so ranges of equal width would not do: their prefixes are
    not spread evenly.  With 200 keys per part the size of a part varies by some 7 %."""
    some = keys.where(F.col(column).isNotNull()).select(F.col(column).alias("k"), F.rand(7).alias("r"))
    sample = sorted(r[0] for r in some.orderBy("r").limit(parts * per_part).select("k").collect())
    cuts = [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else []
    # a key that fills several parts cannot be cut; the part below the first cut may not be empty
    return [c for i, c in enumerate(cuts) if c > (cuts[i - 1] if i else sample[0])]


def split_predicates(bounds: list, column: str, collate: str = "") -> list[str]:
    """Conditions of which every row meets one, rows without the key too.  ``collate``
    (such as ``COLLATE "C"``) is put behind the column where the database orders text
    otherwise than by code points, as ``bounds`` is ordered."""
    def text(v) -> str:
        return "'" + str(v).replace("'", "''") + "'" if not isinstance(v, (int, float)) else str(v)

    col = f"{column} {collate}".strip()
    if not bounds:
        return ["1 = 1"]
    return [f"({col} < {text(bounds[0])} OR {column} IS NULL)",
            *[f"({col} >= {text(a)} AND {col} < {text(b)})" for a, b in zip(bounds, bounds[1:])],
            f"({col} >= {text(bounds[-1])})"]


def jdbc_snapshot(spark: SparkSession, url: str, table: str, columns: list[str],
                  partition_column: str | None = None, lower_bound=None, upper_bound=None,
                  num_partitions: int = 8, predicates: list[str] | None = None,
                  properties: dict | None = None, split_by: str | None = None, sample: str = "",
                  collate: str = "") -> DataFrame:
    """Read one relational table with an explicit column list and no filter.

    ``jdbc:`` URLs use Spark's JDBC source.  A large table is read in parallel
    * by ``split_by``, a key column of any type: its quantiles, from the keys of
      ``SELECT split_by FROM table sample`` (``sample`` is the database's clause, such
      as ``TABLESAMPLE SYSTEM (1)``), become one condition per part,
    * by a list of ``predicates`` (one part each; they must cover every row once),
    * or by ranges of a numeric, date or timestamp ``partition_column`` with both
      bounds; with none of these it is one task.
    Any other URL is read as a Parquet dataset, whose splits are its own; there
    ``split_by`` reads by the same conditions (no database server here)."""
    if not url.startswith("jdbc:"):
        df = spark.read.parquet(url)
        if split_by:
            predicates = split_predicates(split_bounds(df, split_by, num_partitions), split_by)
        if predicates:
            return reduce(DataFrame.unionByName, [df.where(p).select(*columns) for p in predicates])
        return df.select(*columns)
    query = f"(SELECT {', '.join(columns)} FROM {table}) snap"
    if split_by:
        keys = spark.read.jdbc(url, f"(SELECT {split_by} FROM {table} {sample}) keys", properties=properties or {})
        predicates = split_predicates(split_bounds(keys, split_by, num_partitions), split_by, collate)
    if predicates:
        return spark.read.jdbc(url, query, predicates=predicates, properties=properties or {})
    if partition_column is not None and (lower_bound is None or upper_bound is None):
        raise ValueError("partition_column needs lower_bound and upper_bound")
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", query)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column is not None:
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", str(lower_bound)).option("upperBound", str(upper_bound))
                  .option("numPartitions", str(num_partitions)))
    return reader.load()


# -- exports ----------------------------------------------------------------

def csv_frame(df: DataFrame, table: str) -> DataFrame:
    """The exported CSV columns: camelCase, fixed order, money as numbers."""
    out = to_api_names(df.select(*S.storage_columns(table)), table)
    return out.withColumns({f.name: F.col(f.name).cast("double") for f in out.schema.fields
                            if isinstance(f.dataType, T.DecimalType)})


def number_text(col) -> F.Column:
    """A decimal as the shortest number text (150.00 -> 150, 123.40 -> 123.4),
    the way the exported files print numbers; exact, never in E-notation."""
    txt = F.col(col).cast("string") if isinstance(col, str) else col.cast("string")
    return F.regexp_replace(F.regexp_replace(txt, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def csv_text_frame(df: DataFrame, table: str) -> DataFrame:
    """The CSV columns with decimals already rendered as number text."""
    out = to_api_names(df.select(*S.storage_columns(table)), table)
    return out.withColumns({f.name: number_text(f.name) for f in out.schema.fields
                            if isinstance(f.dataType, T.DecimalType)})


#: Text for a missing value, in the one column that has such a mark.
NULL_MARK = {"transactions": ("appointmentId", "NULL")}


def export_csv(df: DataFrame, table: str, path: str, ordered: bool = True, mode: str = "overwrite",
               one_line: bool = False) -> None:
    """CSV with header and fixed column order; values are quoted only when they
    hold a comma, quote or newline, inner quotes doubled; a null appointment id
    is written as NULL, other nulls as nothing, empty text as "" (so all three are
    read back as they were); timestamps as ISO-8601 UTC with milliseconds.

    ``ordered`` sorts by id (a range-partitioned sort).  ``one_line`` writes line
    breaks as \\n and \\r (and a backslash as \\_), so that every record is a line and
    large files can be read in splits; without it they stay inside the quotes."""
    # sorted before the texts are made: the sort's sample pass then reads plain columns
    out = csv_text_frame(df.select(*S.storage_columns(table)).orderBy("id") if ordered else df, table)
    if one_line:
        out = out.withColumns({f.name: _one_line(F.col(f.name)) for f in out.schema.fields if isinstance(f.dataType, T.StringType)})
    if table in NULL_MARK:
        col, mark = NULL_MARK[table]
        out = out.withColumn(col, F.coalesce(F.col(col), F.lit(mark)))
    (out.write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", '""')
     .option("quote", '"').option("escape", '"').option("timestampFormat", CSV_TIMESTAMP)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def export_json(df: DataFrame, table: str, path: str, ordered: bool = True, mode: str = "overwrite",
                compression: str = "none") -> None:
    """JSON lines with every column, explicit nulls included.  ``compression`` ("gzip")
    writes compressed files, of which each is read by one task."""
    out = to_api_types(to_api_names(df.select(*S.storage_columns(table)), table), table)
    if ordered:
        out = out.orderBy("id")
    out.write.mode(mode).option("ignoreNullFields", False).option("compression", compression).json(path)


#: Stands for a quoted empty text while a file is read (the reader would make it
#: null).  It holds a line break, so no value of a line can be equal to it.
_EMPTY = "\u0001\n\u0001"
#: How exports with ``one_line`` write a backslash and line breaks.  Every backslash
#: of the result belongs to one of these pairs, so they can be turned back in any order.
_BREAKS = (("\\", "\\_"), ("\n", "\\n"), ("\r", "\\r"))


def csv_options() -> dict[str, str]:
    return {"nullValue": "", "emptyValue": _EMPTY, "quote": '"', "escape": '"', "mode": "PERMISSIVE",
            "columnNameOfCorruptRecord": "_corrupt"}


def _one_line(col: Column) -> Column:
    for plain, escaped in _BREAKS:
        col = F.replace(col, F.lit(plain), F.lit(escaped))
    return col


def _many_lines(col: Column) -> Column:
    for plain, escaped in reversed(_BREAKS):
        col = F.replace(col, F.lit(escaped), F.lit(plain))
    return col


def parsed_csv(spark: SparkSession, table: str, path: str, multi_line: bool = False, one_line: bool = False,
               stream: bool = False, **options) -> DataFrame:
    """Every record of exported CSV, typed (storage names), with ``file``, ``raw``
    and ``reason``: null, or why the record is no row of the table (wrong number of
    fields, a value that is none of its column's type, an empty line).

    Files are read by lines, so that they can be split; a record with a line break
    inside quotes is then two bad records.  ``multi_line`` reads such records whole
    (a file is one task; ``raw`` is then known only for a wrong number of fields).
    ``one_line`` turns escaped line breaks back (see ``export_csv``).  ``stream``
    reads files as they arrive."""
    names, file = S.api_columns(table), F.col("_metadata.file_path").alias("file")
    strings = T.StructType([T.StructField(c, T.StringType()) for c in [*names, "_corrupt"]])
    reader = (spark.readStream if stream else spark.read).options(**options)
    if multi_line:
        df = reader.schema(strings).options(**csv_options(), header="true", multiLine="true").csv(path).select(
            F.struct(*names).alias("_row"), F.col("_corrupt").alias("raw"), F.col("_corrupt"), file)
    else:
        row = F.from_csv(F.col("value"), ", ".join(f"{c} string" for c in strings.names), csv_options())
        df = reader.text(path).where(F.col("value") != ",".join(names)).select(row.alias("_row"), F.col("value").alias("raw"), file)
        df = df.withColumn("_corrupt", F.when(F.trim("raw") == "", F.lit("")).otherwise(F.col("_row._corrupt")))
    back = dict(zip(names, S.storage_columns(table)))
    texts, values, bad = {}, {}, []
    for f in S.api_schema(table).fields:
        text, value = F.col(f"_row.{f.name}"), f"_text_{f.name}"
        text = F.when(text == _EMPTY, F.lit("")).otherwise(text)
        if table in NULL_MARK and NULL_MARK[table][0] == f.name:
            text = F.nullif(text, F.lit(NULL_MARK[table][1]))
        texts[value], text = text, F.col(value)
        if isinstance(f.dataType, T.StringType):
            values[back[f.name]] = _many_lines(text) if one_line else text
        else:
            values[back[f.name]] = F.try_to_timestamp(text, F.lit(CSV_TIMESTAMP)) if isinstance(f.dataType, T.TimestampType) else text.try_cast(f.dataType)
            bad.append(F.when(text.isNotNull() & F.col(back[f.name]).isNull(), F.lit(f"{f.name} is no {f.dataType.simpleString()}")))
    fields = F.when(F.col("_corrupt") == "", F.lit("empty line")).when(F.col("_corrupt").isNotNull(), F.lit("wrong number of fields"))
    wrong = F.nullif(F.concat_ws("; ", *bad), F.lit("")) if bad else F.lit(None).cast("string")
    # a list of one row: filters on the result stay behind it, else each would parse the line again
    df = df.select(F.inline(F.array(F.struct(*[x.alias(c) for c, x in texts.items()], "file", "raw", "_corrupt"))))
    df = df.select("*", *[x.alias(c) for c, x in values.items()])
    return df.select(F.inline(F.array(F.struct(*values, "file", "raw", F.coalesce(fields, wrong).alias("reason")))))


def read_export_csv(spark: SparkSession, path: str, table: str, multi_line: bool = False, one_line: bool = False) -> DataFrame:
    """Read an exported CSV back with the declared schema (storage names).  A record
    that is no row of the table is an error that names its file and reason; use
    ``load_bronze_csv`` to set such records aside."""
    df = parsed_csv(spark, table, path, multi_line, one_line)
    first = S.storage_columns(table)[0]
    # the check hangs on a column that is needed for every row
    checked = F.when(F.col("reason").isNull(), F.col(first)).otherwise(F.raise_error(F.concat(
        F.lit("bad CSV record in "), F.col("file"), F.lit(": "), F.col("reason"))))
    return df.withColumn(first, checked).where(F.col(first).isNotNull() | F.col("reason").isNull()).select(*S.storage_columns(table))


def read_export_json(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Read exported JSON lines back with the declared schema (storage names)."""
    return to_storage_names(spark.read.schema(S.api_schema(table)).json(path), table)


GOOD, REJECTED = "good", "rejected"
_REJECT_COLUMNS = T.StructType([T.StructField("file", T.StringType()), T.StructField("raw", T.StringType()),
                                T.StructField("reason", T.StringType())])


def batch_schema(table: str) -> T.StructType:
    """Schema of a load's or micro-batch's folder: Bronze columns, and for records
    that were set aside their file, raw text and reason; ``part`` is the folder."""
    return T.StructType([*S.bronze_schema(table).fields, *_REJECT_COLUMNS.fields, T.StructField("part", T.StringType())])


def sorted_out(df: DataFrame, table: str) -> DataFrame:
    """Rows in the form of ``batch_schema``: good rows without file and raw text,
    rejected records without values.  Frames without ``reason`` are all good."""
    names = S.bronze_schema(table).names
    if "reason" not in df.columns:
        df = df.withColumns({c: F.lit(None).cast("string") for c in _REJECT_COLUMNS.names})
    good = F.col("reason").isNull()
    return df.select(*[F.when(good, F.col(f.name).cast(f.dataType)).alias(f.name) for f in S.bronze_schema(table).fields],
                     *[F.when(~good, F.col(c)).alias(c) for c in _REJECT_COLUMNS.names],
                     F.when(good, F.lit(GOOD)).otherwise(F.lit(REJECTED)).alias("part")).select(*names, *_REJECT_COLUMNS.names, "part")


def generation(spark: SparkSession, bronze_dir: str, table: str) -> int:
    """The number of the newest refresh that has begun (0: none).  Loads and streams
    write under it, and readers take the numbers from the newest checked refresh
    on: so what was added before a refresh began is replaced by it, and what came
    later stays, also when that refresh fails."""
    from ..streaming import batches
    begun = batches.matching(spark, f"{bronze_dir.rstrip('/')}/{table}/begun/v=*")
    return max((int(p.rsplit("v=", 1)[1]) for p in begun), default=0)


def add_batch(df: DataFrame, table: str, bronze_dir: str, writer: str, query: str, batch: int) -> bool:
    """Write one load or micro-batch (``sorted_out`` rows) into Bronze; the same
    (query, batch) is written once, whichever generation it is met in."""
    from ..streaming import batches
    base = f"{bronze_dir.rstrip('/')}/{table}/{writer}"
    gen = generation(df.sparkSession, bronze_dir, table)
    return batches.write_batch(df, f"{base}/gen={gen}", query, batch, ["part"], f"{base}/gen=*")


def load_bronze_csv(spark: SparkSession, landing_dir: str, table: str, bronze_dir: str,
                    multi_line: bool = False, one_line: bool = False, load_id: str | None = None) -> DataFrame:
    """Read exported CSV for ``table`` and *append* it to Bronze (typed).  Records
    that are no rows of the table are set aside (``read_rejected``): good and
    rejected records together are the lines of the files.  A load with a
    ``load_id`` is done once; without one every call appends."""
    df = sorted_out(parsed_csv(spark, table, landing_dir, multi_line, one_line), table)
    add_batch(df, table, bronze_dir, "load", load_id or uuid.uuid4().hex, 0)
    return read_bronze_table(spark, bronze_dir, table)


def bronze_schemas() -> dict[str, T.StructType]:
    return {t: S.bronze_schema(t) for t in S.TABLES}


def to_bronze(df: DataFrame, table: str) -> DataFrame:
    """Cast a frame to the typed Bronze definition (column order fixed)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.bronze_schema(table).fields])


REPORT_SCHEMA = T.StructType([
    T.StructField("table", T.StringType()), T.StructField("success", T.BooleanType()),
    T.StructField("rows", T.LongType()), T.StructField("duration_ms", T.LongType()),
    T.StructField("error", T.StringType()), T.StructField("finished_at", T.TimestampType()),
])
CHECKED = "_CHECKED"


def bronze_full_refresh(spark: SparkSession, sources: dict[str, DataFrame], out_dir: str,
                        parallel: int = 5, partition_by: dict[str, list[str]] | None = None,
                        sort_by_time: bool = False, max_records_per_file: int | None = None,
                        cluster: str = "sort", keep: int = 2) -> DataFrame:
    """Truncate-and-reload every Bronze table.  Tables load concurrently; one
    table's failure does not stop the others and leaves its last good rows.

    The new rows go to ``<table>/refresh/v=<number>`` (the start in ms, at least one
    above any earlier number).  The rows read back must
    equal the source rows, which an ``Observation`` counts in the pass that writes
    them; only then is the folder marked as checked, and readers take the newest
    checked one.  ``keep`` checked folders stay; older ones, and those of refreshes
    that failed, are removed.
    ``sort_by_time`` sorts rows of tables with a time column by that column inside
    each file; ``cluster="range"`` also range-partitions them by it (one time range
    per file)."""
    from pyspark.sql import Observation

    from ..streaming import batches

    def one(name: str):
        t0 = time.time()
        table_dir = f"{out_dir.rstrip('/')}/{name}/refresh"
        number = max(int(t0 * 1000), generation(spark, out_dir, name) + 1)
        path = f"{table_dir}/v={number}"
        done = lambda: datetime.now(timezone.utc).replace(tzinfo=None)
        try:
            batches.put(spark, f"{out_dir.rstrip('/')}/{name}/begun/v={number}")
            obs = Observation(f"bronze_{name}")
            df = to_bronze(sources[name], name)
            ts = S.TIMESTAMP_COLUMNS.get(name) or []
            if sort_by_time and ts:
                if cluster == "range":
                    # global clustering: each file holds one time range, so time
                    # filters skip whole files (costs a sampling pass + a shuffle)
                    df = df.repartitionByRange(ts[0])
                # rows sorted by time inside every file: tight row-group min/max
                # statistics, so time filters skip row groups (no shuffle)
                df = df.sortWithinPartitions(ts[0])
            # observed last, so the range-boundary sampling pass is not counted
            df = df.observe(obs, F.count(F.lit(1)).alias("rows"))
            w = df.write.mode("overwrite")
            if max_records_per_file:
                w = w.option("maxRecordsPerFile", max_records_per_file)
            if partition_by and partition_by.get(name):
                w = w.partitionBy(*partition_by[name])
            w.parquet(path)
            src_rows = obs.get["rows"]
            rows = spark.read.schema(S.bronze_schema(name)).parquet(path).count()
            ok = rows == src_rows
            err = None if ok else f"wrote {rows} rows, source has {src_rows}"
            if ok:
                batches.put(spark, f"{path}/{CHECKED}")
                checked = [p[: -len(CHECKED) - 1] for p in batches.matching(spark, f"{table_dir}/v=*/{CHECKED}")]
                # older refreshes that failed or were never checked go too, and the begun marks they left
                old = [p for p in batches.matching(spark, f"{table_dir}/v=*") if int(p.rsplit("v=", 1)[1]) < number
                       and p not in checked[-max(1, keep):]]
                batches.remove(spark, old)
            return (f"bronze_{name}", ok, rows, int((time.time() - t0) * 1000), err, done())
        except Exception as e:  # noqa: BLE001 - the report carries the error
            return (f"bronze_{name}", False, 0, int((time.time() - t0) * 1000), str(e), done())

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        rows = list(pool.map(one, list(sources)))
    return spark.createDataFrame(rows, REPORT_SCHEMA)


def write_bronze(df: DataFrame, table: str, path: str, mode: str = "overwrite",
                 month_partitions: bool = False, max_records_per_file: int | None = None) -> None:
    """Write a Bronze table with a scan-friendly layout: rows sorted within each
    file by the table's time column (tight Parquet min/max statistics, so date
    filters skip row groups), optionally partitioned by month of that column
    (month filters prune whole folders).  No global sort, no extra shuffle."""
    out = to_bronze(df, table)
    ts = S.TIMESTAMP_COLUMNS.get(table) or []
    w_df = out
    if ts:
        if month_partitions:
            w_df = w_df.withColumn("month", F.date_format(ts[0], "yyyy-MM"))
        w_df = w_df.sortWithinPartitions(*(["month"] if month_partitions else []), ts[0])
    w = w_df.write.mode(mode)
    if max_records_per_file:
        # splits a large task's output into several files (later scans read them
        # in parallel) without a shuffle
        w = w.option("maxRecordsPerFile", max_records_per_file)
    if ts and month_partitions:
        w = w.partitionBy("month")
    w.parquet(path)


def _batch_folders(spark: SparkSession, bronze_dir: str, table: str, since: int, part: str) -> list[str]:
    """Folders with the good or the rejected rows of loads and micro-batches."""
    from ..streaming import batches
    found = []
    for writer in ("load", "stream"):
        for gen in batches.matching(spark, f"{bronze_dir.rstrip('/')}/{table}/{writer}/*"):
            if "/gen=" not in gen:
                raise RuntimeError(f"no folder of a load or stream: {gen}")
            if int(gen.rsplit("gen=", 1)[1]) >= since:
                there = set(batches.matching(spark, f"{gen}/query=*/batch=*/part={part}"))
                found += [p for p in (f"{b}/part={part}" for b in batches.committed(spark, gen)) if p in there]
    return found


def _begun(spark: SparkSession, bronze_dir: str, table: str) -> bool:
    from ..streaming import batches
    return any(batches.exists(spark, f"{bronze_dir.rstrip('/')}/{table}/{writer}") for writer in ("load", "stream"))


def _newest_refresh(spark: SparkSession, bronze_dir: str, table: str) -> str | None:
    from ..streaming import batches
    checked = batches.matching(spark, f"{bronze_dir.rstrip('/')}/{table}/refresh/v=*/{CHECKED}")
    return max((p[: -len(CHECKED) - 1] for p in checked), key=lambda p: int(p.rsplit("v=", 1)[1]), default=None)


def read_bronze_table(spark: SparkSession, bronze_dir: str, table: str) -> DataFrame | None:
    """One Bronze table: the newest checked refresh and what batch loads (``load``)
    and streams (``stream``) have added since it began (see ``generation``: by the
    names of the folders, so a copy or a restored table reads the same); None when
    nothing was ever written."""
    schema, parts = S.bronze_schema(table), []
    refresh = _newest_refresh(spark, bronze_dir, table)
    if refresh:
        parts.append(spark.read.schema(schema).parquet(refresh))
    folders = _batch_folders(spark, bronze_dir, table, int(refresh.rsplit("v=", 1)[1]) if refresh else 0, GOOD)
    if folders:
        parts.append(spark.read.schema(schema).parquet(*folders))
    elif not parts and _begun(spark, bronze_dir, table):
        parts.append(spark.createDataFrame([], schema))  # written, but nothing was good
    return reduce(DataFrame.unionByName, parts) if parts else None


def read_rejected(spark: SparkSession, bronze_dir: str, table: str) -> DataFrame:
    """Records that loads and streams have set aside, of all generations: file, raw
    text and reason."""
    folders = _batch_folders(spark, bronze_dir, table, 0, REJECTED)
    return spark.read.schema(_REJECT_COLUMNS).parquet(*folders) if folders else spark.createDataFrame([], _REJECT_COLUMNS)


def read_bronze(spark: SparkSession, bronze_dir: str, tables=S.TABLES) -> dict[str, DataFrame]:
    """The Bronze tables under ``bronze_dir``; those never written are left out, any
    other failure is raised."""
    found = {t: read_bronze_table(spark, bronze_dir, t) for t in tables}
    return {t: df for t, df in found.items() if df is not None}
