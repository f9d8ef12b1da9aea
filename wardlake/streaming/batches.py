"""Folders of micro-batches: ``<base>/query=<id>/batch=<n>``.

A micro-batch writes only its own folder and then a mark of its own (``MARK``), the
commit; nothing depends on marks of Spark's committers, which a cluster may switch
off.  A folder that has its mark is never touched again, so a replay is harmless
and no reader misses rows while it runs.  A new checkpoint is a new query id, so its
batches cannot meet those of another.  Readers take the marked folders; a folder
that lacks its mark although a later batch of its query has one is an error (its
mark was lost), and so is any storage error: neither is read as "no data yet".

``fold`` puts many folders into one.  The new folder lists what it covers, so it
takes effect in the moment of its mark; what it covers is removed by the next fold,
not at once, so a reader that has just listed the old folders can finish.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import setting

MARK = "_COMMITTED"
COVERS = "_COVERS"
FOLDED = "query=folded"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern, sorted."""
    fs, p = _fs(spark, pattern)
    return sorted(str(s.getPath()) for s in (fs.globStatus(p) or []))


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        fs, p = _fs(spark, path)
        fs.delete(p, True)


def put(spark: SparkSession, path: str, content: bytes = b"") -> None:
    """Write a small file."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(content))
    out.close()


def get(spark: SparkSession, path: str) -> bytes:
    """Content of a small file."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the streaming query that owns a checkpoint (Spark writes it when
    the query first starts and keeps it over restarts)."""
    row = spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()
    return json.loads(row[0])["id"]


def _number(path: str) -> int:
    return int(path.rsplit("batch=", 1)[1])


def _name(path: str) -> str:
    """query=<id>/batch=<n> of a batch folder."""
    return "/".join(path.rstrip("/").rsplit("/", 2)[1:])


def _write(df: DataFrame, path: str, partition_by) -> None:
    w = df.write.mode("overwrite").option("compression", "zstd")
    if not partition_by:
        return w.parquet(path)
    # a few partitions are written side by side; else every task would sort its rows first
    with setting(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", "4"):
        w.partitionBy(*partition_by).parquet(path)


def write_batch(df: DataFrame, base: str, query: str, batch: int, partition_by=(), anywhere: str | None = None) -> bool:
    """Write a batch and its mark; False when it is committed already (also under
    another base that matches ``anywhere``), which leaves it alone."""
    spark, base, own = df.sparkSession, base.rstrip("/"), f"query={query}/batch={batch}"
    if matching(spark, f"{(anywhere or base).rstrip('/')}/{own}/{MARK}"):
        return False
    _write(df, f"{base}/{own}", partition_by)
    put(spark, f"{base}/{own}/{MARK}")
    return True


def _marked(spark: SparkSession, base: str) -> tuple[list[str], dict[str, set[str]]]:
    """The marked folders, and by folded folder the names of what it covers."""
    base = base.rstrip("/")
    marked = [p[: -len(MARK) - 1] for p in matching(spark, f"{base}/query=*/batch=*/{MARK}")]
    newest: dict[str, int] = {}
    for p in marked:
        q = _name(p).split("/")[0]
        newest[q] = max(_number(p), newest.get(q, -1))
    lost = [p for p in matching(spark, f"{base}/query=*/batch=*") if p not in set(marked)
            and not _name(p).startswith(FOLDED) and _number(p) < newest.get(_name(p).split("/")[0], -1)]
    if lost:
        raise RuntimeError(f"batch folders without their mark, though later batches have one: {lost[:3]}")
    covers = {p: set(get(spark, f"{p}/{COVERS}").decode().split("\n")) for p in marked if _name(p).startswith(FOLDED)}
    return marked, covers


def committed(spark: SparkSession, base: str) -> list[str]:
    """Committed batch folders that no folded one covers (bounded by the number of
    micro-batches since the last fold)."""
    marked, covers = _marked(spark, base)
    covered = set().union(*covers.values())
    return [p for p in marked if _name(p) not in covered]


def latest(spark: SparkSession, base: str) -> str | None:
    """The folder of the highest committed batch."""
    paths = committed(spark, base)
    return max(paths, key=_number) if paths else None


def fold(spark: SparkSession, base: str, schema, combine: Callable[[DataFrame], DataFrame] = lambda df: df,
         keep_last: bool = True, partition_by=()) -> bool:
    """Put the committed folders into one (``combine`` may reduce their rows).
    ``keep_last`` leaves out the newest batch of every query, so that its replay is
    recognised; without it rows must bear to be read twice.  One caller at a time; a
    crash in between leaves the old folders in force."""
    base = base.rstrip("/")
    marked, covers = _marked(spark, base)
    covered = set().union(*covers.values())
    live = [p for p in marked if _name(p) not in covered]
    last = {_name(p).split("/")[0]: p for p in sorted(live, key=_number)}
    old = [p for p in live if not keep_last or _name(p).startswith(FOLDED) or last[_name(p).split("/")[0]] != p]
    if len(old) < 2:
        return False
    number = max([int(time.time() * 1000), *[_number(p) + 1 for p in old if _name(p).startswith(FOLDED)]])
    path = f"{base}/{FOLDED}/batch={number}"
    # with one base path, folders of the batches' own partitions do not clash
    rows = spark.read.schema(schema).option("basePath", base).parquet(*old).drop("query", "batch")
    _write(combine(rows), path, partition_by)
    put(spark, f"{path}/{COVERS}", "\n".join(map(_name, old)).encode())
    put(spark, f"{path}/{MARK}")
    # what earlier folds cover has had no readers since; unmarked folds are leftovers of a crash
    remove(spark, [p for p in marked if _name(p) in covered])
    known = {*marked, path}
    remove(spark, [p for p in matching(spark, f"{base}/{FOLDED}/batch=*")
                   if _number(p) < number and _name(p) not in {_name(k) for k in known}])
    return True
