"""Session helpers: build a session for tests/bench, pin UTC, find the shared
checkpoint folder.

On a cluster the session is created by the platform; the library only reads its
settings.  ``checkpoint_dir`` reads ``spark.checkpoint.dir`` and only invents a
folder when that setting is unset (local tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that matter for every plan in this library.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # concurrent table loads share the cores instead of queueing behind the largest
    "spark.scheduler.mode": "FAIR",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "wardlake", extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench (the cluster brings its own)."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(SESSION_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_utc(spark)
    return spark


def ensure_utc(spark: SparkSession) -> None:
    """All timestamps in this library are UTC wall-clock (ISO text ends in Z)."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A session setting for the time of a block; then it is as it was."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def dropping_shuffles(spark: SparkSession):
    """The shuffle files of a query that is planned in the block go as it ends; else
    they stay until the driver happens to collect its garbage."""
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Uses the cluster's ``spark.checkpoint.dir``; sets a scratch folder only when
    it is unset and the session is local (tests); on a cluster an unset folder
    is an error, never a machine-local fallback."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not (sc.master or "").startswith("local"):
        # a machine-local folder is invisible to other executors
        raise RuntimeError("spark.checkpoint.dir is not set: point it at a folder shared by the cluster")
    path = tempfile.mkdtemp(prefix="wardlake-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A per-use folder under the shared checkpoint folder (see ``clear_scratch``)."""
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder on any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear_scratch(spark: SparkSession) -> None:
    """Remove the intermediate tables that this process has staged.  Lazy results
    that still read them must have been written before."""
    while _SCRATCH:
        remove_path(spark, _SCRATCH.pop())


def input_bytes(spark: SparkSession, *paths: str) -> int:
    """Bytes of files and folders on any file system that Spark reads."""
    found = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength() for p in found)


def scale_conf(input_bytes: int, total_cores: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings sized for a run over ``input_bytes`` of Parquet on
    ``total_cores`` executor cores.

    Scan splits and post-shuffle partitions target ``partition_bytes`` (fits an
    executor task's memory with room for sort/aggregate buffers); the initial
    shuffle partition count covers the input at that size (AQE coalesces small
    ones and splits skewed ones at run time).  The planner's broadcast limit
    stays small: dimensions beyond it are joined by sort-merge."""
    parts = max(2 * total_cores, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.session.timeZone": "UTC",
    }


def apply_conf(spark: SparkSession, conf: dict[str, str]) -> None:
    """Apply the runtime-settable entries of ``conf`` to a running session."""
    for k, v in conf.items():
        if spark.conf.isModifiable(k):
            spark.conf.set(k, v)
