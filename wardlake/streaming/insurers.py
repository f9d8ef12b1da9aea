"""The Gold insurance view kept current as charges and patient rows arrive.

Known per patient: the insurer, and the number and sum of the charges so far.  A
charge adds to its patient's insurer; a patient row with another insurer takes the
patient's whole sum from the old insurer and gives it to the new one; charges whose
patient has not come yet wait.  A micro-batch stores what it adds per patient in a
folder of its own beside the checkpoint; what is known is one aggregate per patient
over these folders (folded now and then), formed only for the patients that the
micro-batch names.  What changes for them goes out as differences per insurer, and
the view is the sum of all differences (folded too).

A patient with very many charges is no hot key: each task first sums up the charges
of a patient, and only the sums are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from . import batches
from .incremental import _start

DELTA_SCHEMA = "insurance_provider string, n bigint, cents bigint"
PATIENT_SCHEMA = "patient_id string, insurer string, version bigint, n bigint, cents bigint"


def per_patient(rows: DataFrame, of=lambda c: c, name: str = "") -> tuple:
    """Aggregates of ``rows`` (as PATIENT_SCHEMA): the newest (version, insurer), count and cents."""
    last = F.max(of(F.when(F.col("version").isNotNull(), F.struct("version", "insurer"))))
    return (last.alias(f"{name}last"), F.coalesce(F.sum(of(F.col("n"))), F.lit(0)).alias(f"{name}n"),
            F.coalesce(F.sum(of(F.col("cents"))), F.lit(0)).alias(f"{name}cents"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("patient_id").agg(*per_patient(rows)).select("patient_id", "last.insurer", "last.version", "n", "cents")


def differences(known: DataFrame, added: DataFrame) -> DataFrame:
    """Differences per insurer when ``added`` (one row per patient) comes to ``known``."""
    old = known.join(added.select("patient_id"), "patient_id", "left_semi")
    rows = old.withColumn("_old", F.lit(True)).unionByName(added.withColumn("_old", F.lit(False)))
    both = rows.groupBy("patient_id").agg(*per_patient(rows, lambda c: F.when(F.col("_old"), c), "was_"), *per_patient(rows))
    one = lambda p, sign: F.struct(F.col(f"{p}last.insurer").alias("insurance_provider"), (F.col(f"{p}n") * sign).alias("n"),
                                   (F.col(f"{p}cents") * sign).alias("cents"))
    return _total(both.select(F.inline(F.array(one("was_", -1), one("", 1)))).where("insurance_provider is not null"))


def stream_insurance_utilization(charges: DataFrame, patients: DataFrame, out_dir: str, checkpoint: str,
                                 version: str = "version", available_now: bool = True, fold_every: int = 100) -> StreamingQuery:
    """``charges``: a stream of charge rows (amounts with two decimals), each row
    once.  ``patients``: a stream of patient rows (id, insurance_provider and a number
    ``version`` that grows with every change; of equal numbers the greater name
    counts)."""
    none, cents = F.lit(None), (F.coalesce("amount", F.lit(0)) * 100).cast("bigint").alias("cents")
    rows = charges.where("patient_id is not null").select(
        "patient_id", none.cast("string").alias("insurer"), none.cast("bigint").alias("version"),
        F.lit(1).cast("bigint").alias("n"), cents).unionByName(
        patients.where("id is not null and insurance_provider is not null").select(
            F.col("id").alias("patient_id"), F.col("insurance_provider").alias("insurer"),
            F.col(version).cast("bigint").alias("version"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("cents")))
    store = f"{checkpoint.rstrip('/')}/patients"

    def apply(df: DataFrame, batch_id: int) -> None:
        s, query = df.sparkSession, batches.query_id(df.sparkSession, checkpoint)
        batches.write_batch(_summed(df), store, query, batch_id)
        own = f"query={query}/batch={batch_id}"
        read = s.read.schema(PATIENT_SCHEMA)
        before = [p for p in batches.committed(s, store) if not p.rstrip("/").endswith(own)]
        known = read.parquet(*before) if before else s.createDataFrame([], PATIENT_SCHEMA)
        batches.write_batch(differences(known, read.parquet(f"{store}/{own}")), out_dir, query, batch_id)
        if batch_id % fold_every == fold_every - 1:
            batches.fold(s, out_dir, DELTA_SCHEMA, _total)
            batches.fold(s, store, PATIENT_SCHEMA, _summed)

    return _start(rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint), available_now)


def _total(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("insurance_provider").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents")).where("n <> 0 or cents <> 0")


def read_insurance_utilization(spark: SparkSession, out_dir: str) -> DataFrame:
    """The view as of the last micro-batch, in the form of the batch operator."""
    paths = batches.committed(spark, out_dir)
    found = spark.read.schema(DELTA_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], DELTA_SCHEMA)
    return _total(found).where("n <> 0").select("insurance_provider", F.col("n").alias("count"),
                                                (F.col("cents").cast("decimal(20,0)") / 100).cast("double").alias("total_revenue"))
