"""Monthly growth history: cumulative patients / appointments / transactions per
month, the latest 12 months.

Batch form: three monthly counts (partial aggregation; at most one row per
month each) are folded into one table and turned into running totals.  The
running window sees only the month rows -- a calendar-bounded handful -- never
the fact rows.  Stream form: every micro-batch stores its own counts, and the
history is their running sum.  ``update_growth_history`` upserts one month's totals
into a kept history.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import month_bucket

COUNT_COLUMNS = ("patientsCount", "appointmentsCount", "transactionsCount")
KEEP_MONTHS = 12


def _monthly(df: DataFrame, ts: str, target: str) -> DataFrame:
    counts = (df.where(F.col(ts).isNotNull()).groupBy(month_bucket(ts).alias("timestamp"))
              .agg(F.count(F.lit(1)).alias("_n")))
    return counts.select("timestamp", *[(F.col("_n") if c == target else F.lit(0).cast("bigint")).alias(c)
                                        for c in COUNT_COLUMNS])


def growth_history(pt: DataFrame, ap: DataFrame, tx: DataFrame, months: int = KEEP_MONTHS,
                   pt_ts: str = "registration_date", ap_ts: str = "appointment_date",
                   tx_ts: str = "date") -> DataFrame:
    """Per month: rows registered up to the end of that month in each table; the
    last ``months`` months, oldest first."""
    parts = [_monthly(pt, pt_ts, "patientsCount"), _monthly(ap, ap_ts, "appointmentsCount"),
             _monthly(tx, tx_ts, "transactionsCount")]
    return _running(per_month(reduce(DataFrame.unionByName, parts)), months)


def _running(per_month: DataFrame, months: int) -> DataFrame:
    """Running totals over month rows; the window sees one row per month."""
    running = Window.orderBy("timestamp").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = per_month.select("timestamp", *[F.sum(c).over(running).cast("bigint").alias(c) for c in COUNT_COLUMNS])
    return cum.orderBy(F.col("timestamp").desc()).limit(months).orderBy("timestamp")


def update_growth_history(history: DataFrame, month: str, counts: DataFrame,
                          months: int = KEEP_MONTHS) -> DataFrame:
    """Upsert one month's totals into the history (replace the month if present,
    else append) and keep the latest ``months`` months.  ``counts`` is a one-row
    frame with the three count columns."""
    cur = counts.select(F.lit(month).alias("timestamp"), *[F.col(c).cast("bigint").alias(c) for c in COUNT_COLUMNS])
    kept = history.where(F.col("timestamp") != F.lit(month)).select("timestamp", *COUNT_COLUMNS)
    return kept.unionByName(cur).orderBy(F.col("timestamp").desc()).limit(months).orderBy("timestamp")


HISTORY_SCHEMA = "timestamp string, patientsCount bigint, appointmentsCount bigint, transactionsCount bigint"


def per_month(counts: DataFrame) -> DataFrame:
    return counts.groupBy("timestamp").agg(*[F.sum(c).alias(c) for c in COUNT_COLUMNS])


def stream_growth_history(spark, streams: dict, history_dir: str, checkpoint: str,
                          month: str | None = None, available_now: bool = True, fold_every: int = 100):
    """Keep the growth history current as rows arrive.

    ``streams`` maps 'patients' / 'appointments' / 'transactions' to streaming
    frames of new rows.  Each micro-batch counts its rows per table (one small
    aggregate) and writes them, with the month, to a folder of its own; the history
    is the running sum over all committed batches, so there is no state to lose.
    Every ``fold_every`` batches the folders are put into one, summed by month."""
    from . import batches

    col_of = {"patients": "patientsCount", "appointments": "appointmentsCount",
              "transactions": "transactionsCount"}
    tagged = None
    for name, df in streams.items():
        t = df.select(F.lit(col_of[name]).alias("counter"))
        tagged = t if tagged is None else tagged.unionByName(t)

    def apply(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        month_text = month or datetime.now(timezone.utc).strftime("%Y-%m")
        added = batch.groupBy().agg(*[F.count_if(F.col("counter") == c).alias(c) for c in COUNT_COLUMNS])
        batches.write_batch(added.select(F.lit(month_text).alias("timestamp"), *COUNT_COLUMNS), history_dir,
                            batches.query_id(s, checkpoint), batch_id)
        if batch_id % fold_every == fold_every - 1:
            batches.fold(s, history_dir, HISTORY_SCHEMA, per_month)

    w = tagged.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


def read_growth_history(spark, history_dir: str, months: int = KEEP_MONTHS) -> DataFrame:
    """Totals at the end of each month, the last ``months`` months, oldest first."""
    from . import batches
    paths = batches.committed(spark, history_dir)
    if not paths:
        return spark.createDataFrame([], HISTORY_SCHEMA)
    return _running(per_month(spark.read.schema(HISTORY_SCHEMA).parquet(*paths)), months)
