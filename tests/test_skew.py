"""Hot keys: one patient / one id holding a third of all rows.  Results must be
whole and equal to a plain (un-optimised) formulation of the same query."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlake.operators import gold, joins, quality


def _skewed(spark, n=60_000):
    ids = spark.range(n)
    hot = F.col("id") % 3 == 0
    tx = ids.select(
        F.when(hot, F.lit("TXHOT")).otherwise(F.concat(F.lit("TX"), F.col("id").cast("string"))).alias("id"),
        F.when(hot, F.lit("PT0")).otherwise(F.concat(F.lit("PT"), (F.col("id") % 997).cast("string")))
        .alias("patient_id"),
        F.lit(None).cast("string").alias("appointment_id"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("id"))).alias("date"),
        ((F.col("id") % 1000) / 10).cast("decimal(10,2)").alias("amount"),
        F.lit("Pharmacy").alias("type"), F.lit(0).cast("decimal(10,2)").alias("insurance_coverage"),
        F.lit("Insurance").alias("payment_type"), F.lit("X").alias("department"))
    pt = spark.range(997).select(F.concat(F.lit("PT"), F.col("id").cast("string")).alias("id"),
                                 F.when(F.col("id") == 0, "HotCare").otherwise("MedLife").alias("insurance_provider"))
    return tx, pt


def test_hot_patient_insurer_aggregate(spark):
    tx, pt = _skewed(spark)
    got = {r.provider: (r["count"], r.total_revenue) for r in gold.insurance_utilization(tx, pt).collect()}
    plain = (tx.join(pt.withColumnRenamed("id", "patient_id"), "patient_id")
             .groupBy("insurance_provider").agg(F.count(F.lit(1)).alias("c"), F.sum("amount").alias("s")))
    want = {r.insurance_provider: (r.c, int((r.s + 0).to_integral_value(rounding="ROUND_HALF_UP")))
            for r in plain.collect()}
    assert got == want and got["HotCare"][0] >= 20_000


def test_hot_id_dedupe_and_raw_join(spark):
    tx, pt = _skewed(spark)
    got = quality.dedupe_latest(tx, "id", "date")
    rest = [c for c in tx.columns if c not in ("id", "date")]
    w = Window.partitionBy("id").orderBy(F.col("date").desc(), *[F.col(c).desc_nulls_last() for c in rest])
    want = tx.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.where("id = 'TXHOT'").count() == 1
    assert joins.tx_with_patient(tx, pt).count() == tx.count()


def test_hot_keys_are_summed_before_the_shuffle(spark):
    """Plans: aggregates by a fact key are partial first, joins see their result or
    are skew joins (no window by a fact key, no cross join)."""
    tx, pt = _skewed(spark)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    for df in (gold.insurance_utilization(tx, pt), quality.dedupe_latest(tx, "id", "date")):
        text = plan(df)
        assert "partial_" in text and "Window" not in text and "Cartesian" not in text
        assert text.index("partial_") > 0 and text.count("Exchange hashpartitioning") >= 1
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
