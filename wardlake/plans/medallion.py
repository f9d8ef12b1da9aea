"""The reference's composite views as bundles of lazy frames.

* ``medallion_metrics``: Bronze counts, Silver pass rate and processed rows,
  and the four Gold aggregations of the pipeline panel.
* ``summary_stats``: the dashboard KPIs and the 10-day appointment trend.
* ``sync``: the full Bronze refresh followed by the Silver and Gold views over
  the new Bronze tables, with the per-table report and the overall status.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gold, metrics, quality
from ..sources import tables
from . import presets


def medallion_metrics(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    tx, pt = frames["transactions"], frames["patients"]
    parts = [quality.silver_pass_rate(frames[t], rule()).withColumn("table", F.lit(t))
             for t, rule in quality.SILVER_RULES.items()]
    silver = reduce(DataFrame.unionByName, parts).agg(
        F.sum("bronze_rows").alias("bronze_rows"), F.sum("silver_rows").alias("silver_rows"))
    silver = silver.select("bronze_rows", "silver_rows",
                           F.when(F.col("bronze_rows") > 0, F.col("silver_rows") * 100.0 / F.col("bronze_rows"))
                           .otherwise(F.lit(100.0)).alias("silver_clean_percentage"))
    return {
        "bronze_count": gold.pipeline_rollup(frames),
        "silver": silver,
        "insurance_utilization": gold.insurance_utilization(tx, pt),
        "department_profitability": gold.dept_profitability(tx, frames["departments"]),
        "monthly_revenue_trend": gold.monthly_revenue_trend(tx),
        "doctor_performance": gold.doctor_performance(frames["doctors"], frames["appointments"]),
    }


def summary_stats(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {"kpis": gold.kpi_summary(frames), "appointment_trends": gold.appointment_trend(frames["appointments"])}


def sync(spark: SparkSession, sources: dict[str, DataFrame], bronze_dir: str) -> dict[str, DataFrame]:
    """Refresh Bronze from ``sources`` (all tables, failures isolated), then
    register the Silver and Gold views over the refreshed Bronze tables."""
    report = tables.bronze_full_refresh(spark, sources, bronze_dir)
    report = report.cache()  # five rows; read by the status and returned to the caller
    bronze = tables.read_bronze(spark, bronze_dir)
    views = presets.register_views(spark, bronze) if {"patients", "transactions"} <= set(bronze) else []
    return {"report": metrics.sync_report(report), "status": metrics.sync_status(report),
            "views": spark.createDataFrame([(v,) for v in views], "view string")}
