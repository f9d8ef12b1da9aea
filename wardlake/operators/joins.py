"""Join operators of the hospital model.

Where a join feeds an aggregate, the fact side is aggregated to the join key
first (partial + final aggregation), so the join sees at most one row per key:
hot keys collapse map-side and never reach one task whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.scalars import completed_revenue


def tx_with_patient(tx: DataFrame, pt: DataFrame, pt_cols=("insurance_provider",)) -> DataFrame:
    """Inner equi-join transactions.patient_id = patients.id (patients is a
    dimension; the planner picks broadcast or sort-merge by measured size)."""
    p = pt.select(F.col("id").alias("patient_id"), *pt_cols)
    return tx.join(p, "patient_id", "inner")


def doctor_appointments_left(doc: DataFrame, ap: DataFrame) -> DataFrame:
    """Per doctor: appointment count over all statuses and Completed revenue; a
    doctor without appointments keeps count 0 and revenue 0 (left join after
    pre-aggregating appointments by doctor)."""
    per_doc = ap.groupBy(F.col("doctor_id").alias("id")).agg(
        F.count("id").alias("appointments"),
        F.sum(completed_revenue()).alias("revenue"))
    return (doc.join(per_doc, "id", "left")
            .withColumn("appointments", F.coalesce("appointments", F.lit(0)).cast("bigint"))
            .withColumn("revenue", F.coalesce("revenue", F.lit(0)).cast("decimal(20,2)")))


def doctor_appointments_inner(doc: DataFrame, ap: DataFrame) -> DataFrame:
    """Doctors joined to their Completed appointments (inner)."""
    a = ap.where(F.col("status") == "Completed").select(
        F.col("id").alias("appointment_id"), F.col("doctor_id").alias("id"), "revenue_generated",
        "appointment_date")
    return doc.join(a, "id", "inner")


def dept_costs(dep: DataFrame) -> DataFrame:
    """Department cost per name: 25000 + 450*beds_occupied + 150*avg_wait_time
    (one row per name)."""
    return dep.groupBy("name").agg(F.max(
        F.lit(S.COST_BASE) + F.col("beds_occupied") * S.COST_PER_BED
        + F.col("avg_wait_time") * S.COST_PER_WAIT_MINUTE).cast("bigint").alias("cost"))


def dept_cost_lookup(df: DataFrame, dep: DataFrame, dept_col: str = "department") -> DataFrame:
    """Left lookup of the department cost by *name*; unknown name or a cost of 0
    falls back to 15000.  The cost table has one row per department name; the
    planner broadcasts it when its measured size allows."""
    costs = dept_costs(dep).withColumnRenamed("name", dept_col)
    return (df.join(costs, dept_col, "left")
            .withColumn("cost", F.coalesce(F.nullif(F.col("cost"), F.lit(0)),
                                           F.lit(S.COST_DEFAULT)).cast("bigint")))


def provider_lookup_default(tx: DataFrame, pt: DataFrame) -> DataFrame:
    """Left lookup of the patient's insurer; a charge whose patient is missing
    (or whose insurer is empty) is Self-Pay."""
    p = pt.select(F.col("id").alias("patient_id"), "insurance_provider")
    return (tx.join(p, "patient_id", "left")
            .withColumn("insurance_provider",
                        F.coalesce(F.nullif(F.col("insurance_provider"), F.lit("")), F.lit(S.SELF_PAY))))


def anti_existing(a: DataFrame, b: DataFrame, keys, distinct_right: bool = True) -> DataFrame:
    """Rows of ``a`` with no key match in ``b``.  The right side is reduced to
    its distinct keys first (partial aggregation), so a large right side with
    repeated keys ships each key once per task, not once per row."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    right = b.select(*keys)
    return a.join(right.distinct() if distinct_right else right, keys, "left_anti")
