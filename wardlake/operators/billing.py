"""Billing rules: appointment revenue, billable appointments, reconciliation of
consultation charges, coverage of ancillary charges, department routing,
appointment links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def appointment_revenue(ap: DataFrame, doc: DataFrame) -> DataFrame:
    """revenue_generated = 0 for Cancelled, else the doctor's consultation fee."""
    d = doc.select(F.col("id").alias("doctor_id"), "consultation_fee")
    return (ap.drop("revenue_generated").join(d, "doctor_id", "left")
            .withColumn("revenue_generated",
                        F.when(F.col("status") == "Cancelled", F.lit(0))
                        .otherwise(F.col("consultation_fee")).cast(S.MONEY))
            .drop("consultation_fee"))


def billable_rule(status="status") -> Column:
    return _c(status).isin("Completed", "Rescheduled")


def billable_appointments(ap: DataFrame) -> DataFrame:
    return ap.where(billable_rule())


def consultation_charges(ap: DataFrame, tx: DataFrame) -> DataFrame:
    """Reconciliation of billable appointments with their Consultation charges: per
    billable appointment its revenue, the number of charges and the amount and
    coverage charged, and the difference.  Charges are summed per appointment
    before the join, so a hot appointment is one row there."""
    charged = (tx.where((F.col("type") == "Consultation") & F.col("appointment_id").isNotNull())
               .groupBy(F.col("appointment_id").alias("id"))
               .agg(F.count(F.lit(1)).alias("charges"), F.sum("amount").alias("charged"),
                    F.sum("insurance_coverage").alias("covered")))
    out = billable_appointments(ap).select("id", "patient_id", "department", "revenue_generated").join(charged, "id", "left")
    money = F.lit(0).cast("decimal(20,2)")
    return out.select(
        "id", "patient_id", "department", F.col("revenue_generated").alias("billable"),
        F.coalesce("charges", F.lit(0)).cast("bigint").alias("charges"),
        F.coalesce("charged", money).alias("charged"), F.coalesce("covered", money).alias("covered"),
        (F.col("revenue_generated") - F.coalesce("charged", money)).alias("difference"))


def ancillary_coverage(tx: DataFrame) -> DataFrame:
    """Coverage of non-consultation charges per (type, payment type): charges,
    amount, covered amount and the covered share in percent (null without amount)."""
    g = (tx.where(F.col("type") != "Consultation").groupBy("type", "payment_type")
         .agg(F.count(F.lit(1)).alias("charges"), F.sum("amount").alias("amount"),
              F.sum("insurance_coverage").alias("covered")))
    return g.withColumn("covered_pct", F.col("covered").cast("double") * 100
                        / F.nullif(F.col("amount").cast("double"), F.lit(0.0)))


def route_department(type_col="type", doctor_department="doctor_department") -> Column:
    """Emergency Services -> Emergency; Lab Fee -> Radiology; else the doctor's
    department."""
    t = _c(type_col)
    return (F.when(t == "Emergency Services", F.lit("Emergency"))
            .when(t == "Lab Fee", F.lit("Radiology")).otherwise(_c(doctor_department)))


def appointment_link(type_col="type", appointment_id="appointment_id") -> Column:
    """Only Consultation charges carry an appointment id."""
    return F.when(_c(type_col) == "Consultation", _c(appointment_id))
