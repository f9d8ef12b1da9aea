"""Gold aggregates (KPIs, profitability, revenue trends, insurer and doctor views).

Money is summed as decimal (exact and independent of summation order) and only
then turned into double or rounded to a whole number.  Every aggregate runs as
partial + final aggregation; joins to dimensions happen *after* the fact side is
reduced to one row per join key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import day_bucket, month_bucket, round_half_up
from .joins import dept_cost_lookup, doctor_appointments_left


def _money(col) -> F.Column:
    return F.col(col).cast("double") if isinstance(col, str) else col.cast("double")


def table_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows per table: (table, rows)."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
             for name, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)


def pipeline_rollup(frames: dict[str, DataFrame]) -> DataFrame:
    """One row: Bronze rows per table, their total, and Silver records processed
    (the reference counts every Bronze row as processed)."""
    counts = table_counts(frames)
    aggs = [F.sum(F.when(F.col("table") == n, F.col("rows")).otherwise(0)).cast("bigint").alias(n)
            for n in frames]
    return counts.agg(*aggs, F.sum("rows").cast("bigint").alias("total"),
                      F.sum("rows").cast("bigint").alias("silver_records_processed"))


def kpi_summary(frames: dict[str, DataFrame]) -> DataFrame:
    """Dashboard KPIs in one row.  Each input is reduced to a one-row partial
    result; the partials are unioned and folded (no cross join)."""
    cols = {"total_patients": "bigint", "active_patients": "bigint", "total_appointments": "bigint",
            "revenue_total": "double", "util_sum": "double", "util_n": "bigint",
            "sat_sum": "double", "sat_n": "bigint"}

    def part(df: DataFrame, **exprs) -> DataFrame:
        return df.agg(*[(exprs[c] if c in exprs else F.lit(None)).cast(t).alias(c) for c, t in cols.items()])

    pt, ap, tx = frames["patients"], frames["appointments"], frames["transactions"]
    doc, dep = frames["doctors"], frames["departments"]
    one = F.lit(1)
    parts = [
        part(pt, total_patients=F.count(one),
             active_patients=F.count(F.when(F.col("category") == "Inpatient", one))),
        part(ap, total_appointments=F.count(one)),
        part(tx, revenue_total=F.coalesce(F.sum("amount"), F.lit(0))),
        part(doc, util_sum=F.sum("utilization"), util_n=F.count("utilization")),
        part(dep, sat_sum=F.sum("kpi_satisfaction"), sat_n=F.count("kpi_satisfaction")),
    ]
    folded = reduce(DataFrame.unionByName, parts).agg(*[F.max(c).alias(c) for c in cols])

    def avg1(s, n):
        avg = F.when(F.col(n) > 0, F.col(s) / F.col(n).cast("double")).otherwise(F.lit(0.0))
        return F.floor(avg * 10 + 0.5) / 10

    return folded.select(
        "total_patients", "active_patients", "total_appointments", "revenue_total",
        avg1("util_sum", "util_n").cast("double").alias("avg_doctor_utilization"),
        avg1("sat_sum", "sat_n").cast("double").alias("patient_satisfaction"),
    )


def appointment_trend(ap: DataFrame, n: int = 10) -> DataFrame:
    """Appointments per day for the ``n`` latest days (future scheduled days
    included), presented oldest first."""
    per_day = ap.groupBy(day_bucket("appointment_date").alias("date")).agg(F.count(F.lit(1)).alias("count"))
    return per_day.orderBy(F.col("date").desc()).limit(n).orderBy("date")


def _per_patient(tx: DataFrame, where=None) -> DataFrame:
    t = tx if where is None else tx.where(where)
    return t.groupBy("patient_id").agg(
        F.count("id").alias("n_id"), F.count(F.lit(1)).alias("n_rows"), F.count("amount").alias("n_amount"),
        F.sum("amount").alias("s_amount"), F.sum("insurance_coverage").alias("s_cov"))


def _by_insurer(tx: DataFrame, pt: DataFrame, how: str = "inner", where=None) -> DataFrame:
    """Transactions pre-aggregated per patient, joined to the patient's insurer,
    re-aggregated per insurer.  The join sees one row per patient."""
    p = pt.select(F.col("id").alias("patient_id"), "insurance_provider")
    j = _per_patient(tx, where).join(p, "patient_id", how)
    if how == "left":
        # a missing patient or an empty insurer counts as Self-Pay
        j = j.withColumn("insurance_provider",
                         F.coalesce(F.nullif(F.col("insurance_provider"), F.lit("")), F.lit("Self-Pay")))
    return j.groupBy("insurance_provider").agg(
        F.sum("n_id").cast("bigint").alias("n_id"), F.sum("n_rows").cast("bigint").alias("n_rows"),
        F.sum("n_amount").cast("bigint").alias("n_amount"),
        F.sum("s_amount").alias("s_amount"), F.sum("s_cov").alias("s_cov"))


def insurance_utilization(tx: DataFrame, pt: DataFrame) -> DataFrame:
    """Per insurer: charge count and rounded revenue (count descending)."""
    g = _by_insurer(tx, pt)
    return g.select(F.col("insurance_provider").alias("provider"), F.col("n_rows").alias("count"),
                    round_half_up(F.coalesce("s_amount", F.lit(0))).alias("total_revenue")).orderBy(
        F.col("count").desc(), "provider")


def dept_profitability(tx: DataFrame, dep: DataFrame) -> DataFrame:
    """Per department of the charges: revenue (rounded), cost (from the
    department table by name, default 15000), profit = revenue - cost; revenue
    descending."""
    rev = tx.groupBy("department").agg(F.sum("amount").alias("s_amount"))
    rev = rev.select("department", round_half_up(F.coalesce("s_amount", F.lit(0))).alias("revenue"))
    return (dept_cost_lookup(rev, dep)
            .select("department", "revenue", "cost", (F.col("revenue") - F.col("cost")).alias("profit"))
            .orderBy(F.col("revenue").desc(), "department"))


def monthly_revenue(tx: DataFrame) -> DataFrame:
    """Sum of amount per (month, type), newest month first."""
    return (tx.groupBy(month_bucket("date").alias("month"), "type")
            .agg(_money(F.coalesce(F.sum("amount"), F.lit(0))).alias("total"))
            .orderBy(F.col("month").desc(), "type"))


TREND_COLUMNS = {"consultation": "Consultation", "lab": "Lab Fee", "pharmacy": "Pharmacy",
                 "emergency": "Emergency Services"}


def monthly_revenue_trend(tx: DataFrame, months: int = 12) -> DataFrame:
    """Revenue per month pivoted by type (rounded per type; total = sum of the
    rounded parts, unknown types count in the total only); the last ``months``
    months, oldest first."""
    per = tx.groupBy(month_bucket("date").alias("month"), "type").agg(
        round_half_up(F.coalesce(F.sum("amount"), F.lit(0))).alias("amt"))
    cols = [F.sum(F.when(F.col("type") == t, F.col("amt")).otherwise(0)).cast("bigint").alias(c)
            for c, t in TREND_COLUMNS.items()]
    pivot = per.groupBy("month").agg(*cols, F.sum("amt").cast("bigint").alias("total"))
    return pivot.orderBy(F.col("month").desc()).limit(months).orderBy("month")


def doctor_performance(doc: DataFrame, ap: DataFrame) -> DataFrame:
    """Per doctor: appointments of any status, Completed revenue (rounded),
    utilization; doctors without appointments included; revenue descending."""
    j = doctor_appointments_left(doc, ap).orderBy(F.col("revenue").desc(), "id")
    return j.select(F.col("name").alias("doctor_name"), "department", "appointments",
                    round_half_up("revenue").alias("revenue"), "utilization")


def gold_dept_profitability(tx: DataFrame) -> DataFrame:
    """Gold view: per department total revenue and charge count (reads Bronze),
    revenue descending."""
    return tx.groupBy("department").agg(F.sum("amount").alias("s"), F.count(F.lit(1)).alias("transaction_count")) \
        .orderBy(F.col("s").desc(), "department") \
        .select("department", _money(F.col("s")).alias("total_revenue"), "transaction_count")


def gold_monthly_revenue(tx: DataFrame) -> DataFrame:
    return (tx.groupBy(month_bucket("date").alias("month"), "type")
            .agg(_money(F.sum("amount")).alias("total"))
            .orderBy(F.col("month").desc(), "type"))


def gold_insurance_utilization(tx: DataFrame, pt: DataFrame) -> DataFrame:
    g = _by_insurer(tx, pt)
    return g.select("insurance_provider", F.col("n_rows").alias("count"),
                    _money(F.col("s_amount")).alias("total_revenue"))


def patient_demographics(pt: DataFrame, n: int = 20) -> DataFrame:
    """Patients per (state, category), the ``n`` largest groups."""
    g = pt.groupBy("state", "category").agg(F.count(F.lit(1)).alias("count"))
    return g.orderBy(F.col("count").desc(), "state", "category").limit(n)


def coverage_analysis(tx: DataFrame, pt: DataFrame) -> DataFrame:
    g = _by_insurer(tx, pt)
    return g.select("insurance_provider", F.col("n_rows").alias("count"),
                    _money(F.col("s_amount")).alias("total_billed"),
                    _money(F.col("s_cov")).alias("total_covered"))


def top_earners(doc: DataFrame, ap: DataFrame, n: int = 5, include_idle: bool = False) -> DataFrame:
    """Completed revenue per doctor, the ``n`` largest (ties by doctor id).
    ``include_idle`` keeps doctors without Completed appointments (earning 0),
    as the sandbox form does; the SQL form joins inner."""
    per_doc = (ap.where(F.col("status") == "Completed")
               .groupBy(F.col("doctor_id").alias("id")).agg(F.sum("revenue_generated").alias("earned")))
    j = doc.select("id", "name", "department", "experience").join(per_doc, "id",
                                                                 "left" if include_idle else "inner")
    if include_idle:
        j = j.withColumn("earned", F.coalesce("earned", F.lit(0).cast("decimal(20,2)")))
    return (j.orderBy(F.col("earned").desc(), "id").limit(n)
            .select("name", "department", "experience", _money(F.col("earned")).alias("total_earned")))


def insurer_billing_stats(tx: DataFrame, pt: DataFrame) -> DataFrame:
    """Insurance-paid charges per insurer: count, average amount (null without an
    amount), covered total; count descending."""
    g = _by_insurer(tx, pt, where=F.col("payment_type") == "Insurance")
    return g.select("insurance_provider", F.col("n_id").alias("trans_count"),
                    (F.col("s_amount").cast("double") / F.nullif(F.col("n_amount"), F.lit(0))).alias("avg_claim_cost"),
                    _money(F.col("s_cov")).alias("total_insured_payout")).orderBy(
        F.col("trans_count").desc(), "insurance_provider")


def provider_billing_local(tx: DataFrame, pt: DataFrame) -> DataFrame:
    """Every charge by insurer (missing patient -> Self-Pay, no payment-type
    filter): count, rounded average amount, covered total."""
    g = _by_insurer(tx, pt, how="left")
    avg = F.col("s_amount") / F.col("n_rows")
    return g.select("insurance_provider", F.col("n_rows").alias("trans_count"),
                    round_half_up(avg).alias("avg_claim_cost"),
                    _money(F.col("s_cov")).alias("total_insured_payout"))


def distinct_states(pt: DataFrame) -> DataFrame:
    return pt.select("state").distinct().orderBy("state")


def insurer_total(iu: DataFrame) -> DataFrame:
    """Grand total over the insurer aggregate (Self-Pay included)."""
    return iu.agg(F.coalesce(F.sum("total_revenue"), F.lit(0)).cast("bigint").alias("total"))


def insurer_share(iu: DataFrame) -> DataFrame:
    """Each insurer's share (percent) of all revenue, the total as a scalar
    subquery; without revenue every share is 0."""
    tot = iu.agg(F.sum("total_revenue")).scalar()
    return iu.select("provider", "total_revenue", F.coalesce(
        F.col("total_revenue").cast("double") * 100 / F.nullif(tot, F.lit(0)), F.lit(0.0)).alias("share_pct"))


def page_totals(page: DataFrame, amount: str = "amount", coverage: str = "insurance_coverage") -> DataFrame:
    """Sum of amount and coverage over the rows shown on one page."""
    return page.agg(_money(F.coalesce(F.sum(amount), F.lit(0))).alias("page_amount"),
                    _money(F.coalesce(F.sum(coverage), F.lit(0))).alias("page_coverage"))
