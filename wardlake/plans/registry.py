"""Registered queries: each takes (spark, sf_dir) and returns a lazy DataFrame
over the hospital tables derived from the driver tables.

Keys follow the operator names of the blueprint.  Every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scalars as X
from ..operators import billing, gold, joins, metrics, quality, registers, upsert
from ..sources import tables
from ..sources.fixtures import Hospital, load_hospital
from ..streaming.growth import growth_history
from . import presets

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
# the same queries over any Hospital (e.g. one read from materialized Bronze)
BUILDERS: dict[str, Callable[[Hospital], DataFrame]] = {}


def register(name: str):
    def deco(fn: Callable[[Hospital], DataFrame]) -> Callable[[Hospital], DataFrame]:
        BUILDERS[name] = fn
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(load_hospital(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


# -- §2.5 aggregates --------------------------------------------------------

@register("dept_profitability")
def _dept_profitability(h: Hospital) -> DataFrame:
    return gold.dept_profitability(h.transactions, h.departments)


@register("table_counts")
def _table_counts(h: Hospital) -> DataFrame:
    return gold.table_counts(h.as_dict())


@register("pipeline_rollup")
def _pipeline_rollup(h: Hospital) -> DataFrame:
    return gold.pipeline_rollup(h.as_dict())


@register("kpi_summary")
def _kpi_summary(h: Hospital) -> DataFrame:
    return gold.kpi_summary(h.as_dict())


@register("appointment_trend")
def _appointment_trend(h: Hospital) -> DataFrame:
    return gold.appointment_trend(h.appointments)


@register("insurance_utilization")
def _insurance_utilization(h: Hospital) -> DataFrame:
    return gold.insurance_utilization(h.transactions, h.patients)


@register("monthly_revenue")
def _monthly_revenue(h: Hospital) -> DataFrame:
    return gold.monthly_revenue(h.transactions)


@register("monthly_revenue_trend")
def _monthly_revenue_trend(h: Hospital) -> DataFrame:
    return gold.monthly_revenue_trend(h.transactions)


@register("doctor_performance")
def _doctor_performance(h: Hospital) -> DataFrame:
    return gold.doctor_performance(h.doctors, h.appointments)


@register("gold_dept_profitability")
def _gold_dept_profitability(h: Hospital) -> DataFrame:
    return gold.gold_dept_profitability(h.transactions)


@register("gold_monthly_revenue")
def _gold_monthly_revenue(h: Hospital) -> DataFrame:
    return gold.gold_monthly_revenue(h.transactions)


@register("gold_insurance_utilization")
def _gold_insurance_utilization(h: Hospital) -> DataFrame:
    return gold.gold_insurance_utilization(h.transactions, h.patients)


@register("patient_demographics")
def _patient_demographics(h: Hospital) -> DataFrame:
    return gold.patient_demographics(h.patients)


@register("coverage_analysis")
def _coverage_analysis(h: Hospital) -> DataFrame:
    return gold.coverage_analysis(h.transactions, h.patients)


@register("top_earners")
def _top_earners(h: Hospital) -> DataFrame:
    return gold.top_earners(h.doctors, h.appointments)


@register("insurer_billing_stats")
def _insurer_billing_stats(h: Hospital) -> DataFrame:
    return gold.insurer_billing_stats(h.transactions, h.patients)


@register("provider_billing_local")
def _provider_billing_local(h: Hospital) -> DataFrame:
    return gold.provider_billing_local(h.transactions, h.patients)


@register("distinct_states")
def _distinct_states(h: Hospital) -> DataFrame:
    return gold.distinct_states(h.patients)


@register("insurer_total")
def _insurer_total(h: Hospital) -> DataFrame:
    return gold.insurer_total(gold.insurance_utilization(h.transactions, h.patients))


@register("insurer_share")
def _insurer_share(h: Hospital) -> DataFrame:
    return gold.insurer_share(gold.insurance_utilization(h.transactions, h.patients))


# -- helpers for the registered forms -----------------------------------------


def _tx_out(df: DataFrame) -> DataFrame:
    """Transactions with money as double and the date as ISO text (comparable)."""
    return df.select("id", "patient_id", "appointment_id", X.iso_timestamp("date").alias("date"),
                     F.col("amount").cast("double").alias("amount"), "type",
                     F.col("insurance_coverage").cast("double").alias("insurance_coverage"),
                     "payment_type", "department")


def upsert_fixture(tx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Target: charges except Emergency Services.  Source: Emergency Services and
    Pharmacy charges with Pharmacy dates moved a day (+1 for an even last id
    digit, -1 for odd), amount + 10, paid Cash, department CHANGED."""
    target = tx.where(F.col("type") != "Emergency Services")
    even = (F.substring("id", -1, 1).cast("int") % 2) == 0
    shift = F.when(F.col("type") != "Pharmacy", F.lit(0)).when(even, F.lit(1)).otherwise(F.lit(-1))
    source = tx.where(F.col("type").isin("Emergency Services", "Pharmacy")).withColumns({
        "date": F.col("date") + F.make_dt_interval(days=shift),
        "amount": (F.col("amount") + 10).cast(S.MONEY),
        "payment_type": F.lit("Cash"),
        "department": F.lit("CHANGED"),
    })
    return target, source


def _number(col: str = "id"):
    """Digits of an id of the given tables as a number (TX12-3-4-5: 12345)."""
    return F.regexp_replace(F.col(col), r"\D", "").cast("decimal(38,0)")


def planted(h: Hospital) -> dict[str, DataFrame]:
    """The hospital tables with constraint violations in them: some patients
    without a name, with unknown gender or blood group, or twice; appointments of
    missing doctors and without a date; charges without amount, of an unknown type,
    or twice; doctors without a department; departments without a cost."""
    n = _number()
    null = F.lit(None)
    pt = h.patients.withColumns({
        "name": F.when(n % 7 == 0, null).otherwise(F.col("name")),
        "gender": F.when(n % 11 == 0, F.lit("Unknown")).otherwise(F.col("gender")),
        "blood_group": F.when(n % 13 == 0, F.lit("C+")).otherwise(F.col("blood_group"))})
    ap = h.appointments.withColumns({
        "doctor_id": F.when(n % 17 == 0, F.concat(F.lit("NONE"), F.col("doctor_id"))).otherwise(F.col("doctor_id")),
        "appointment_date": F.when(n % 19 == 0, null).otherwise(F.col("appointment_date")),
        "status": F.when(n % 23 == 0, F.lit("Lost")).otherwise(F.col("status"))})
    tx = h.transactions.withColumns({
        "amount": F.when(n % 29 == 0, null).otherwise(F.col("amount")),
        "type": F.when(n % 31 == 0, F.lit("Gift")).otherwise(F.col("type"))})
    doc = h.doctors.withColumn("department", F.when(n % 3 == 0, null).otherwise(F.col("department")))
    dep = h.departments.withColumn("avg_wait_time", F.when(n % 5 == 0, null).otherwise(F.col("avg_wait_time")))
    return {"departments": dep, "doctors": doc, "patients": pt.unionByName(pt.where(n % 37 == 0)),
            "appointments": ap, "transactions": tx.unionByName(tx.where(n % 41 == 0))}


def _found(h: Hospital, df: DataFrame) -> DataFrame:
    """The violations ``df``, few rows.  Over large tables they are found now, with as
    many shuffle partitions as the charges are dealt to, so that the keys a task counts
    do not grow with the tables where the session's number is fixed."""
    if not h.parts:
        return df
    from ..session import scratch_path, setting
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "violations")
    with setting(spark, "spark.sql.shuffle.partitions", str(h.parts)), setting(
            spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# -- §2.1 scans, sinks, upserts ----------------------------------------------

@register("scan_patients")
def _scan_patients(h: Hospital) -> DataFrame:
    return tables.scan_patients(h.patients)


@register("scan_appointments")
def _scan_appointments(h: Hospital) -> DataFrame:
    return tables.scan_appointments(h.appointments)


@register("scan_doctors")
def _scan_doctors(h: Hospital) -> DataFrame:
    return tables.scan_doctors(h.doctors)


@register("scan_departments")
def _scan_departments(h: Hospital) -> DataFrame:
    return tables.scan_departments(h.departments, order="name")


@register("scan_transactions")
def _scan_transactions(h: Hospital) -> DataFrame:
    return tables.scan_transactions(h.transactions)


@register("export_csv_frame")
def _export_csv_frame(h: Hospital) -> DataFrame:
    """The exported transaction CSV columns (camelCase, money as numbers)."""
    df = tables.csv_frame(h.transactions, "transactions")
    return df.withColumn("date", X.iso_timestamp("date"))


@register("insert_ignore")
def _insert_ignore(h: Hospital) -> DataFrame:
    target, source = upsert_fixture(h.transactions)
    return _tx_out(upsert.insert_ignore(target, source, order_col="date"))


@register("merge_upsert")
def _merge_upsert(h: Hospital) -> DataFrame:
    target, source = upsert_fixture(h.transactions)
    return _tx_out(upsert.merge_upsert(target, source))


@register("merge_stats")
def _merge_stats(h: Hospital) -> DataFrame:
    target, source = upsert_fixture(h.transactions)
    return upsert.merge_stats(target, source)


@register("adhoc_sql")
def _adhoc_sql(h: Hospital) -> DataFrame:
    """The department revenue preset through register_views + adhoc_sql."""
    spark = h.transactions.sparkSession
    presets.register_views(spark, h.as_dict())
    res = presets.adhoc_sql(spark, presets.PRESETS["department_revenue_summary"])
    return res.rows.select("department", F.col("total_revenue").cast("double").alias("total_revenue"),
                           "transaction_count")


@register("adhoc_sql_capped")
def _adhoc_sql_capped(h: Hospital) -> DataFrame:
    """A query with more rows than the cap: the first 1000 rows in its order."""
    spark = h.transactions.sparkSession
    presets.register_views(spark, h.as_dict())
    res = presets.adhoc_sql(spark, "SELECT id, CAST(amount AS DOUBLE) AS amount FROM silver_transactions "
                                   "ORDER BY amount DESC, id")
    return res.rows


@register("adhoc_row_count")
def _adhoc_row_count(h: Hospital) -> DataFrame:
    spark = h.transactions.sparkSession
    presets.register_views(spark, h.as_dict())
    res = presets.adhoc_sql(spark, "select id from bronze_transactions where type = 'Pharmacy'")
    return res.full.agg(F.count(F.lit(1)).alias("row_count"))


@register("preset_top_earners")
def _preset_top_earners(h: Hospital) -> DataFrame:
    spark = h.transactions.sparkSession
    presets.register_views(spark, h.as_dict())
    return presets.run_preset(spark, "top_earners").withColumn(
        "total_earned", F.col("total_earned").cast("double"))


@register("preset_geriatric_inpatients")
def _preset_geriatric(h: Hospital) -> DataFrame:
    spark = h.transactions.sparkSession
    presets.register_views(spark, h.as_dict())
    return presets.run_preset(spark, "geriatric_inpatients")


# -- §2.2 scalar expressions ---------------------------------------------------

@register("out_of_pocket")
def _out_of_pocket(h: Hospital) -> DataFrame:
    return h.transactions.select("id", X.out_of_pocket().cast("double").alias("out_of_pocket"))


@register("utilization_band")
def _utilization_band(h: Hospital) -> DataFrame:
    return h.doctors.select("id", "utilization", X.utilization_band().alias("band"))


@register("time_buckets")
def _time_buckets(h: Hospital) -> DataFrame:
    return h.transactions.select("id", X.month_bucket("date").alias("month"), X.day_bucket("date").alias("day"))


@register("round_half_up")
def _round_half_up(h: Hospital) -> DataFrame:
    d = F.col("insurance_coverage") - F.col("amount")
    return h.transactions.select("id", X.round_half_up(d).alias("rounded"),
                                 X.round_half_up(d / 4, 1).alias("rounded_1dp"))


@register("entity_key")
def _entity_key(h: Hospital) -> DataFrame:
    n = X.entity_number("id", "PT")
    return h.patients.select("id", X.entity_key("PT", n).alias("key"),
                             X.entity_key("PT", n * 1000).alias("key_wide"))


@register("api_shape_transactions")
def _api_shape(h: Hospital) -> DataFrame:
    df = X.to_api_types(X.to_api_names(h.transactions, "transactions"), "transactions")
    return X.to_storage_names(df, "transactions")


@register("growth_history_json")
def _growth_history_json(h: Hospital) -> DataFrame:
    """pack -> parse round trip of the history JSON."""
    packed = X.pack_growth_history(growth_history(h.patients, h.appointments, h.transactions))
    return X.parse_growth_history(packed)


# -- §2.3 filters ----------------------------------------------------------------

@register("filter_patients")
def _filter_patients(h: Hospital) -> DataFrame:
    return registers.filter_patients(h.patients, state="ASIA", category="Inpatient").select(
        "id", "name", "state", "category")


@register("search_patients")
def _search_patients(h: Hospital) -> DataFrame:
    return registers.search_patients(h.patients, "CUSTOMER#00000_2").select("id", "name")


@register("filter_appointments")
def _filter_appointments(h: Hospital) -> DataFrame:
    return registers.filter_appointments(h.appointments, status="Completed", department="NATION_3").select(
        "id", "status", "department")


@register("filter_transactions")
def _filter_transactions(h: Hospital) -> DataFrame:
    return registers.filter_transactions(h.transactions, type="Pharmacy", payment_type="Cash").select(
        "id", "type", "payment_type")


@register("silver_patients")
def _silver_patients(h: Hospital) -> DataFrame:
    return quality.silver_patients(h.patients, lineage=False).select("id", "name", "age")


@register("silver_transactions")
def _silver_transactions(h: Hospital) -> DataFrame:
    return _tx_out(quality.silver_transactions(h.transactions, lineage=False))


@register("experienced_doctors")
def _experienced_doctors(h: Hospital) -> DataFrame:
    return registers.experienced_doctors(h.doctors)


@register("geriatric_inpatients")
def _geriatric_inpatients(h: Hospital) -> DataFrame:
    return registers.geriatric_inpatients(h.patients)


@register("inpatient_count")
def _inpatient_count(h: Hospital) -> DataFrame:
    return registers.inpatient_count(h.patients)


@register("doctor_sample")
def _doctor_sample(h: Hospital) -> DataFrame:
    return registers.doctor_sample(h.doctors)


# -- §2.4 joins ------------------------------------------------------------------

@register("tx_with_patient")
def _tx_with_patient(h: Hospital) -> DataFrame:
    return joins.tx_with_patient(h.transactions, h.patients).select("id", "patient_id", "insurance_provider")


@register("doctor_appointments_left")
def _doctor_appointments_left(h: Hospital) -> DataFrame:
    return joins.doctor_appointments_left(h.doctors, h.appointments).select(
        "id", "appointments", F.col("revenue").cast("double").alias("revenue"))


@register("doctor_appointments_inner")
def _doctor_appointments_inner(h: Hospital) -> DataFrame:
    return joins.doctor_appointments_inner(h.doctors, h.appointments).select(
        "id", "appointment_id", F.col("revenue_generated").cast("double").alias("revenue"))


@register("dept_cost_lookup")
def _dept_cost_lookup(h: Hospital) -> DataFrame:
    depts = h.transactions.select("department").distinct()
    return joins.dept_cost_lookup(depts, h.departments)


@register("provider_lookup_default")
def _provider_lookup_default(h: Hospital) -> DataFrame:
    return joins.provider_lookup_default(h.transactions, h.patients).select("id", "insurance_provider")


@register("anti_existing")
def _anti_existing(h: Hospital) -> DataFrame:
    """Patients without any Cancelled appointment."""
    cancelled = h.appointments.where(F.col("status") == "Cancelled").select(F.col("patient_id").alias("id"))
    return joins.anti_existing(h.patients.select("id"), cancelled, "id")


# -- §2.6 paging and top-k ---------------------------------------------------------

@register("page_patients")
def _page_patients(h: Hospital) -> DataFrame:
    return registers.page_patients(h.patients, page_no=2, limit=10, category="Inpatient", search="customer#")


@register("page_appointments")
def _page_appointments(h: Hospital) -> DataFrame:
    return registers.page_appointments(h.appointments, page_no=3, limit=10, status="Completed")


@register("page_transactions")
def _page_transactions(h: Hospital) -> DataFrame:
    return registers.page_transactions(h.transactions, page_no=2, limit=10, type="Lab Fee")


@register("page_after")
def _page_after(h: Hospital) -> DataFrame:
    """Keyset page: the ten charges after the newest charge of a type that shares
    its date with others."""
    order = [("date", True), ("id", True)]
    df = registers.filter_transactions(h.transactions, type="Lab Fee")
    last = registers.page_after(df, order, limit=7).select("date", "id").collect()[-1]
    return registers.page_after(df, order, (last["date"], last["id"])).select("id", X.iso_timestamp("date").alias("date"))


@register("page_info")
def _page_info(h: Hospital) -> DataFrame:
    return registers.page_info(registers.filter_transactions(h.transactions, type="Lab Fee"), page_no=2, limit=10)


@register("page_totals")
def _page_totals(h: Hospital) -> DataFrame:
    pg = registers.page(registers.filter_transactions(h.transactions, type="Lab Fee"),
                        [F.col("date").desc(), F.col("id").desc()], 2, 10)
    return gold.page_totals(pg)


@register("recent_rows")
def _recent_rows(h: Hospital) -> DataFrame:
    return registers.recent_rows(h.transactions, "date").select("id", X.iso_timestamp("date").alias("date"))


@register("top_k")
def _top_k(h: Hospital) -> DataFrame:
    return registers.top_k(gold.dept_profitability(h.transactions, h.departments), "profit", 5, "department")


@register("latest_periods_ascending")
def _latest_periods(h: Hospital) -> DataFrame:
    per = h.appointments.groupBy(X.month_bucket("appointment_date").alias("month")).agg(
        F.count(F.lit(1)).alias("appointments"))
    return registers.latest_periods_ascending(per, "month", 6)


# -- §2.7 billing -------------------------------------------------------------------

@register("appointment_revenue")
def _appointment_revenue(h: Hospital) -> DataFrame:
    return billing.appointment_revenue(h.appointments, h.doctors).select(
        "id", F.col("revenue_generated").cast("double").alias("revenue_generated"))


@register("billable_appointments")
def _billable_appointments(h: Hospital) -> DataFrame:
    return billing.billable_appointments(h.appointments).select("id", "status")


def _doubles(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


@register("consultation_charges")
def _consultation_charges(h: Hospital) -> DataFrame:
    return _doubles(billing.consultation_charges(h.appointments, h.transactions),
                    "billable", "charged", "covered", "difference")


@register("ancillary_coverage")
def _ancillary_coverage(h: Hospital) -> DataFrame:
    return _doubles(billing.ancillary_coverage(h.transactions), "amount", "covered")


@register("route_department")
def _route_department(h: Hospital) -> DataFrame:
    doc_id = F.concat(F.lit("DR"), F.split(F.col("id"), "-").getItem(3))
    tx = h.transactions.select("id", "type", doc_id.alias("doctor_id"))
    d = h.doctors.select(F.col("id").alias("doctor_id"), F.col("department").alias("doctor_department"))
    return tx.join(d, "doctor_id", "left").select("id", "type", billing.route_department().alias("department"))


@register("appointment_link")
def _appointment_link(h: Hospital) -> DataFrame:
    ap_id = F.concat(F.lit("AP"), F.split(F.substring(F.col("id"), 3, 1 << 30), "-").getItem(0))
    return h.transactions.select("id", "type", billing.appointment_link("type", ap_id).alias("appointment_id"))


# -- §2.8 quality ----------------------------------------------------------------------

@register("check_unique_key")
def _check_unique_key(h: Hospital) -> DataFrame:
    return _found(h, quality.check_unique_key(planted(h)["transactions"]))


@register("check_not_null")
def _check_not_null(h: Hospital) -> DataFrame:
    return quality.check_not_null(planted(h)["transactions"], S.storage_columns("transactions"))


@register("check_domain")
def _check_domain(h: Hospital) -> DataFrame:
    return quality.check_domains(planted(h)["patients"], "patients")


@register("check_constraints")
def _check_constraints(h: Hospital) -> DataFrame:
    """Every constraint of all five tables, on tables with planted violations."""
    return _found(h, quality.check_all_constraints(planted(h)))


@register("check_domain_rows")
def _check_domain_rows(h: Hospital) -> DataFrame:
    return quality.check_domain(h.transactions, "type", ["Consultation", "Lab Fee", "Pharmacy"])


@register("check_foreign_key")
def _check_foreign_key(h: Hospital) -> DataFrame:
    """Orphans of the four links when some doctors are unknown and every fifth
    patient and every seventh appointment is missing."""
    frames = planted(h)
    frames["patients"] = frames["patients"].where(_number() % 5 != 0)
    frames["appointments"] = frames["appointments"].where(_number() % 7 != 0)
    return quality.check_all_foreign_keys(frames)


@register("fill_defaults")
def _fill_defaults(h: Hospital) -> DataFrame:
    """Columns with a default, emptied in some rows of four tables and filled."""
    n, null = _number(), F.lit(None)
    ap = h.appointments.withColumns({
        "duration": F.when(F.col("status") == "Scheduled", null).otherwise(F.col("duration")),
        "revenue_generated": F.when(n % 3 == 0, null).otherwise(F.col("revenue_generated"))})
    tx = h.transactions.withColumns({
        "amount": F.when(n % 5 == 0, null).otherwise(F.col("amount")),
        "insurance_coverage": F.when(n % 7 == 0, null).otherwise(F.col("insurance_coverage"))})
    doc = h.doctors.withColumn("experience", F.when(n % 2 == 0, null).otherwise(F.col("experience")))
    dep = h.departments.withColumn("beds_total", F.when(n % 2 == 0, null).otherwise(F.col("beds_total")))
    parts = [("appointments", ap, "duration", "revenue_generated"), ("transactions", tx, "amount", "insurance_coverage"),
             ("doctors", doc, "experience", "utilization"), ("departments", dep, "beds_total", "avg_wait_time")]
    out = [quality.fill_defaults(df, t).select(F.lit(t).alias("table"), "id", F.col(a).cast("double").alias("first"),
                                               F.col(b).cast("double").alias("second")) for t, df, a, b in parts]
    return reduce(DataFrame.unionByName, out)


@register("dedupe_latest")
def _dedupe_latest(h: Hospital) -> DataFrame:
    target, source = upsert_fixture(h.transactions)
    both = target.unionByName(source)
    return _tx_out(quality.dedupe_latest(both, "id", "date"))


@register("silver_pass_rate")
def _silver_pass_rate(h: Hospital) -> DataFrame:
    p = quality.silver_pass_rate(h.patients, quality.silver_patients_rule()).withColumn("table", F.lit("patients"))
    t = quality.silver_pass_rate(h.transactions, quality.silver_transactions_rule()).withColumn(
        "table", F.lit("transactions"))
    return p.unionByName(t)


# -- §2.9 incremental ------------------------------------------------------------------

@register("growth_history")
def _growth_history(h: Hospital) -> DataFrame:
    return growth_history(h.patients, h.appointments, h.transactions)


@register("append_with_keys")
def _append_with_keys(h: Hospital) -> DataFrame:
    """Every patient re-registered as a new batch, numbered after the highest
    existing patient number in (name, id) order."""
    spark = h.patients.sparkSession
    batch = h.patients.select("id", "name")
    out = upsert.append_with_keys(spark, h.patients, batch, "PT", 6, order_by=["name", "id"])
    return out.select("id", "name")


# -- §2.10 metrics ------------------------------------------------------------------------

ALERT_NOW = "2024-01-15 12:00:00"
ALERT_RULES = [
    ("click low", "click", 5.0, 3600, True, "warning", "web"),
    ("purchase low", "purchase", 20.0, 1800, True, "critical", "shop"),
    ("heartbeat missing", "heartbeat", 1.0, 60, True, "critical", "app"),
    ("signup quiet", "signup", 1.0, 600, False, "info", "growth"),
    ("click low for one user", "click", 5.0, 86400, True, "info", "web", {"user": "7"}),
]


@register("metrics_snapshot")
def _metrics_snapshot(h: Hospital) -> DataFrame:
    return metrics.metrics_snapshot(h.as_dict())


@register("metric_last_value")
def _metric_last_value(h: Hospital) -> DataFrame:
    return metrics.metric_last_value(h.metric_samples).withColumn("ts", X.iso_timestamp("ts"))


@register("metric_series")
def _metric_series(h: Hospital) -> DataFrame:
    return metrics.metric_series(h.metric_samples, "error", "2024-01-10 00:00:00", "2024-01-12 00:00:00") \
        .withColumn("ts", X.iso_timestamp("ts"))


@register("threshold_alerts")
def _threshold_alerts(h: Hospital) -> DataFrame:
    rules = metrics.rules_frame(h.metric_samples.sparkSession, ALERT_RULES)
    return metrics.threshold_alerts(h.metric_samples, rules, ALERT_NOW).drop("labels").withColumn(
        "ts", X.iso_timestamp("ts"))


@register("threshold_band")
def _threshold_band(h: Hospital) -> DataFrame:
    return _silver_pass_rate(h).select("table", "pass_rate", metrics.threshold_band("pass_rate").alias("band"))


@register("status_text")
def _status_text(h: Hospital) -> DataFrame:
    """Per metric: 1 when it has a sample in the hour before ALERT_NOW -> UP/DOWN."""
    now = F.lit(ALERT_NOW).cast("timestamp")
    recent = F.count_if((F.col("ts") <= now) & (F.col("ts") > now - F.expr("INTERVAL 1 HOUR")))
    up = h.metric_samples.groupBy("metric").agg(F.when(recent > 0, 1).otherwise(0).alias("up"))
    return up.select("metric", "up", metrics.status_text("up").alias("status"))


# -- streaming forms: run the stream over landing files written from the given
#    tables (two arrivals, two availableNow runs on one checkpoint), return the
#    table it produced -------------------------------------------------------------

def _raw(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn
    return deco


@_raw("stream_bronze_append")
def _q_stream_bronze_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..session import scratch_path
    from ..streaming import incremental as inc
    tx = load_hospital(spark, sf_dir).transactions
    base = scratch_path(spark, "stream-bronze")
    first = F.col("type").isin("Consultation", "Lab Fee")
    for i, part in enumerate([tx.where(first), tx.where(~first)]):
        tables.to_bronze(part, "transactions").write.mode("overwrite").parquet(f"{base}/landing/a{i}")
        inc.stream_bronze_append(spark, f"{base}/landing/*", "transactions", f"{base}/bronze",
                                 f"{base}/ck").awaitTermination()
    return _tx_out(tables.read_bronze_table(spark, f"{base}/bronze", "transactions"))


@_raw("stream_silver_upsert")
def _q_stream_silver_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrival 1: the upsert target rows; arrival 2: the changed / new rows.
    Silver after both micro-batches."""
    from ..session import scratch_path
    from ..streaming import incremental as inc
    base, tx = scratch_path(spark, "stream-silver"), load_hospital(spark, sf_dir).transactions
    tx.write.option("compression", "zstd").parquet(f"{base}/all")  # both arrivals are cut from it
    target, source = upsert_fixture(spark.read.schema(tx.schema).parquet(f"{base}/all"))
    for i, part in enumerate([target, source]):
        tables.to_bronze(part, "transactions").write.option("compression", "zstd").mode("overwrite").parquet(f"{base}/landing/a{i}")
        src = inc.bronze_stream(spark, f"{base}/landing/*", "transactions")
        inc.stream_silver_upsert(spark, src, f"{base}/silver", f"{base}/ck").awaitTermination()
    return _tx_out(inc.read_silver(spark, f"{base}/silver"))


@_raw("stream_pipeline_counts")
def _q_stream_pipeline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..session import scratch_path
    from ..streaming import incremental as inc
    h = load_hospital(spark, sf_dir)
    base = scratch_path(spark, "stream-counts")
    streams = {}
    for name in S.TABLES:
        tables.to_bronze(getattr(h, name), name).write.mode("overwrite").parquet(f"{base}/landing/{name}")
        streams[name] = inc.bronze_stream(spark, f"{base}/landing/{name}", name)
    inc.stream_pipeline_counts(streams, f"{base}/counts", f"{base}/ck").awaitTermination()
    return inc.read_complete(spark, f"{base}/counts", inc.COUNTS_SCHEMA)


@register("export_csv_text")
def _export_csv_text(h: Hospital) -> DataFrame:
    """The exported transaction CSV values as written (number text, ISO time)."""
    df = tables.csv_text_frame(h.transactions, "transactions")
    return df.withColumn("date", X.iso_timestamp("date"))


@_raw("jdbc_snapshot")
def _q_jdbc_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relational snapshot with an explicit column list and no filter (the
    orders table, read through the snapshot reader's non-JDBC path)."""
    return tables.jdbc_snapshot(spark, f"{sf_dir.rstrip('/')}/orders.parquet", "orders",
                                ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"])


@_raw("stream_gold_dept_totals")
def _q_stream_gold_dept_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold department totals maintained by a streaming aggregation over two
    arrivals of charges; equals the batch Gold view."""
    from ..session import scratch_path
    from ..streaming import incremental as inc
    tx = load_hospital(spark, sf_dir).transactions
    base = scratch_path(spark, "stream-gold")
    first = F.col("type").isin("Consultation", "Lab Fee")
    for i, part in enumerate([tx.where(first), tx.where(~first)]):
        tables.to_bronze(part, "transactions").write.mode("overwrite").parquet(f"{base}/landing/a{i}")
        inc.stream_gold_dept_totals(inc.bronze_stream(spark, f"{base}/landing/*", "transactions"), f"{base}/totals",
                                    f"{base}/ck").awaitTermination()
    return _doubles(inc.read_complete(spark, f"{base}/totals", inc.DEPT_TOTALS_SCHEMA), "total_revenue")


@_raw("stream_growth_history")
def _q_stream_growth_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth history kept by the stream over two arrivals (labelled months
    2024-05 and 2024-06): each month holds the running totals after its batch."""
    from ..session import scratch_path
    from ..streaming import incremental as inc
    from ..streaming.growth import read_growth_history, stream_growth_history
    h = load_hospital(spark, sf_dir)
    base = scratch_path(spark, "stream-growth")
    splits = {"patients": F.col("category") == "Inpatient", "appointments": F.col("status") == "Completed",
              "transactions": F.col("type").isin("Consultation", "Lab Fee")}
    for i, month in enumerate(["2024-05", "2024-06"]):
        streams = {}
        for name, cond in splits.items():
            part = getattr(h, name).where(cond if i == 0 else ~cond)
            tables.to_bronze(part, name).write.mode("overwrite").parquet(f"{base}/landing/{name}/a{i}")
            streams[name] = inc.bronze_stream(spark, f"{base}/landing/{name}/*", name)
        stream_growth_history(spark, streams, f"{base}/history", f"{base}/ck", month=month).awaitTermination()
    return read_growth_history(spark, f"{base}/history")


# -- column expressions, sinks and refresh under the correctness gate ------------

@register("month_bucket")
def _month_bucket(h: Hospital) -> DataFrame:
    return h.transactions.select("id", X.month_bucket("date").alias("month"))


@register("day_bucket")
def _day_bucket(h: Hospital) -> DataFrame:
    return h.appointments.select("id", X.day_bucket("appointment_date").alias("day"))


@register("to_api_names")
def _to_api_names(h: Hospital) -> DataFrame:
    return X.to_api_names(h.doctors, "doctors")


@register("to_api_types")
def _to_api_types(h: Hospital) -> DataFrame:
    return X.to_api_types(h.departments, "departments")


@register("with_lineage")
def _with_lineage(h: Hospital) -> DataFrame:
    out = quality.silver_patients(h.patients)  # adds _silver_processed_at
    return out.select("id", F.col("_silver_processed_at").isNotNull().alias("lineage_set"))


@register("conditional_value")
def _conditional_value(h: Hospital) -> DataFrame:
    return h.appointments.select("id", X.completed_revenue().cast("double").alias("completed_revenue"))


@register("null_to_zero")
def _null_to_zero(h: Hospital) -> DataFrame:
    """Doctors' Completed revenue, 0 for doctors without any."""
    per = (h.appointments.where(F.col("status") == "Completed")
           .groupBy(F.col("doctor_id").alias("id")).agg(F.sum("revenue_generated").alias("s")))
    return h.doctors.select("id").join(per, "id", "left").select(
        "id", X.null_to_zero("s").cast("double").alias("revenue"))


@register("pack_growth_history")
def _pack_growth_history(h: Hospital) -> DataFrame:
    return X.pack_growth_history(growth_history(h.patients, h.appointments, h.transactions))


@_raw("load_bronze_csv")
def _q_load_bronze_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export the charges as CSV, load the CSV into Bronze (append), read back."""
    from ..session import scratch_path
    tx = load_hospital(spark, sf_dir).transactions
    base = scratch_path(spark, "csv-roundtrip")
    tables.export_csv(tx, "transactions", f"{base}/landing", ordered=False)
    return _tx_out(tables.load_bronze_csv(spark, f"{base}/landing", "transactions", f"{base}/bronze"))


@_raw("bronze_full_refresh")
def _q_bronze_full_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refresh all five Bronze tables; the per-table report without durations."""
    from ..session import scratch_path
    h = load_hospital(spark, sf_dir)
    rep = tables.bronze_full_refresh(spark, h.as_dict(), scratch_path(spark, "refresh"))
    return rep.select("table", "success", "rows")


@_raw("sync_status")
def _q_sync_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..session import scratch_path
    h = load_hospital(spark, sf_dir)
    rep = tables.bronze_full_refresh(spark, h.as_dict(), scratch_path(spark, "refresh"))
    return metrics.sync_status(rep).withColumn("last_sync_time", F.col("last_sync_time").isNotNull())


@_raw("sync_report")
def _q_sync_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a refresh in which one source fails (departments are read with
    a column that cannot be computed)."""
    from ..session import scratch_path
    h = load_hospital(spark, sf_dir)
    sources = dict(h.as_dict())
    sources["departments"] = h.departments.withColumn("beds_total", F.raise_error(F.lit("no source")).cast("int"))
    rep = tables.bronze_full_refresh(spark, sources, scratch_path(spark, "refresh"))
    return metrics.sync_report(rep).select("table", "success", "rows", (F.col("duration_ms") >= 0).alias("timed"),
                                           F.col("error").contains("no source").alias("failed"), "total_rows")


def _row_text(df: DataFrame, table: str) -> DataFrame:
    """(table, id, text of all columns) of rows in the Bronze form."""
    cols = [X.iso_timestamp(c) if c in S.TIMESTAMP_COLUMNS[table] else F.col(c).cast("string")
            for c in S.storage_columns(table)]
    text = F.concat_ws("|", *[F.coalesce(c, F.lit("null")) for c in cols])
    return df.select(F.lit(table).alias("table"), "id", text.alias("row"))


def _round_trip(spark: SparkSession, sf_dir: str, export, read, **options) -> DataFrame:
    from ..session import scratch_path
    base = scratch_path(spark, "export")
    out = []
    for name, df in load_hospital(spark, sf_dir).as_dict().items():
        export(df, name, f"{base}/{name}", **options)
        out.append(_row_text(tables.to_bronze(read(spark, f"{base}/{name}", name), name), name))
    return reduce(DataFrame.unionByName, out)


@_raw("export_csv")
def _q_export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five tables exported as CSV files and read back."""
    return _round_trip(spark, sf_dir, tables.export_csv, tables.read_export_csv)


@_raw("export_json")
def _q_export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five tables exported as JSON lines (files compressed) and read back."""
    return _round_trip(spark, sf_dir, tables.export_json, tables.read_export_json, compression="gzip")


@register("patient_register_info")
def _patient_register_info(h: Hospital) -> DataFrame:
    """Total, states and categories that the patient register shows beside a page."""
    reg = registers.patient_register(h.patients, page_no=1, category="Inpatient")
    total = reg["info"].select(F.lit("total").alias("part"), F.col("total").cast("string").alias("value"))
    states = reg["states"].select(F.lit("state").alias("part"), F.col("state").alias("value"))
    cats = reg["categories"].select(F.lit("category").alias("part"), F.col("category").alias("value"))
    return total.unionByName(states).unionByName(cats)


from . import mechanisms  # noqa: E402, F401 - registers its queries
