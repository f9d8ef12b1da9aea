"""Hospital tables derived from the driver's TPC-H style parquet tables.

The test data has no hospital tables; these functions derive the five of them
with DataFrame plans (numeric join keys, lazily, nothing collected).  The same
mapping is written once more as SQL text (``FIXTURE_CTE``) for the DuckDB
oracles; both were checked equal row by row.

Scale notes: ``transactions`` is lineitem x orders (shuffle on the order key,
the only large-large join), x supplier (shuffle, or broadcast when Spark's
size check allows), x nation (25 rows, always under the broadcast threshold).
The supplier is joined alone, not pre-joined with nation: a pre-joined pair
gets a join-product size estimate that defeats the planner's broadcast check.
Nothing here carries an explicit broadcast hint for a table that grows.
From ``LARGE_BYTES`` of lineitem and orders on, both are dealt by order key into
parts of about ``PART_BYTES``, whatever the session's shuffle partitions are: what
a task of the join sorts does not grow with the tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_utc, input_bytes

#: Bytes of lineitem and orders files for one task of their join, and from which on
#: they are dealt out so; smaller ones (orders may be broadcast) are left to Spark.
PART_BYTES = 8 << 20
LARGE_BYTES = 128 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ts(col: str):
    # driver parquet timestamps arrive as timestamp_ntz; hospital tables use
    # TIMESTAMP in the (UTC) session zone
    return F.col(col).cast("timestamp")


def departments(nation: DataFrame) -> DataFrame:
    k = "n_nationkey"
    return nation.select(
        F.concat(F.lit("DEP_"), F.lpad(F.col(k).cast("string"), 4, "0")).alias("id"),
        F.col("n_name").alias("name"),
        F.expr(f"CAST(15 + ({k}*7) % 46 AS INT)").alias("beds_total"),
        F.expr(f"CAST(4 + ({k}*5) % 11 AS INT)").alias("beds_occupied"),
        F.expr(f"CAST(4.0 + ({k} % 10) * 0.1 AS DECIMAL(2,1))").alias("kpi_satisfaction"),
        F.expr(f"CAST(12 + ({k}*3) % 31 AS INT)").alias("avg_wait_time"),
    )


def doctors(supplier: DataFrame, nation: DataFrame, keep_key: bool = False) -> DataFrame:
    s = supplier.select("s_suppkey", "s_name", "s_nationkey")
    n = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name"))
    cols = [
        F.concat(F.lit("DR"), F.col("s_suppkey").cast("string")).alias("id"),
        F.col("s_name").alias("name"),
        F.col("n_name").alias("department"),
        F.expr("CAST(5 + (s_suppkey*11) % 31 AS INT)").alias("experience"),
        F.expr("CAST(100 + (s_suppkey*37) % 251 AS INT)").alias("consultation_fee"),
        F.expr("CAST(60 + (s_suppkey*13) % 31 AS INT)").alias("utilization"),
    ]
    if keep_key:
        cols.append(F.col("s_suppkey"))
    return s.join(n, "s_nationkey").select(*cols)


def patients(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    c = customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    r = region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    k = "c_custkey"
    return c.join(n, "c_nationkey").join(r, "n_regionkey").select(
        F.concat(F.lit("PT"), F.col(k).cast("string")).alias("id"),
        F.col("c_name").alias("name"),
        F.expr(f"CAST({k} % 125 AS INT)").alias("age"),
        F.expr(f"CASE WHEN {k} % 2 = 0 THEN 'Male' WHEN {k} % 31 = 0 THEN 'Other' ELSE 'Female' END")
        .alias("gender"),
        F.expr(f"CASE {k} % 8 WHEN 0 THEN 'A+' WHEN 1 THEN 'A-' WHEN 2 THEN 'B+' WHEN 3 THEN 'B-' "
               f"WHEN 4 THEN 'AB+' WHEN 5 THEN 'AB-' WHEN 6 THEN 'O+' ELSE 'O-' END").alias("blood_group"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("state"),
        F.expr(f"CAST(date_sub(DATE'2024-12-31', CAST(({k}*17) % 365 AS INT)) AS TIMESTAMP)")
        .alias("registration_date"),
        F.expr(f"CASE WHEN {k} % 5 = 4 THEN 'Self-Pay' ELSE c_mktsegment END").alias("insurance_provider"),
        F.expr(f"CASE {k} % 3 WHEN 0 THEN 'Inpatient' WHEN 1 THEN 'Outpatient' ELSE 'ER' END")
        .alias("category"),
    )


def appointments(orders: DataFrame, supplier: DataFrame, doctors_keyed: DataFrame) -> DataFrame:
    """orders -> appointments; the doctor is (orderkey*7) mod (#suppliers - 1).

    The supplier count is a scalar subquery (one tiny job), never collected by hand.
    """
    n_doc = supplier.agg(F.count(F.lit(1)) - 1).scalar()
    o = orders.select("o_orderkey", "o_custkey", "o_orderdate").withColumn(
        "s_suppkey", (F.col("o_orderkey") * 7) % n_doc)
    d = doctors_keyed.select("s_suppkey", F.col("id").alias("doctor_id"), "department", "consultation_fee")
    k = "o_orderkey"
    status = F.expr(f"CASE WHEN {k} % 10 = 4 THEN 'Cancelled' WHEN {k} % 10 = 5 THEN 'Rescheduled' "
                    f"WHEN {k} % 10 = 3 THEN 'Scheduled' ELSE 'Completed' END")
    return o.join(d, "s_suppkey").select(
        F.concat(F.lit("AP"), F.col(k).cast("string")).alias("id"),
        F.concat(F.lit("PT"), F.col("o_custkey").cast("string")).alias("patient_id"),
        "doctor_id",
        "department",
        _ts("o_orderdate").alias("appointment_date"),
        F.expr(f"CAST(15 * (1 + {k} % 4) AS INT)").alias("duration"),
        status.alias("status"),
        F.when(status == "Cancelled", F.lit(0)).otherwise(F.col("consultation_fee"))
        .cast("decimal(10,2)").alias("revenue_generated"),
    )


def join_parts(spark: SparkSession, sf_dir: str) -> int | None:
    """Tasks for the join of lineitem and orders; None for small tables."""
    size = input_bytes(spark, *[f"{sf_dir.rstrip('/')}/{n}.parquet" for n in ("lineitem", "orders")])
    return None if size < LARGE_BYTES else max(-(-size // PART_BYTES), spark.sparkContext.defaultParallelism)


def transactions(lineitem: DataFrame, orders: DataFrame, supplier: DataFrame,
                 nation: DataFrame, parts: int | None = None) -> DataFrame:
    li = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                         "l_extendedprice", "l_discount", "l_shipdate")
    o = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    if parts:
        li, o = li.repartition(parts, "l_orderkey"), o.repartition(parts, "l_orderkey")
    s = supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    n = nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    zero_line = F.col("l_linenumber") == 7
    self_pay = F.col("o_custkey") % 5 == 4
    ln4 = F.col("l_linenumber") % 4
    ln3 = F.col("l_linenumber") % 3
    return li.join(o, "l_orderkey").join(s, "l_suppkey").join(n, "s_nationkey").select(
        F.concat(F.lit("TX"), F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string"), F.lit("-"),
                 F.col("l_partkey").cast("string"), F.lit("-"),
                 F.col("l_suppkey").cast("string")).alias("id"),
        F.concat(F.lit("PT"), F.col("o_custkey").cast("string")).alias("patient_id"),
        F.when(ln4 == 1, F.concat(F.lit("AP"), F.col("l_orderkey").cast("string"))).alias("appointment_id"),
        _ts("l_shipdate").alias("date"),
        F.when(zero_line, F.lit(0.0)).otherwise(F.col("l_extendedprice")).cast("decimal(10,2)").alias("amount"),
        F.when(ln4 == 1, "Consultation").when(ln4 == 2, "Lab Fee").when(ln4 == 3, "Pharmacy")
        .otherwise("Emergency Services").alias("type"),
        F.when(zero_line | self_pay, F.lit(0.0))
        .otherwise(F.col("l_extendedprice") * F.col("l_discount") * 8)
        .cast("decimal(10,2)").alias("insurance_coverage"),
        F.when(~self_pay, "Insurance").when(ln3 == 0, "Cash").when(ln3 == 1, "Credit Card")
        .otherwise("Debit Card").alias("payment_type"),
        F.col("n_name").alias("department"),
    )


def metric_samples(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_type").alias("metric"), _ts("ts").alias("ts"), F.col("value"),
                         F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("labels"))


@dataclass
class Hospital:
    """The five hospital tables (lazy DataFrames) plus metric samples; ``parts`` is the
    number of tasks that large charges are dealt to (``join_parts``)."""

    departments: DataFrame
    doctors: DataFrame
    patients: DataFrame
    appointments: DataFrame
    transactions: DataFrame
    metric_samples: DataFrame
    parts: int | None = None

    def as_dict(self) -> dict[str, DataFrame]:
        return {"departments": self.departments, "doctors": self.doctors, "patients": self.patients,
                "appointments": self.appointments, "transactions": self.transactions}

    def register(self) -> None:
        for name, df in self.as_dict().items():
            df.createOrReplaceTempView(name)


def load_hospital(spark: SparkSession, sf_dir: str) -> Hospital:
    """The hospital tables over ``sf_dir``, as lazy plans over the files that are
    there now."""
    ensure_utc(spark)
    return _build_hospital(spark, sf_dir)


def _build_hospital(spark: SparkSession, sf_dir: str) -> Hospital:
    t = {n: read_table(spark, sf_dir, n) for n in
         ("region", "nation", "customer", "supplier", "orders", "lineitem", "events")}
    doc_keyed = doctors(t["supplier"], t["nation"], keep_key=True)
    parts = join_parts(spark, sf_dir)
    return Hospital(
        departments=departments(t["nation"]),
        doctors=doc_keyed.drop("s_suppkey"),
        patients=patients(t["customer"], t["nation"], t["region"]),
        appointments=appointments(t["orders"], t["supplier"], doc_keyed),
        transactions=transactions(t["lineitem"], t["orders"], t["supplier"], t["nation"], parts),
        metric_samples=metric_samples(t["events"]),
        parts=parts,
    )


def materialize_bronze(spark: SparkSession, sf_dir: str, bronze_dir: str,
                       max_records_per_file: int = 2_000_000, cluster: str = "sort") -> DataFrame:
    """Ingest: write the five hospital tables derived from ``sf_dir`` as Bronze
    Parquet under ``bronze_dir`` (tables in parallel, rows sorted by time within
    each file).  The file cap defaults to about 128 MB of charges per file;
    small local runs pass a lower cap to get several files per table.  Returns
    the refresh report (one row per table)."""
    from .tables import bronze_full_refresh
    h = load_hospital(spark, sf_dir)
    return bronze_full_refresh(spark, h.as_dict(), bronze_dir, sort_by_time=True,
                               max_records_per_file=max_records_per_file, cluster=cluster)


def load_bronze_hospital(spark: SparkSession, bronze_dir: str, sf_dir: str) -> Hospital:
    """The hospital tables read back from materialized Bronze (metric samples
    still come from the events table)."""
    from .tables import read_bronze
    ensure_utc(spark)
    b = read_bronze(spark, bronze_dir)
    return Hospital(departments=b["departments"], doctors=b["doctors"], patients=b["patients"],
                    appointments=b["appointments"], transactions=b["transactions"],
                    metric_samples=metric_samples(read_table(spark, sf_dir, "events")))


# The same mapping as SQL text, for DuckDB oracles: ``FIXTURE_CTE + "SELECT ..."``.
FIXTURE_CTE = """WITH departments AS (
 SELECT concat('DEP_', lpad(CAST(n_nationkey AS VARCHAR), 4, '0')) AS id, n_name AS name,
  CAST(15 + (n_nationkey*7) % 46 AS INT) AS beds_total, CAST(4 + (n_nationkey*5) % 11 AS INT) AS beds_occupied,
  CAST(4.0 + (n_nationkey % 10) * 0.1 AS DECIMAL(2,1)) AS kpi_satisfaction,
  CAST(12 + (n_nationkey*3) % 31 AS INT) AS avg_wait_time
 FROM nation
), doctors AS (
 SELECT concat('DR', CAST(s_suppkey AS VARCHAR)) AS id, s_name AS name, n_name AS department,
  CAST(5 + (s_suppkey*11) % 31 AS INT) AS experience, CAST(100 + (s_suppkey*37) % 251 AS INT) AS consultation_fee,
  CAST(60 + (s_suppkey*13) % 31 AS INT) AS utilization
 FROM supplier JOIN nation ON s_nationkey = n_nationkey
), patients AS (
 SELECT concat('PT', CAST(c_custkey AS VARCHAR)) AS id, c_name AS name, CAST(c_custkey % 125 AS INT) AS age,
  CASE WHEN c_custkey % 2 = 0 THEN 'Male' WHEN c_custkey % 31 = 0 THEN 'Other' ELSE 'Female' END AS gender,
  CASE c_custkey % 8 WHEN 0 THEN 'A+' WHEN 1 THEN 'A-' WHEN 2 THEN 'B+' WHEN 3 THEN 'B-' WHEN 4 THEN 'AB+' WHEN 5 THEN 'AB-' WHEN 6 THEN 'O+' ELSE 'O-' END AS blood_group,
  n_name AS city, r_name AS state,
  CAST(DATE '2024-12-31' AS TIMESTAMP) - CAST((c_custkey*17) % 365 AS INT) * INTERVAL '1' DAY AS registration_date,
  CASE WHEN c_custkey % 5 = 4 THEN 'Self-Pay' ELSE c_mktsegment END AS insurance_provider,
  CASE c_custkey % 3 WHEN 0 THEN 'Inpatient' WHEN 1 THEN 'Outpatient' ELSE 'ER' END AS category
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), appointments AS (
 SELECT a.id, a.patient_id, d.id AS doctor_id, d.department, a.appointment_date, a.duration, a.status,
  CAST(CASE WHEN a.status = 'Cancelled' THEN 0 ELSE d.consultation_fee END AS DECIMAL(10,2)) AS revenue_generated
 FROM (SELECT concat('AP', CAST(o_orderkey AS VARCHAR)) AS id, concat('PT', CAST(o_custkey AS VARCHAR)) AS patient_id,
   concat('DR', CAST((o_orderkey*7) % (SELECT count(*) - 1 FROM supplier) AS VARCHAR)) AS doctor_id,
   CAST(o_orderdate AS TIMESTAMP) AS appointment_date,
   CAST(15 * (1 + o_orderkey % 4) AS INT) AS duration,
   CASE WHEN o_orderkey % 10 = 4 THEN 'Cancelled' WHEN o_orderkey % 10 = 5 THEN 'Rescheduled' WHEN o_orderkey % 10 = 3 THEN 'Scheduled' ELSE 'Completed' END AS status
  FROM orders) a JOIN doctors d ON a.doctor_id = d.id
), transactions AS (
 SELECT concat('TX', CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR), '-', CAST(l_partkey AS VARCHAR), '-', CAST(l_suppkey AS VARCHAR)) AS id,
  concat('PT', CAST(o_custkey AS VARCHAR)) AS patient_id,
  CASE WHEN l_linenumber % 4 = 1 THEN concat('AP', CAST(l_orderkey AS VARCHAR)) END AS appointment_id,
  CAST(l_shipdate AS TIMESTAMP) AS date,
  CAST(CASE WHEN l_linenumber = 7 THEN 0 ELSE l_extendedprice END AS DECIMAL(10,2)) AS amount,
  CASE l_linenumber % 4 WHEN 1 THEN 'Consultation' WHEN 2 THEN 'Lab Fee' WHEN 3 THEN 'Pharmacy' ELSE 'Emergency Services' END AS type,
  CAST(CASE WHEN l_linenumber = 7 OR o_custkey % 5 = 4 THEN 0 ELSE l_extendedprice * l_discount * 8 END AS DECIMAL(10,2)) AS insurance_coverage,
  CASE WHEN o_custkey % 5 <> 4 THEN 'Insurance' WHEN l_linenumber % 3 = 0 THEN 'Cash' WHEN l_linenumber % 3 = 1 THEN 'Credit Card' ELSE 'Debit Card' END AS payment_type,
  n_name AS department
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
), metric_samples AS (
 SELECT event_type AS metric, CAST(ts AS TIMESTAMP) AS ts, value, user_id FROM events
)
"""
