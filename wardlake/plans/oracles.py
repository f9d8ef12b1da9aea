"""Independent DuckDB SQL for every registered query.

Each string is ``FIXTURE_CTE`` (the hospital tables over the driver tables)
followed by a plain SELECT written from the operator's semantics, not from the
Spark code.  Money: exact decimal sums cast to DOUBLE; averages as
CAST(SUM AS DOUBLE) / COUNT; half-up rounding as FLOOR(x + 0.5).
"""

from __future__ import annotations

from ..sources.fixtures import FIXTURE_CTE

_Q: dict[str, str] = {}


def q(name: str, body: str) -> None:
    _Q[name] = FIXTURE_CTE + body


# -- §2.5 aggregates --------------------------------------------------------

q("dept_profitability", """
SELECT r.department, r.revenue,
  CAST(COALESCE(NULLIF(c.cost, 0), 15000) AS BIGINT) AS cost,
  r.revenue - CAST(COALESCE(NULLIF(c.cost, 0), 15000) AS BIGINT) AS profit
FROM (SELECT department, CAST(FLOOR(COALESCE(SUM(amount), 0) + 0.5) AS BIGINT) AS revenue
      FROM transactions GROUP BY department) r
LEFT JOIN (SELECT name, MAX(25000 + beds_occupied * 450 + avg_wait_time * 150) AS cost
           FROM departments GROUP BY name) c ON r.department = c.name
ORDER BY revenue DESC, department
""")

q("table_counts", """
SELECT 'departments' AS "table", COUNT(*) AS "rows" FROM departments
UNION ALL SELECT 'doctors', COUNT(*) FROM doctors
UNION ALL SELECT 'patients', COUNT(*) FROM patients
UNION ALL SELECT 'appointments', COUNT(*) FROM appointments
UNION ALL SELECT 'transactions', COUNT(*) FROM transactions
""")

q("pipeline_rollup", """
SELECT d.n AS departments, dr.n AS doctors, p.n AS patients, a.n AS appointments, t.n AS transactions,
  d.n + dr.n + p.n + a.n + t.n AS total, d.n + dr.n + p.n + a.n + t.n AS silver_records_processed
FROM (SELECT COUNT(*) AS n FROM departments) d, (SELECT COUNT(*) AS n FROM doctors) dr,
     (SELECT COUNT(*) AS n FROM patients) p, (SELECT COUNT(*) AS n FROM appointments) a,
     (SELECT COUNT(*) AS n FROM transactions) t
""")

q("kpi_summary", """
SELECT (SELECT COUNT(*) FROM patients) AS total_patients,
  (SELECT COUNT(*) FROM patients WHERE category = 'Inpatient') AS active_patients,
  (SELECT COUNT(*) FROM appointments) AS total_appointments,
  (SELECT CAST(COALESCE(SUM(amount), 0) AS DOUBLE) FROM transactions) AS revenue_total,
  (SELECT FLOOR(COALESCE(CAST(SUM(utilization) AS DOUBLE) / NULLIF(COUNT(utilization), 0), 0) * 10 + 0.5) / 10
     FROM doctors) AS avg_doctor_utilization,
  (SELECT FLOOR(COALESCE(CAST(SUM(kpi_satisfaction) AS DOUBLE) / NULLIF(COUNT(kpi_satisfaction), 0), 0) * 10 + 0.5) / 10
     FROM departments) AS patient_satisfaction
""")

q("appointment_trend", """
SELECT date, count FROM (
  SELECT strftime(appointment_date, '%Y-%m-%d') AS date, COUNT(*) AS count
  FROM appointments GROUP BY 1 ORDER BY date DESC LIMIT 10) ORDER BY date
""")

q("insurance_utilization", """
, by_patient AS (SELECT patient_id, COUNT(*) AS charges, SUM(amount) AS billed FROM transactions GROUP BY patient_id)
SELECT insurance_provider AS provider, CAST(SUM(charges) AS BIGINT) AS count,
  CAST(FLOOR(COALESCE(SUM(billed), 0) + 0.5) AS BIGINT) AS total_revenue
FROM by_patient JOIN patients ON patients.id = by_patient.patient_id
GROUP BY insurance_provider ORDER BY count DESC, provider
""")

q("monthly_revenue", """
SELECT strftime(date, '%Y-%m') AS month, type, CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS total
FROM transactions GROUP BY 1, 2
ORDER BY month DESC, type
""")

q("monthly_revenue_trend", """
, per AS (
  SELECT strftime(date, '%Y-%m') AS month, type, CAST(FLOOR(SUM(amount) + 0.5) AS BIGINT) AS amt
  FROM transactions GROUP BY 1, 2),
piv AS (
  SELECT month,
    CAST(SUM(CASE WHEN type = 'Consultation' THEN amt ELSE 0 END) AS BIGINT) AS consultation,
    CAST(SUM(CASE WHEN type = 'Lab Fee' THEN amt ELSE 0 END) AS BIGINT) AS lab,
    CAST(SUM(CASE WHEN type = 'Pharmacy' THEN amt ELSE 0 END) AS BIGINT) AS pharmacy,
    CAST(SUM(CASE WHEN type = 'Emergency Services' THEN amt ELSE 0 END) AS BIGINT) AS emergency,
    CAST(SUM(amt) AS BIGINT) AS total
  FROM per GROUP BY month)
SELECT * FROM (SELECT * FROM piv ORDER BY month DESC LIMIT 12) ORDER BY month
""")

q("doctor_performance", """
, seen AS (SELECT doctor_id, COUNT(*) AS visits, SUM(revenue_generated) FILTER (WHERE status = 'Completed') AS earned
  FROM appointments GROUP BY doctor_id),
board AS (SELECT id, name, department, utilization, COALESCE(visits, 0) AS visits, COALESCE(earned, 0) AS earned
  FROM doctors LEFT JOIN seen ON seen.doctor_id = doctors.id)
SELECT name AS doctor_name, department, CAST(visits AS BIGINT) AS appointments,
  CAST(FLOOR(earned + 0.5) AS BIGINT) AS revenue, utilization
FROM board ORDER BY earned DESC, id
""")

q("gold_dept_profitability", """
SELECT department, CAST(SUM(amount) AS DOUBLE) AS total_revenue, COUNT(*) AS transaction_count
FROM transactions GROUP BY department
ORDER BY SUM(amount) DESC, department
""")

q("gold_monthly_revenue", """
SELECT strftime(date, '%Y-%m') AS month, type, CAST(SUM(amount) AS DOUBLE) AS total
FROM transactions GROUP BY 1, 2
ORDER BY month DESC, type
""")

q("gold_insurance_utilization", """
SELECT p.insurance_provider, COUNT(*) AS count, CAST(SUM(t.amount) AS DOUBLE) AS total_revenue
FROM transactions t JOIN patients p ON t.patient_id = p.id GROUP BY p.insurance_provider
""")

q("patient_demographics", """
SELECT state, category, COUNT(*) AS count FROM patients GROUP BY state, category
ORDER BY count DESC, state, category LIMIT 20
""")

q("coverage_analysis", """
, by_patient AS (SELECT patient_id, COUNT(*) AS charges, SUM(amount) AS billed, SUM(insurance_coverage) AS paid
  FROM transactions GROUP BY patient_id)
SELECT insurance_provider, CAST(SUM(charges) AS BIGINT) AS count, CAST(SUM(billed) AS DOUBLE) AS total_billed,
  CAST(SUM(paid) AS DOUBLE) AS total_covered
FROM by_patient JOIN patients ON patients.id = by_patient.patient_id GROUP BY insurance_provider
""")

q("top_earners", """
, earned AS (SELECT doctor_id, SUM(revenue_generated) AS total FROM appointments WHERE status = 'Completed' GROUP BY doctor_id),
ranked AS (SELECT doctors.*, total, row_number() OVER (ORDER BY total DESC, id) AS place
  FROM earned JOIN doctors ON doctors.id = earned.doctor_id)
SELECT name, department, experience, CAST(total AS DOUBLE) AS total_earned FROM ranked WHERE place <= 5 ORDER BY place
""")

q("insurer_billing_stats", """
, by_patient AS (SELECT patient_id, COUNT(*) AS charges, COUNT(amount) AS priced, SUM(amount) AS billed,
    SUM(insurance_coverage) AS paid FROM transactions WHERE payment_type = 'Insurance' GROUP BY patient_id)
SELECT insurance_provider, CAST(SUM(charges) AS BIGINT) AS trans_count,
  CAST(SUM(billed) AS DOUBLE) / NULLIF(SUM(priced), 0) AS avg_claim_cost, CAST(SUM(paid) AS DOUBLE) AS total_insured_payout
FROM by_patient JOIN patients ON patients.id = by_patient.patient_id
GROUP BY insurance_provider ORDER BY trans_count DESC, insurance_provider
""")

q("provider_billing_local", """
SELECT COALESCE(NULLIF(p.insurance_provider, ''), 'Self-Pay') AS insurance_provider, COUNT(*) AS trans_count,
  CAST(FLOOR(SUM(t.amount) / COUNT(*) + 0.5) AS BIGINT) AS avg_claim_cost,
  CAST(SUM(t.insurance_coverage) AS DOUBLE) AS total_insured_payout
FROM transactions t LEFT JOIN patients p ON t.patient_id = p.id
GROUP BY 1
""")

q("distinct_states", """
SELECT DISTINCT state FROM patients ORDER BY state
""")

q("insurer_total", """
SELECT CAST(COALESCE(SUM(total_revenue), 0) AS BIGINT) AS total FROM (
  SELECT p.insurance_provider, CAST(FLOOR(SUM(t.amount) + 0.5) AS BIGINT) AS total_revenue
  FROM transactions t JOIN patients p ON t.patient_id = p.id GROUP BY 1)
""")

q("insurer_share", """
SELECT provider, total_revenue, CAST(total_revenue AS DOUBLE) * 100 / SUM(total_revenue) OVER () AS share_pct FROM (
  SELECT p.insurance_provider AS provider, CAST(FLOOR(SUM(t.amount) + 0.5) AS BIGINT) AS total_revenue
  FROM transactions t JOIN patients p ON t.patient_id = p.id GROUP BY 1)
""")


ISO = "strftime({c}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


def iso(c: str) -> str:
    return ISO.format(c=c)


TX_OUT = ("id, patient_id, appointment_id, " + iso("date") + " AS date, CAST(amount AS DOUBLE) AS amount, type, "
          "CAST(insurance_coverage AS DOUBLE) AS insurance_coverage, payment_type, department")

UPSERT = """, tgt AS (SELECT * FROM transactions WHERE type <> 'Emergency Services'),
src AS (
  SELECT id, patient_id, appointment_id,
    CASE WHEN type = 'Pharmacy' THEN date + (CASE WHEN CAST(right(id, 1) AS INT) % 2 = 0 THEN 1 ELSE -1 END) * INTERVAL 1 DAY
         ELSE date END AS date,
    CAST(amount + 10 AS DECIMAL(10,2)) AS amount, type, insurance_coverage, 'Cash' AS payment_type,
    'CHANGED' AS department
  FROM transactions WHERE type IN ('Emergency Services', 'Pharmacy'))
"""

N = "CAST(regexp_replace(id, '[^0-9]', '', 'g') AS HUGEINT)"
# The tables with planted violations (registry.planted).
PLANTED = f"""
, p0 AS (SELECT * REPLACE (CASE WHEN {N} % 7 = 0 THEN NULL ELSE name END AS name,
    CASE WHEN {N} % 11 = 0 THEN 'Unknown' ELSE gender END AS gender,
    CASE WHEN {N} % 13 = 0 THEN 'C+' ELSE blood_group END AS blood_group) FROM patients),
pp AS (SELECT * FROM p0 UNION ALL SELECT * FROM p0 WHERE {N} % 37 = 0),
pa AS (SELECT * REPLACE (CASE WHEN {N} % 17 = 0 THEN 'NONE' || doctor_id ELSE doctor_id END AS doctor_id,
    CASE WHEN {N} % 19 = 0 THEN NULL ELSE appointment_date END AS appointment_date,
    CASE WHEN {N} % 23 = 0 THEN 'Lost' ELSE status END AS status) FROM appointments),
t0 AS (SELECT * REPLACE (CASE WHEN {N} % 29 = 0 THEN NULL ELSE amount END AS amount,
    CASE WHEN {N} % 31 = 0 THEN 'Gift' ELSE type END AS type) FROM transactions),
pt AS (SELECT * FROM t0 UNION ALL SELECT * FROM t0 WHERE {N} % 41 = 0),
pd AS (SELECT * REPLACE (CASE WHEN {N} % 3 = 0 THEN NULL ELSE department END AS department) FROM doctors),
pe AS (SELECT * REPLACE (CASE WHEN {N} % 5 = 0 THEN NULL ELSE avg_wait_time END AS avg_wait_time) FROM departments)
"""

# -- §2.1 -----------------------------------------------------------------------

q("scan_patients", f"""
SELECT id, name, age, gender, blood_group AS "bloodGroup", city, state,
  {iso('registration_date')} AS "registrationDate", insurance_provider AS "insuranceProvider", category
FROM patients ORDER BY id
""")

q("scan_appointments", f"""
SELECT id, patient_id AS "patientId", doctor_id AS "doctorId", department, {iso('appointment_date')} AS "appointmentDate",
  duration, status, CAST(revenue_generated AS DOUBLE) AS "revenueGenerated"
FROM appointments ORDER BY id
""")

q("scan_doctors", """
SELECT id, name, department, experience, consultation_fee AS "consultationFee", utilization FROM doctors ORDER BY id
""")

q("scan_departments", """
SELECT id, name, beds_total AS "bedsTotal", beds_occupied AS "bedsOccupied",
  CAST(kpi_satisfaction AS DOUBLE) AS "kpiSatisfaction", avg_wait_time AS "avgWaitTime"
FROM departments ORDER BY name
""")

_SCAN_TX = f"""
SELECT id, patient_id AS "patientId", appointment_id AS "appointmentId", {iso('date')} AS date,
  CAST(amount AS DOUBLE) AS amount, type, CAST(insurance_coverage AS DOUBLE) AS "insuranceCoverage",
  payment_type AS "paymentType", department
FROM transactions ORDER BY id
"""
q("scan_transactions", _SCAN_TX)
q("export_csv_frame", _SCAN_TX)

q("insert_ignore", UPSERT + f"""
, res AS (
  SELECT * FROM tgt
  UNION ALL
  SELECT * FROM (SELECT * FROM src s WHERE NOT EXISTS (SELECT 1 FROM tgt t WHERE t.id = s.id)
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY date, patient_id, appointment_id NULLS FIRST, amount,
      type, insurance_coverage, payment_type, department) = 1))
SELECT {TX_OUT} FROM res
""")

q("merge_upsert", UPSERT + f"""
, res AS (
  SELECT t.id, t.patient_id, t.appointment_id,
    CASE WHEN t.date < s.date THEN s.date ELSE t.date END AS date,
    CASE WHEN t.date < s.date THEN s.amount ELSE t.amount END AS amount,
    t.type,
    CASE WHEN t.date < s.date THEN s.insurance_coverage ELSE t.insurance_coverage END AS insurance_coverage,
    CASE WHEN t.date < s.date THEN s.payment_type ELSE t.payment_type END AS payment_type,
    t.department
  FROM tgt t LEFT JOIN src s ON t.id = s.id
  UNION ALL
  SELECT * FROM src s WHERE NOT EXISTS (SELECT 1 FROM tgt t WHERE t.id = s.id))
SELECT {TX_OUT} FROM res
""")

q("merge_stats", UPSERT + """
SELECT COUNT(*) AS source_rows, COUNT(t.id) AS matched,
  COUNT(*) FILTER (WHERE t.date < s.date) AS updated, COUNT(*) FILTER (WHERE t.id IS NULL) AS inserted
FROM src s LEFT JOIN tgt t ON s.id = t.id
""")

q("adhoc_sql", """
SELECT department, CAST(SUM(amount) AS DOUBLE) AS total_revenue, COUNT(*) AS transaction_count
FROM transactions GROUP BY department ORDER BY SUM(amount) DESC, department LIMIT 1000
""")

q("adhoc_sql_capped", """
SELECT id, CAST(amount AS DOUBLE) AS amount FROM transactions WHERE id IS NOT NULL AND amount > 0
ORDER BY amount DESC, id LIMIT 1000
""")

q("adhoc_row_count", """
SELECT COUNT(*) AS row_count FROM transactions WHERE type = 'Pharmacy'
""")

q("preset_top_earners", _Q["top_earners"][len(FIXTURE_CTE):])
q("preset_geriatric_inpatients", """
SELECT id, name, age, gender, blood_group, city FROM patients
WHERE age > 75 AND category = 'Inpatient' ORDER BY age DESC, id LIMIT 10
""")

# -- §2.2 -----------------------------------------------------------------------

q("out_of_pocket", """
SELECT id, CAST(amount - insurance_coverage AS DOUBLE) AS out_of_pocket FROM transactions
""")

q("utilization_band", """
SELECT id, utilization, CASE WHEN utilization > 85 THEN 'high' ELSE 'normal' END AS band FROM doctors
""")

q("time_buckets", """
SELECT id, strftime(date, '%Y-%m') AS month, strftime(date, '%Y-%m-%d') AS day FROM transactions
""")

q("round_half_up", """
SELECT id, CAST(FLOOR(insurance_coverage - amount + 0.5) AS BIGINT) AS rounded,
  FLOOR((CAST(ROUND((insurance_coverage - amount) * 100) AS BIGINT) + 20) / 40.0) / 10 AS rounded_1dp
FROM transactions
""")

q("entity_key", """
SELECT id, printf('PT%06d', CAST(substr(id, 3) AS BIGINT)) AS key,
  printf('PT%06d', CAST(substr(id, 3) AS BIGINT) * 1000) AS key_wide FROM patients
""")

q("api_shape_transactions", f"SELECT {TX_OUT} FROM transactions")

_GROWTH = """
, m AS (
  SELECT strftime(registration_date, '%Y-%m') AS ts, COUNT(*) AS p, 0 AS a, 0 AS t FROM patients
    WHERE registration_date IS NOT NULL GROUP BY 1
  UNION ALL SELECT strftime(appointment_date, '%Y-%m'), 0, COUNT(*), 0 FROM appointments
    WHERE appointment_date IS NOT NULL GROUP BY 1
  UNION ALL SELECT strftime(date, '%Y-%m'), 0, 0, COUNT(*) FROM transactions WHERE date IS NOT NULL GROUP BY 1),
g AS (SELECT ts, SUM(p) AS p, SUM(a) AS a, SUM(t) AS t FROM m GROUP BY ts),
c AS (SELECT ts AS "timestamp",
  CAST(SUM(p) OVER w AS {T}) AS "patientsCount", CAST(SUM(a) OVER w AS {T}) AS "appointmentsCount",
  CAST(SUM(t) OVER w AS {T}) AS "transactionsCount"
  FROM g WINDOW w AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT * FROM (SELECT * FROM c ORDER BY "timestamp" DESC LIMIT 12) ORDER BY "timestamp"
"""
q("growth_history", _GROWTH.replace("{T}", "BIGINT"))
q("growth_history_json", _GROWTH.replace("{T}", "INTEGER"))

# -- §2.3 -----------------------------------------------------------------------

q("filter_patients", """
SELECT id, name, state, category FROM patients WHERE state = 'ASIA' AND category = 'Inpatient'
""")

q("search_patients", """
SELECT id, name FROM patients WHERE lower(name) LIKE '%customer#00000_2%' OR lower(id) LIKE '%customer#00000_2%'
""")

q("filter_appointments", """
SELECT id, status, department FROM appointments WHERE status = 'Completed' AND department = 'NATION_3'
""")

q("filter_transactions", """
SELECT id, type, payment_type FROM transactions WHERE type = 'Pharmacy' AND payment_type = 'Cash'
""")

q("silver_patients", """
SELECT id, name, age FROM patients WHERE id IS NOT NULL AND name IS NOT NULL AND age > 0 AND age < 120
""")

q("silver_transactions", f"""
SELECT {TX_OUT} FROM transactions WHERE id IS NOT NULL AND amount > 0
""")

q("experienced_doctors", """
SELECT name, department, consultation_fee FROM doctors WHERE experience > 15
""")

q("geriatric_inpatients", """
SELECT id, name, age, gender, blood_group, city FROM patients
WHERE age > 75 AND category = 'Inpatient' ORDER BY age DESC, id LIMIT 10
""")

q("inpatient_count", """
SELECT COUNT(*) FILTER (WHERE category = 'Inpatient') AS inpatients FROM patients
""")

q("doctor_sample", """
SELECT id, name, department, consultation_fee, experience FROM doctors ORDER BY id LIMIT 10
""")

# -- §2.4 -----------------------------------------------------------------------

q("tx_with_patient", """
SELECT t.id, t.patient_id, p.insurance_provider FROM transactions t JOIN patients p ON t.patient_id = p.id
""")

q("doctor_appointments_left", """
SELECT d.id, COUNT(a.id) AS appointments,
  CAST(COALESCE(SUM(CASE WHEN a.status = 'Completed' THEN a.revenue_generated ELSE 0 END), 0) AS DOUBLE) AS revenue
FROM doctors d LEFT JOIN appointments a ON d.id = a.doctor_id GROUP BY d.id
""")

q("doctor_appointments_inner", """
SELECT d.id, a.id AS appointment_id, CAST(a.revenue_generated AS DOUBLE) AS revenue
FROM doctors d JOIN appointments a ON d.id = a.doctor_id WHERE a.status = 'Completed'
""")

q("dept_cost_lookup", """
SELECT t.department, CAST(COALESCE(NULLIF(c.cost, 0), 15000) AS BIGINT) AS cost
FROM (SELECT DISTINCT department FROM transactions) t
LEFT JOIN (SELECT name, MAX(25000 + beds_occupied * 450 + avg_wait_time * 150) AS cost
           FROM departments GROUP BY name) c ON t.department = c.name
""")

q("provider_lookup_default", """
SELECT t.id, COALESCE(NULLIF(p.insurance_provider, ''), 'Self-Pay') AS insurance_provider
FROM transactions t LEFT JOIN patients p ON t.patient_id = p.id
""")

q("anti_existing", """
SELECT id FROM patients p WHERE NOT EXISTS (SELECT 1 FROM appointments a WHERE a.patient_id = p.id AND a.status = 'Cancelled')
""")

# -- §2.6 -----------------------------------------------------------------------

q("page_patients", f"""
SELECT id, name, age, gender, blood_group AS "bloodGroup", city, state,
  {iso('registration_date')} AS "registrationDate", insurance_provider AS "insuranceProvider", category
FROM patients WHERE category = 'Inpatient' AND (lower(name) LIKE '%customer#%' OR lower(id) LIKE '%customer#%')
ORDER BY id DESC LIMIT 10 OFFSET 10
""")

q("page_appointments", f"""
SELECT id, patient_id AS "patientId", doctor_id AS "doctorId", department, {iso('appointment_date')} AS "appointmentDate",
  duration, status, CAST(revenue_generated AS DOUBLE) AS "revenueGenerated"
FROM appointments WHERE status = 'Completed' ORDER BY appointment_date DESC, id DESC LIMIT 10 OFFSET 20
""")

q("page_transactions", f"""
SELECT id, patient_id AS "patientId", appointment_id AS "appointmentId", {iso('date')} AS date,
  CAST(amount AS DOUBLE) AS amount, type, CAST(insurance_coverage AS DOUBLE) AS "insuranceCoverage",
  payment_type AS "paymentType", department
FROM transactions WHERE type = 'Lab Fee' ORDER BY date DESC, id DESC LIMIT 10 OFFSET 10
""")

q("page_info", """
SELECT total, 2 AS page, 10 AS "limit", CAST(GREATEST(1, CEIL(total / 10)) AS BIGINT) AS total_pages,
  CAST(11 AS BIGINT) AS first_row, CAST(LEAST(20, total) AS BIGINT) AS last_row
FROM (SELECT COUNT(*) AS total FROM transactions WHERE type = 'Lab Fee')
""")

q("page_totals", """
SELECT CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS page_amount,
  CAST(COALESCE(SUM(insurance_coverage), 0) AS DOUBLE) AS page_coverage
FROM (SELECT * FROM transactions WHERE type = 'Lab Fee' ORDER BY date DESC, id DESC LIMIT 10 OFFSET 10)
""")

q("recent_rows", f"""
SELECT id, {iso('date')} AS date FROM transactions ORDER BY date DESC, id DESC LIMIT 250
""")

q("top_k", "SELECT * FROM (" + _Q["dept_profitability"][len(FIXTURE_CTE):] + ") ORDER BY profit DESC, department LIMIT 5")

q("latest_periods_ascending", """
SELECT * FROM (SELECT strftime(appointment_date, '%Y-%m') AS month, COUNT(*) AS appointments
  FROM appointments GROUP BY 1 ORDER BY month DESC LIMIT 6) ORDER BY month
""")

# -- §2.7 -----------------------------------------------------------------------

q("appointment_revenue", """
SELECT a.id, CAST(CASE WHEN a.status = 'Cancelled' THEN 0 ELSE d.consultation_fee END AS DOUBLE) AS revenue_generated
FROM appointments a LEFT JOIN doctors d ON a.doctor_id = d.id
""")

q("billable_appointments", """
SELECT id, status FROM appointments WHERE status IN ('Completed', 'Rescheduled')
""")

q("consultation_charges", """
, paid AS (SELECT appointment_id, COUNT(*) AS n, SUM(amount) AS amount, SUM(insurance_coverage) AS cover
  FROM transactions WHERE type = 'Consultation' AND appointment_id IS NOT NULL GROUP BY appointment_id)
SELECT id, patient_id, department, CAST(revenue_generated AS DOUBLE) AS billable, COALESCE(n, 0) AS charges,
  CAST(COALESCE(amount, 0) AS DOUBLE) AS charged, CAST(COALESCE(cover, 0) AS DOUBLE) AS covered,
  CAST(revenue_generated - COALESCE(amount, 0) AS DOUBLE) AS difference
FROM appointments LEFT JOIN paid ON paid.appointment_id = appointments.id
WHERE status IN ('Completed', 'Rescheduled')
""")

q("ancillary_coverage", """
SELECT type, payment_type, COUNT(*) AS charges, CAST(SUM(amount) AS DOUBLE) AS amount,
  CAST(SUM(insurance_coverage) AS DOUBLE) AS covered,
  CAST(SUM(insurance_coverage) AS DOUBLE) * 100 / NULLIF(CAST(SUM(amount) AS DOUBLE), 0) AS covered_pct
FROM transactions WHERE type <> 'Consultation' GROUP BY type, payment_type
""")

q("route_department", """
SELECT t.id, t.type, CASE WHEN t.type = 'Emergency Services' THEN 'Emergency' WHEN t.type = 'Lab Fee' THEN 'Radiology'
  ELSE d.department END AS department
FROM transactions t LEFT JOIN doctors d ON d.id = 'DR' || split_part(t.id, '-', 4)
""")

q("appointment_link", """
SELECT id, type, CASE WHEN type = 'Consultation' THEN 'AP' || split_part(substr(id, 3), '-', 1) END AS appointment_id
FROM transactions
""")

# -- §2.8 -----------------------------------------------------------------------

q("check_unique_key", PLANTED + """
SELECT id, COUNT(*) AS occurrences FROM pt GROUP BY id HAVING COUNT(*) > 1
""")

q("check_not_null", PLANTED + "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", COUNT(*) FILTER (WHERE {c} IS NULL) AS nulls FROM pt"
    for c in ["id", "patient_id", "appointment_id", "date", "amount", "type", "insurance_coverage",
              "payment_type", "department"]))

_DOMAINS = {
    ("patients", "pp"): {"gender": "'Male', 'Female', 'Other'", "category": "'Inpatient', 'Outpatient', 'ER'",
                         "blood_group": "'A+', 'A-', 'B+', 'B-', 'AB+', 'AB-', 'O+', 'O-'",
                         "insurance_provider": "'HealthShield', 'AuraCare', 'MedLife', 'ApexPay', 'Self-Pay'"},
    ("appointments", "pa"): {"status": "'Scheduled', 'Completed', 'Cancelled', 'Rescheduled'"},
    ("transactions", "pt"): {"type": "'Consultation', 'Lab Fee', 'Pharmacy', 'Emergency Services'",
                             "payment_type": "'Insurance', 'Cash', 'Credit Card', 'Debit Card'"},
}


def _outside(cte: str, column: str, allowed: str) -> str:
    return (f"SELECT '{column}' AS \"column\", {column} AS value, COUNT(*) AS \"rows\" FROM {cte} "
            f"WHERE {column} NOT IN ({allowed}) GROUP BY {column}")


q("check_domain", PLANTED + "\nUNION ALL ".join(
    _outside("pp", c, v) for c, v in _DOMAINS["patients", "pp"].items()))

# every column but the charge's appointment is required
_COLUMNS = {
    ("departments", "pe"): "id name beds_total beds_occupied kpi_satisfaction avg_wait_time",
    ("doctors", "pd"): "id name department experience consultation_fee utilization",
    ("patients", "pp"): "id name age gender blood_group city state registration_date insurance_provider category",
    ("appointments", "pa"): "id patient_id doctor_id department appointment_date duration status revenue_generated",
    ("transactions", "pt"): "id patient_id date amount type insurance_coverage payment_type department",
}
q("check_constraints", PLANTED + "\nUNION ALL ".join(
    [f"SELECT '{t}' AS \"table\", 'not null' AS rule, '{c}' AS \"column\", CAST(NULL AS VARCHAR) AS value, "
     f"COUNT(*) AS \"rows\" FROM {cte} WHERE {c} IS NULL HAVING COUNT(*) > 0"
     for (t, cte), cols in _COLUMNS.items() for c in cols.split()]
    + [f"SELECT '{t}', 'unique', 'id', id, COUNT(*) FROM {cte} GROUP BY id HAVING COUNT(*) > 1" for t, cte in _COLUMNS]
    + [f"SELECT '{t}', 'domain', * FROM ({_outside(cte, c, v)})" for (t, cte), d in _DOMAINS.items() for c, v in d.items()]))

q("check_domain_rows", """
SELECT id, type FROM transactions WHERE type IS NOT NULL AND type NOT IN ('Consultation', 'Lab Fee', 'Pharmacy')
""")

q("check_foreign_key", PLANTED + f"""
, fp AS (SELECT id FROM pp WHERE {N} % 5 <> 0), fa AS (SELECT * FROM pa WHERE {N} % 7 <> 0)
SELECT 'appointments' AS child, 'patient_id' AS fk, 'patients' AS parent, COUNT(*) AS orphans FROM fa
  WHERE patient_id IS NOT NULL AND patient_id NOT IN (SELECT id FROM fp)
UNION ALL SELECT 'appointments', 'doctor_id', 'doctors', COUNT(*) FROM fa
  WHERE doctor_id IS NOT NULL AND doctor_id NOT IN (SELECT id FROM pd)
UNION ALL SELECT 'transactions', 'patient_id', 'patients', COUNT(*) FROM pt
  WHERE patient_id IS NOT NULL AND patient_id NOT IN (SELECT id FROM fp)
UNION ALL SELECT 'transactions', 'appointment_id', 'appointments', COUNT(*) FROM pt
  WHERE appointment_id IS NOT NULL AND appointment_id NOT IN (SELECT id FROM fa)
""")

q("fill_defaults", f"""
SELECT 'appointments' AS "table", id, CAST(CASE WHEN status = 'Scheduled' THEN 30 ELSE duration END AS DOUBLE) AS first,
  CAST(CASE WHEN {N} % 3 = 0 THEN 0 ELSE revenue_generated END AS DOUBLE) AS second FROM appointments
UNION ALL SELECT 'transactions', id, CASE WHEN {N} % 5 = 0 THEN 0 ELSE amount END,
  CASE WHEN {N} % 7 = 0 THEN 0 ELSE insurance_coverage END FROM transactions
UNION ALL SELECT 'doctors', id, CASE WHEN {N} % 2 = 0 THEN 0 ELSE experience END, utilization FROM doctors
UNION ALL SELECT 'departments', id, CASE WHEN {N} % 2 = 0 THEN 0 ELSE beds_total END, avg_wait_time FROM departments
""")

q("dedupe_latest", UPSERT + f"""
, allrows AS (SELECT * FROM tgt UNION ALL SELECT * FROM src),
best AS (SELECT * FROM allrows QUALIFY row_number() OVER (PARTITION BY id ORDER BY date DESC NULLS LAST,
  patient_id DESC NULLS LAST, appointment_id DESC NULLS LAST, amount DESC NULLS LAST, type DESC NULLS LAST,
  insurance_coverage DESC NULLS LAST, payment_type DESC NULLS LAST, department DESC NULLS LAST) = 1)
SELECT {TX_OUT} FROM best
""")

_PASS = """
, pr AS (
  SELECT 'patients' AS "table", COUNT(*) AS bronze_rows,
    COUNT(*) FILTER (WHERE id IS NOT NULL AND name IS NOT NULL AND age > 0 AND age < 120) AS silver_rows FROM patients
  UNION ALL
  SELECT 'transactions', COUNT(*), COUNT(*) FILTER (WHERE id IS NOT NULL AND amount > 0) FROM transactions),
rate AS (SELECT "table", bronze_rows, silver_rows,
  CASE WHEN bronze_rows > 0 THEN CAST(silver_rows AS DOUBLE) * 100 / bronze_rows ELSE 100.0 END AS pass_rate FROM pr)
"""
q("silver_pass_rate", _PASS + "SELECT * FROM rate")
q("threshold_band", _PASS + """SELECT "table", pass_rate,
  CASE WHEN pass_rate >= 90 THEN 'green' WHEN pass_rate >= 70 THEN 'orange' ELSE 'red' END AS band FROM rate""")

# -- §2.9 -----------------------------------------------------------------------

q("append_with_keys", r"""
SELECT printf('PT%06d', (SELECT MAX(CAST(regexp_extract(id, '(\d+)$', 1) AS BIGINT)) FROM patients)
    + row_number() OVER (ORDER BY name, id)) AS id, name
FROM patients
""")

# -- §2.10 ----------------------------------------------------------------------

q("metrics_snapshot", """
SELECT 'healthcare_simulator_patients_total' AS metric, 'counter' AS kind, CAST(COUNT(*) AS DOUBLE) AS value FROM patients
UNION ALL SELECT 'healthcare_simulator_appointments_total', 'counter', CAST(COUNT(*) AS DOUBLE) FROM appointments
UNION ALL SELECT 'healthcare_simulator_transactions_total', 'counter', CAST(COUNT(*) AS DOUBLE) FROM transactions
UNION ALL SELECT 'healthcare_simulator_silver_integrity_percentage', 'gauge',
  CAST(s AS DOUBLE) * 100 / b FROM (
    SELECT (SELECT COUNT(*) FROM patients) + (SELECT COUNT(*) FROM transactions) AS b,
      (SELECT COUNT(*) FROM patients WHERE id IS NOT NULL AND name IS NOT NULL AND age > 0 AND age < 120)
      + (SELECT COUNT(*) FROM transactions WHERE id IS NOT NULL AND amount > 0) AS s)
""")

q("metric_last_value", f"""
SELECT metric, {iso('ts')} AS ts, value FROM metric_samples WHERE value IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY metric ORDER BY ts DESC, value DESC) = 1
""")

q("metric_series", f"""
SELECT {iso('ts')} AS ts, value FROM metric_samples
WHERE metric = 'error' AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-12 00:00:00'
""")

q("threshold_alerts", f"""
, rules AS (SELECT rule, metric, CAST(less_than AS DOUBLE) AS less_than, CAST(lookback_seconds AS INT) AS lookback_seconds,
    no_data_alerts, severity, service FROM (VALUES
  ('click low', 'click', 5.0, 3600, true, 'warning', 'web'),
  ('purchase low', 'purchase', 20.0, 1800, true, 'critical', 'shop'),
  ('heartbeat missing', 'heartbeat', 1.0, 60, true, 'critical', 'app'),
  ('signup quiet', 'signup', 1.0, 600, false, 'info', 'growth'),
  ('click low for one user', 'click', 5.0, 86400, true, 'info', 'web'))
  AS v(rule, metric, less_than, lookback_seconds, no_data_alerts, severity, service)),
s AS (SELECT r.rule, m.ts, m.value FROM metric_samples m JOIN rules r ON m.metric = r.metric
  WHERE m.value IS NOT NULL AND (r.rule <> 'click low for one user' OR m.user_id = 7)
    AND m.ts <= TIMESTAMP '2024-01-15 12:00:00' AND m.ts >= TIMESTAMP '2024-01-15 12:00:00' - r.lookback_seconds * INTERVAL 1 SECOND),
latest AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY rule ORDER BY ts DESC, value DESC) = 1)
SELECT r.rule, r.metric, {iso('l.ts')} AS ts, l.value, r.less_than, r.severity, r.service,
  CASE WHEN l.value IS NULL THEN (CASE WHEN r.no_data_alerts THEN 'Alerting' ELSE 'NoData' END)
       WHEN l.value < r.less_than THEN 'Alerting' ELSE 'Normal' END AS state
FROM rules r LEFT JOIN latest l ON r.rule = l.rule
""")

q("status_text", """
SELECT metric, up, CASE WHEN up >= 1 THEN 'UP' ELSE 'DOWN' END AS status FROM (
  SELECT metric, CASE WHEN COUNT(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-15 12:00:00'
    AND ts > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 1 HOUR) > 0 THEN 1 ELSE 0 END AS up
  FROM metric_samples GROUP BY metric)
""")


# -- streaming forms -------------------------------------------------------------

q("stream_bronze_append", f"SELECT {TX_OUT} FROM transactions")

q("stream_silver_upsert", UPSERT + f"""
, st AS (SELECT * FROM tgt WHERE id IS NOT NULL AND amount > 0),
ss AS (SELECT * FROM src WHERE id IS NOT NULL AND amount > 0),
res AS (
  SELECT t.id, t.patient_id, t.appointment_id,
    CASE WHEN t.date < s.date THEN s.date ELSE t.date END AS date,
    CASE WHEN t.date < s.date THEN s.amount ELSE t.amount END AS amount,
    t.type,
    CASE WHEN t.date < s.date THEN s.insurance_coverage ELSE t.insurance_coverage END AS insurance_coverage,
    CASE WHEN t.date < s.date THEN s.payment_type ELSE t.payment_type END AS payment_type,
    t.department
  FROM st t LEFT JOIN ss s ON t.id = s.id
  UNION ALL
  SELECT * FROM ss s WHERE NOT EXISTS (SELECT 1 FROM st t WHERE t.id = s.id))
SELECT {TX_OUT} FROM res
""")

q("stream_pipeline_counts", """
SELECT 'patients' AS "table", COUNT(*) AS "rows" FROM patients
UNION ALL SELECT 'appointments', COUNT(*) FROM appointments
UNION ALL SELECT 'transactions', COUNT(*) FROM transactions
UNION ALL SELECT 'doctors', COUNT(*) FROM doctors
UNION ALL SELECT 'departments', COUNT(*) FROM departments
""")


q("export_csv_text", f"""
SELECT id, patient_id AS "patientId", appointment_id AS "appointmentId", {iso('date')} AS date,
  regexp_replace(regexp_replace(CAST(amount AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS amount, type,
  regexp_replace(regexp_replace(CAST(insurance_coverage AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')
    AS "insuranceCoverage",
  payment_type AS "paymentType", department
FROM transactions
""")

_Q["jdbc_snapshot"] = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"


q("stream_gold_dept_totals", _Q["gold_dept_profitability"][len(FIXTURE_CTE):])


q("stream_growth_history", """
SELECT '2024-05' AS "timestamp",
  (SELECT COUNT(*) FROM patients WHERE category = 'Inpatient') AS "patientsCount",
  (SELECT COUNT(*) FROM appointments WHERE status = 'Completed') AS "appointmentsCount",
  (SELECT COUNT(*) FROM transactions WHERE type IN ('Consultation', 'Lab Fee')) AS "transactionsCount"
UNION ALL
SELECT '2024-06', (SELECT COUNT(*) FROM patients), (SELECT COUNT(*) FROM appointments),
  (SELECT COUNT(*) FROM transactions)
""")


q("month_bucket", "SELECT id, strftime(date, '%Y-%m') AS month FROM transactions")
q("day_bucket", "SELECT id, strftime(appointment_date, '%Y-%m-%d') AS day FROM appointments")
q("to_api_names", """
SELECT id, name, department, experience, consultation_fee AS "consultationFee", utilization FROM doctors
""")
q("to_api_types", """
SELECT id, name, beds_total, beds_occupied, CAST(kpi_satisfaction AS DOUBLE) AS kpi_satisfaction, avg_wait_time
FROM departments
""")
q("with_lineage", """
SELECT id, true AS lineage_set FROM patients WHERE id IS NOT NULL AND name IS NOT NULL AND age > 0 AND age < 120
""")
q("conditional_value", """
SELECT id, CAST(CASE WHEN status = 'Completed' THEN revenue_generated ELSE 0 END AS DOUBLE) AS completed_revenue
FROM appointments
""")
q("null_to_zero", """
SELECT d.id, CAST(COALESCE(s.s, 0) AS DOUBLE) AS revenue FROM doctors d LEFT JOIN (
  SELECT doctor_id, SUM(revenue_generated) AS s FROM appointments WHERE status = 'Completed' GROUP BY doctor_id) s
ON d.id = s.doctor_id
""")
q("pack_growth_history", _GROWTH.replace("{T}", "BIGINT").replace(
    'SELECT * FROM (SELECT * FROM c ORDER BY "timestamp" DESC LIMIT 12) ORDER BY "timestamp"',
    'SELECT CAST(to_json(list(struct_pack("timestamp" := "timestamp", "patientsCount" := "patientsCount", '
    '"appointmentsCount" := "appointmentsCount", "transactionsCount" := "transactionsCount") '
    'ORDER BY "timestamp")) AS VARCHAR) AS record_growth_history '
    'FROM (SELECT * FROM c ORDER BY "timestamp" DESC LIMIT 12)'))
q("load_bronze_csv", f"SELECT {TX_OUT} FROM transactions")
q("bronze_full_refresh", """
SELECT 'bronze_departments' AS "table", true AS success, COUNT(*) AS "rows" FROM departments
UNION ALL SELECT 'bronze_doctors', true, COUNT(*) FROM doctors
UNION ALL SELECT 'bronze_patients', true, COUNT(*) FROM patients
UNION ALL SELECT 'bronze_appointments', true, COUNT(*) FROM appointments
UNION ALL SELECT 'bronze_transactions', true, COUNT(*) FROM transactions
""")
q("sync_status", """
SELECT CAST(5 AS BIGINT) AS tables, CAST(5 AS BIGINT) AS succeeded,
  (SELECT COUNT(*) FROM departments) + (SELECT COUNT(*) FROM doctors) + (SELECT COUNT(*) FROM patients)
  + (SELECT COUNT(*) FROM appointments) + (SELECT COUNT(*) FROM transactions) AS rows_synced,
  'SUCCESS' AS overall_status, true AS last_sync_time
""")

q("sync_report", """
, r AS (SELECT 'bronze_doctors' AS "table", COUNT(*) AS "rows" FROM doctors
  UNION ALL SELECT 'bronze_patients', COUNT(*) FROM patients
  UNION ALL SELECT 'bronze_appointments', COUNT(*) FROM appointments
  UNION ALL SELECT 'bronze_transactions', COUNT(*) FROM transactions
  UNION ALL SELECT 'bronze_departments', 0)
SELECT "table", "table" <> 'bronze_departments' AS success, "rows", true AS timed,
  CASE WHEN "table" = 'bronze_departments' THEN true END AS failed, CAST(SUM("rows") OVER () AS BIGINT) AS total_rows
FROM r
""")


def _row_sql(table: str, columns: str) -> str:
    text = ", ".join(f"coalesce({iso(c) if c in ('date', 'registration_date', 'appointment_date') else f'CAST({c} AS VARCHAR)'}"
                     ", 'null')" for c in columns.split())
    return f"""SELECT '{table}' AS "table", id, concat_ws('|', {text}) AS "row" FROM {table}"""


_ALL_ROWS = "\nUNION ALL ".join(
    _row_sql(t, cols.replace("patient_id date", "patient_id appointment_id date") if t == "transactions" else cols)
    for (t, _), cols in _COLUMNS.items())
q("export_csv", _ALL_ROWS)
q("export_json", _ALL_ROWS)

q("page_after", f"""
, l AS (SELECT id, date, row_number() OVER (ORDER BY date DESC, id DESC) AS n FROM transactions WHERE type = 'Lab Fee')
SELECT id, {iso('date')} AS date FROM l WHERE n BETWEEN 8 AND 17
""")

q("patient_register_info", """
SELECT 'total' AS part, CAST(COUNT(*) AS VARCHAR) AS value FROM patients WHERE category = 'Inpatient'
UNION ALL SELECT DISTINCT 'state', state FROM patients
UNION ALL SELECT 'category', unnest(['Inpatient', 'Outpatient', 'ER'])
""")


# -- operators that keep state (plans/mechanisms.py) --------------------------------

# Times of the rules in whole seconds: a sample is seen at the next multiple of 10 s
# after it and has left the look-back at the first multiple above ts + lookback.
q("stream_threshold_alerts", f"""
, rules AS (SELECT * FROM (VALUES
  ('click low', 'click', 5.0, 3600, true, 'warning', 'web'),
  ('purchase low', 'purchase', 20.0, 1800, true, 'critical', 'shop'),
  ('heartbeat missing', 'heartbeat', 1.0, 60, true, 'critical', 'app'),
  ('signup quiet', 'signup', 1.0, 600, false, 'info', 'growth'),
  ('click low for one user', 'click', 5.0, 86400, true, 'info', 'web'))
  AS v(rule, metric, less_than, lookback, no_data, severity, service)),
s AS (SELECT r.rule, lookback, epoch_us(m.ts) AS us, m.value, (epoch_us(m.ts) // 10000000 + 1) * 10 AS tick
  FROM metric_samples m JOIN rules r ON m.metric = r.metric
  WHERE m.value IS NOT NULL AND (r.rule <> 'click low for one user' OR m.user_id = 7)),
l AS (SELECT rule, tick, value, ((us + CAST(lookback AS BIGINT) * 1000000) // 10000000 + 1) * 10 AS gone FROM s
  QUALIFY row_number() OVER (PARTITION BY rule, tick ORDER BY us DESC, value DESC) = 1),
t0 AS (SELECT CAST(epoch(TIMESTAMP '2024-01-10 00:00:00') AS BIGINT) AS t),
e AS (SELECT rule, tick AS t FROM l UNION SELECT rule, gone FROM l UNION SELECT rule, t FROM rules, t0),
st AS (SELECT e.rule, e.t, CASE WHEN l.gone > e.t THEN l.value END AS value
  FROM e ASOF LEFT JOIN l ON e.rule = l.rule AND e.t >= l.tick WHERE e.t >= (SELECT t FROM t0)),
x AS (SELECT r.service, st.rule, r.severity, st.t, st.value, CASE WHEN st.value IS NULL THEN 'no data' ELSE 'value' END AS reason,
  CASE WHEN st.value IS NULL THEN (CASE WHEN r.no_data THEN 'Alerting' ELSE 'NoData' END)
       WHEN st.value < r.less_than THEN 'Alerting' ELSE 'Normal' END AS state FROM st JOIN rules r ON st.rule = r.rule),
c AS (SELECT * FROM x QUALIFY state IS DISTINCT FROM lag(state) OVER (PARTITION BY rule ORDER BY t))
SELECT service, rule, severity, {iso("make_timestamp(t * 1000000)")} AS "at", state, reason, value FROM c
""")

q("stream_check_foreign_key", PLANTED + f"""
SELECT id, patient_id FROM pt WHERE patient_id IS NOT NULL AND patient_id NOT IN (SELECT id FROM pp WHERE {N} % 5 <> 0)
""")

q("stream_check_unique_key", f"""
SELECT id, COUNT(*) AS occurrences FROM (SELECT id FROM transactions UNION ALL SELECT id FROM transactions WHERE {N} % 41 = 0)
GROUP BY id HAVING COUNT(*) > 1
""")

q("stream_dedupe", f"SELECT {TX_OUT} FROM transactions")

q("stream_gold_insurance_utilization", _Q["gold_insurance_utilization"][len(FIXTURE_CTE):])

q("load_bronze_csv_rejects", f"""
SELECT reason, COUNT(*) AS records FROM (
  SELECT CASE WHEN {N} % 13 = 0 THEN 'wrong number of fields'
    WHEN {N} % 11 = 0 AND {N} % 7 = 0 THEN 'date is no timestamp; amount is no decimal(10,2)'
    WHEN {N} % 11 = 0 THEN 'date is no timestamp' WHEN {N} % 7 = 0 THEN 'amount is no decimal(10,2)' END AS reason FROM transactions)
GROUP BY reason
""")

q("merge_upsert_by_month", _Q["merge_upsert"][len(FIXTURE_CTE):])

q("jdbc_snapshot_split", " SELECT c_custkey, c_name, c_mktsegment FROM customer")

q("append_with_keys_blocks", rf"""
, b AS (SELECT id, name, CAST({N} % 2 AS INT) AS batch FROM patients)
SELECT printf('PT%06d', (SELECT MAX(CAST(regexp_extract(id, '(\d+)$', 1) AS BIGINT)) FROM patients)
    + row_number() OVER (ORDER BY batch, name, id)) AS id, name FROM b
""")

q("page_by_number", f"""
, l AS (SELECT id, date, row_number() OVER (ORDER BY date DESC, id DESC) AS n FROM transactions WHERE type = 'Lab Fee'),
z AS (SELECT GREATEST(1, (COUNT(*) + 9) // 10) AS last FROM l)
SELECT CAST((n - 1) // 10 + 1 AS BIGINT) AS page, id, {iso('date')} AS date FROM l, z
WHERE (n - 1) // 10 + 1 IN (1, last // 2 + 1, last)
""")

q("metric_grid", f"""
, g AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-08 00:00:00', TIMESTAMP '2024-01-15 00:00:00', INTERVAL 1 HOUR)) AS g),
w AS (SELECT metric, ts, MAX(value) AS value FROM metric_samples WHERE value IS NOT NULL
  AND ts BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00' GROUP BY metric, ts),
m AS (SELECT metric, g FROM (SELECT DISTINCT metric FROM w), g),
a AS (SELECT m.metric, m.g, w.ts, w.value FROM m ASOF LEFT JOIN w ON m.metric = w.metric AND m.g >= w.ts)
SELECT metric, {iso('g')} AS ts, CASE WHEN epoch_us(g) - epoch_us(ts) <= 1800000000 THEN value END AS value,
  CASE WHEN epoch_us(g) - epoch_us(ts) <= 1800000000 THEN round((epoch_us(g) - epoch_us(ts)) / 1000000, 3) END AS age FROM a
""")

q("adhoc_status", """
, c AS (SELECT 'count' AS name, COUNT(*) AS n FROM transactions WHERE amount > 1000
  UNION ALL SELECT 'with', COUNT(*) FROM (SELECT patient_id FROM transactions GROUP BY patient_id HAVING SUM(amount) > 5000))
SELECT name, 'SUCCEEDED' AS status, n AS row_count, LEAST(n, 50) AS returned, true AS timed FROM c
UNION ALL SELECT name, 'REFUSED', NULL, NULL, NULL FROM (VALUES ('write'), ('drop'), ('java'), ('file')) AS v(name)
UNION ALL SELECT 'error', 'FAILED', 0, 0, true
""")


def oracle_sql() -> dict[str, str]:
    return dict(_Q)
