"""Table definitions, column names and value domains of the five hospital tables.

Storage uses snake_case; the API / CSV / JSON shape uses camelCase.
"""

from __future__ import annotations

from pyspark.sql import types as T

TABLES = ("patients", "appointments", "doctors", "departments", "transactions")

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for equal results)
# ---------------------------------------------------------------------------
# Value domains of the enumerated columns.
GENDERS = ["Male", "Female", "Other"]
CATEGORIES = ["Inpatient", "Outpatient", "ER"]
STATUSES = ["Scheduled", "Completed", "Cancelled", "Rescheduled"]
TX_TYPES = ["Consultation", "Lab Fee", "Pharmacy", "Emergency Services"]
BLOOD_GROUPS = ["A+", "A-", "B+", "B-", "AB+", "AB-", "O+", "O-"]
INSURERS = ["HealthShield", "AuraCare", "MedLife", "ApexPay", "Self-Pay"]
PAYMENT_TYPES = ["Insurance", "Cash", "Credit Card", "Debit Card"]
SELF_PAY = "Self-Pay"
# Department cost model: 25000 + 450 per occupied bed + 150 per wait minute;
# 15000 when the department is unknown or its cost is 0.
COST_BASE = 25000
COST_PER_BED = 450
COST_PER_WAIT_MINUTE = 150
COST_DEFAULT = 15000
# Utilization above this is "high".
UTILIZATION_HIGH = 85
# Entity key prefixes and minimum digit widths.
KEY_WIDTH = {"PT": 6, "AP": 6, "TX": 6, "DR": 3}
# Register page size, ad hoc SQL row cap, sandbox sample size.
DEFAULT_PAGE_SIZE = 10
ADHOC_MAX_ROWS = 1000
SANDBOX_SAMPLE_ROWS = 250
# Column defaults from the table definitions.
DEFAULT_DURATION = 30
# ---------------------------------------------------------------------------

DOMAINS = {
    "patients": {"gender": GENDERS, "category": CATEGORIES, "blood_group": BLOOD_GROUPS,
                 "insurance_provider": INSURERS},
    "appointments": {"status": STATUSES},
    "transactions": {"type": TX_TYPES, "payment_type": PAYMENT_TYPES},
}

MONEY = T.DecimalType(10, 2)

SCHEMAS: dict[str, T.StructType] = {
    "departments": T.StructType([
        T.StructField("id", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("beds_total", T.IntegerType(), True),
        T.StructField("beds_occupied", T.IntegerType(), True),
        T.StructField("kpi_satisfaction", T.DecimalType(2, 1), True),
        T.StructField("avg_wait_time", T.IntegerType(), True),
    ]),
    "doctors": T.StructType([
        T.StructField("id", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("department", T.StringType(), False),
        T.StructField("experience", T.IntegerType(), True),
        T.StructField("consultation_fee", T.IntegerType(), True),
        T.StructField("utilization", T.IntegerType(), True),
    ]),
    "patients": T.StructType([
        T.StructField("id", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("age", T.IntegerType(), False),
        T.StructField("gender", T.StringType(), False),
        T.StructField("blood_group", T.StringType(), False),
        T.StructField("city", T.StringType(), False),
        T.StructField("state", T.StringType(), False),
        T.StructField("registration_date", T.TimestampType(), True),
        T.StructField("insurance_provider", T.StringType(), False),
        T.StructField("category", T.StringType(), False),
    ]),
    "appointments": T.StructType([
        T.StructField("id", T.StringType(), False),
        T.StructField("patient_id", T.StringType(), False),
        T.StructField("doctor_id", T.StringType(), False),
        T.StructField("department", T.StringType(), False),
        T.StructField("appointment_date", T.TimestampType(), False),
        T.StructField("duration", T.IntegerType(), True),
        T.StructField("status", T.StringType(), False),
        T.StructField("revenue_generated", MONEY, True),
    ]),
    "transactions": T.StructType([
        T.StructField("id", T.StringType(), False),
        T.StructField("patient_id", T.StringType(), False),
        T.StructField("appointment_id", T.StringType(), True),
        T.StructField("date", T.TimestampType(), True),
        T.StructField("amount", MONEY, False),
        T.StructField("type", T.StringType(), False),
        T.StructField("insurance_coverage", MONEY, True),
        T.StructField("payment_type", T.StringType(), False),
        T.StructField("department", T.StringType(), False),
    ]),
}

# Required (NOT NULL) columns per table: all but the optional appointment link.
OPTIONAL = {"transactions": ["appointment_id"]}
REQUIRED = {name: [f.name for f in s.fields if f.name not in OPTIONAL.get(name, [])] for name, s in SCHEMAS.items()}

# snake_case storage name -> camelCase API name (only the ones that differ).
API_NAMES = {
    "patients": {"blood_group": "bloodGroup", "registration_date": "registrationDate",
                 "insurance_provider": "insuranceProvider"},
    "appointments": {"patient_id": "patientId", "doctor_id": "doctorId",
                     "appointment_date": "appointmentDate", "revenue_generated": "revenueGenerated"},
    "doctors": {"consultation_fee": "consultationFee"},
    "departments": {"beds_total": "bedsTotal", "beds_occupied": "bedsOccupied",
                    "kpi_satisfaction": "kpiSatisfaction", "avg_wait_time": "avgWaitTime"},
    "transactions": {"patient_id": "patientId", "appointment_id": "appointmentId",
                     "insurance_coverage": "insuranceCoverage", "payment_type": "paymentType"},
}

# Timestamp columns per table (rendered as ISO-8601 text in the API shape).
TIMESTAMP_COLUMNS = {
    "patients": ["registration_date"],
    "appointments": ["appointment_date"],
    "transactions": ["date"],
    "doctors": [],
    "departments": [],
}


def storage_columns(table: str) -> list[str]:
    return [f.name for f in SCHEMAS[table].fields]


def api_columns(table: str) -> list[str]:
    names = API_NAMES[table]
    return [names.get(c, c) for c in storage_columns(table)]


def bronze_schema(table: str) -> T.StructType:
    """Typed Bronze definition of a hospital table (all columns nullable: Bronze
    keeps whatever arrived; Silver and the quality checks decide)."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in SCHEMAS[table].fields])


def api_schema(table: str) -> T.StructType:
    """Schema of the camelCase CSV/JSON shape (timestamps as ISO text read back as
    timestamps, money as decimal)."""
    names = API_NAMES[table]
    return T.StructType([T.StructField(names.get(f.name, f.name), f.dataType, True)
                         for f in SCHEMAS[table].fields])
