from datetime import datetime
from decimal import Decimal

from wardlake import schemas as S


def ts(s: str) -> datetime:
    return datetime.fromisoformat(s)


def D(x) -> Decimal | None:
    return None if x is None else Decimal(str(x)).quantize(Decimal("0.01"))


def frame(spark, table, rows):
    return spark.createDataFrame(rows, S.bronze_schema(table))


def tx_row(id, patient="PT1", ap=None, date="2024-01-05 10:00:00", amount=100, type="Pharmacy",
           cov=0, pay="Insurance", dept="Cardiology"):
    return (id, patient, ap, ts(date), D(amount), type, D(cov), pay, dept)


def pt_row(id, name="Ann", age=40, insurer="MedLife", category="Inpatient", state="OH", city="X",
           reg="2024-01-01 00:00:00"):
    return (id, name, age, "Female", "A+", city, state, ts(reg) if reg else None, insurer, category)


def ap_row(id, patient="PT1", doctor="DR1", dept="Cardiology", date="2024-01-05 09:00:00", duration=30,
           status="Completed", revenue=150):
    return (id, patient, doctor, dept, ts(date), duration, status, D(revenue))


def doc_row(id, name="Dr A", dept="Cardiology", exp=10, fee=150, util=80):
    return (id, name, dept, exp, fee, util)


def dep_row(id, name, beds_total=10, beds_occ=5, sat=4.5, wait=20):
    return (id, name, beds_total, beds_occ, Decimal(str(sat)), wait)
