"""Upserts, sources/sinks, presets, metrics."""

import os

import pytest
from pyspark.sql import functions as F

from tests.helpers import D, frame, pt_row, ts, tx_row
from wardlake import schemas as S
from wardlake.operators import metrics, upsert
from wardlake.plans import presets
from wardlake.sources import tables


def _target_source(spark):
    target = frame(spark, "transactions", [
        tx_row("T1", date="2024-01-05 00:00:00", amount=10, type="Lab Fee", dept="A"),
        tx_row("T2", date="2024-01-05 00:00:00", amount=20, dept="A"),
        tx_row("T3", date="2024-01-05 00:00:00", amount=30, dept="A")])
    source = frame(spark, "transactions", [
        tx_row("T1", date="2024-01-04 00:00:00", amount=11, pay="Cash", dept="B"),    # older
        tx_row("T2", date="2024-01-05 00:00:00", amount=21, pay="Cash", dept="B"),    # equal
        tx_row("T3", date="2024-01-06 00:00:00", amount=31, pay="Cash", type="X", dept="B"),  # newer
        tx_row("T3", date="2024-01-02 00:00:00", amount=99, pay="Cash", dept="B"),    # older dup in source
        tx_row("T4", date="2020-01-01 00:00:00", amount=40, pay="Cash", dept="B")])   # unseen, late
    return target, source


def test_merge_only_newer_updates(spark):
    target, source = _target_source(spark)
    rows = {r.id: r for r in upsert.merge_upsert(target, source).collect()}
    assert rows["T1"].amount == D(10) and rows["T1"].payment_type == "Insurance"
    assert rows["T2"].amount == D(20)
    t3 = rows["T3"]
    assert (t3.amount, t3.payment_type, t3.date) == (D(31), "Cash", ts("2024-01-06 00:00:00"))
    assert (t3.type, t3.department) == ("Pharmacy", "A")  # columns outside the update list stay
    assert rows["T4"].department == "B" and rows["T4"].amount == D(40)
    assert len(rows) == 4


def test_merge_idempotent(spark):
    target, source = _target_source(spark)
    once = upsert.merge_upsert(target, source)
    twice = upsert.merge_upsert(once, source)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    st = upsert.merge_stats(target, source).first()
    assert (st.source_rows, st.matched, st.updated, st.inserted) == (4, 3, 1, 1)


def test_insert_ignore(spark):
    target, source = _target_source(spark)
    out = {r.id: r for r in upsert.insert_ignore(target, source, order_col="date").collect()}
    assert len(out) == 4 and out["T1"].amount == D(10) and out["T4"].amount == D(40)
    dup = frame(spark, "transactions", [tx_row("T9", date="2024-01-02 00:00:00", amount=1),
                                        tx_row("T9", date="2024-01-01 00:00:00", amount=2)])
    got = upsert.insert_ignore(target, dup, order_col="date").where("id = 'T9'").collect()
    assert len(got) == 1 and got[0].amount == D(2)


def test_append_with_keys_consecutive(spark):
    pts = frame(spark, "patients", [pt_row("PT000007"), pt_row("PT000003")]).repartition(3)
    batch = frame(spark, "patients", [pt_row(f"new{i}", name=f"N{i:03d}") for i in range(50)]).repartition(4)
    out = upsert.append_with_keys(spark, pts, batch, "PT").collect()
    nums = sorted(int(r.id[2:]) for r in out)
    assert nums == list(range(8, 58))
    ordered = upsert.append_with_keys(spark, pts, batch, "PT", order_by="name").collect()
    assert {r.name: r.id for r in ordered}["N000"] == "PT000008"
    assert {r.name: r.id for r in ordered}["N049"] == "PT000057"


def test_csv_roundtrip_quotes_and_nulls(spark, tmp_dir):
    rows = [tx_row("T1", ap=None, dept='Card, "Main"'), tx_row("T2", ap="AP1", dept="Line\nBreak", amount=123.4),
            tx_row("T3", ap="AP2", dept="  padded  ", amount=0.05), tx_row("T4", ap="AP2", dept="NULL"),
            tx_row("T5", ap="AP2", dept=""), tx_row("T6", ap="AP2", dept=None)]
    df = frame(spark, "transactions", rows)
    path = os.path.join(tmp_dir, "csv")
    tables.export_csv(df, "transactions", path)
    text = "".join(open(os.path.join(path, f)).read() for f in sorted(os.listdir(path)) if f.endswith(".csv"))
    header = text.splitlines()[0]
    assert header == "id,patientId,appointmentId,date,amount,type,insuranceCoverage,paymentType,department"
    assert "T1,PT1,NULL,2024-01-05T10:00:00.000Z,100,Pharmacy,0,Insurance,\"Card, \"\"Main\"\"\"" in text
    assert ",123.4,Pharmacy," in text and ",0.05,Pharmacy," in text and ",  padded  " in text
    back = tables.read_export_csv(spark, path, "transactions", multi_line=True).orderBy("id").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in df.orderBy("id").collect()]
    plain = df.where("id <> 'T2'")  # without line breaks the files can be split
    tables.export_csv(plain, "transactions", path)
    assert sorted(map(str, tables.read_export_csv(spark, path, "transactions").collect())) == sorted(map(str, plain.collect()))
    bronze = os.path.join(tmp_dir, "bronze")
    tables.load_bronze_csv(spark, path, "transactions", bronze)
    assert tables.load_bronze_csv(spark, path, "transactions", bronze).count() == 10  # append


def test_csv_keeps_silver_rows(spark, tmp_dir):
    """A patient called NULL and one with an empty name are valid before and after."""
    from wardlake.operators.quality import silver_patients
    pts = frame(spark, "patients", [pt_row("PT1", name="NULL"), pt_row("PT2", name="")])
    path = os.path.join(tmp_dir, "csv")
    tables.export_csv(pts, "patients", path)
    back = tables.read_export_csv(spark, path, "patients")
    assert {r.name for r in silver_patients(back).collect()} == {"NULL", ""}
    out = os.path.join(tmp_dir, "json")
    tables.export_json(pts, "patients", out)
    assert sorted(map(tuple, tables.read_export_json(spark, out, "patients").collect())) == sorted(map(tuple, pts.collect()))


def test_jdbc_bounds_are_required(spark):
    with pytest.raises(ValueError):
        tables.jdbc_snapshot(spark, "jdbc:none", "t", ["a"], partition_column="a")


def test_failed_refresh_keeps_the_last_good_rows(spark, tmp_dir):
    good = frame(spark, "patients", [pt_row(f"PT{i}") for i in range(10)])
    bad = good.withColumn("name", F.when(F.col("id") == "PT7", F.raise_error(F.lit("x" * 900))).otherwise(F.col("name")))
    assert tables.bronze_full_refresh(spark, {"patients": good}, tmp_dir).first().success
    r = tables.bronze_full_refresh(spark, {"patients": bad}, tmp_dir).first()
    assert not r.success and "x" * 900 in r.error and r.finished_at is not None
    assert tables.read_bronze(spark, tmp_dir)["patients"].count() == 10
    for n in (3, 4, 5):  # a good one replaces, and old ones are removed
        assert tables.bronze_full_refresh(spark, {"patients": good.limit(n)}, tmp_dir).first().success
        assert tables.read_bronze(spark, tmp_dir)["patients"].count() == n
    checked = [d for d in os.listdir(f"{tmp_dir}/patients/refresh")
               if os.path.exists(f"{tmp_dir}/patients/refresh/{d}/{tables.CHECKED}")]
    assert len(checked) == 2


def test_unreadable_bronze_is_an_error(spark, tmp_dir):
    assert tables.read_bronze(spark, os.path.join(tmp_dir, "none")) == {}
    os.makedirs(f"{tmp_dir}/patients/load")
    with open(f"{tmp_dir}/patients/load/part-0.parquet", "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception):
        tables.read_bronze(spark, tmp_dir)["patients"].count()


def test_json_export_keeps_nulls(spark, tmp_dir):
    df = frame(spark, "transactions", [tx_row("T1", ap=None)])
    path = os.path.join(tmp_dir, "json")
    tables.export_json(df, "transactions", path)
    text = "".join(open(os.path.join(path, f)).read() for f in os.listdir(path) if f.endswith(".json"))
    assert '"appointmentId":null' in text and '"date":"2024-01-05T10:00:00.000Z"' in text


def test_full_refresh_and_status(spark, tmp_dir):
    srcs = {"patients": frame(spark, "patients", [pt_row("PT1"), pt_row("PT2")]),
            "transactions": frame(spark, "transactions", [tx_row("T1")]),
            "doctors": spark.createDataFrame([(1,)], "x int")}  # broken: no such columns
    rep = tables.bronze_full_refresh(spark, srcs, os.path.join(tmp_dir, "bronze"))
    by = {r.table: r for r in rep.collect()}
    assert by["bronze_patients"].success and by["bronze_patients"].rows == 2
    assert not by["bronze_doctors"].success and by["bronze_doctors"].error
    st = metrics.sync_status(rep).first()
    assert (st.overall_status, st.succeeded, st.rows_synced) == ("PARTIAL", 2, 3)
    assert metrics.sync_status(rep.where("success")).first().overall_status == "SUCCESS"
    assert metrics.sync_status(rep.where("not success")).first().overall_status == "FAILED"
    assert metrics.sync_status(rep.limit(0)).first().overall_status == "NEVER"
    assert metrics.sync_report(rep).first().total_rows == 3
    assert tables.read_bronze(spark, os.path.join(tmp_dir, "bronze"))["patients"].count() == 2


def test_adhoc_sql_guard_cap_and_count(spark):
    from tests.conftest import SF_SMALL
    from wardlake.sources.fixtures import load_hospital
    h = load_hospital(spark, SF_SMALL)
    presets.register_views(spark, h.as_dict())
    with pytest.raises(presets.NotASelect):
        presets.adhoc_sql(spark, "DROP VIEW patients")
    res = presets.adhoc_sql(spark, "  SELECT id FROM bronze_transactions;")
    assert res.rows.count() == 1000 and res.row_count() == h.transactions.count()
    for name in presets.PRESETS:
        assert presets.run_preset(spark, name).count() > 0


def test_alerts_no_data_and_threshold(spark):
    samples = spark.createDataFrame([
        ("db_up", ts("2024-01-01 00:00:50"), 1.0), ("db_up", ts("2024-01-01 00:00:55"), 0.0),
        ("wh_up", ts("2024-01-01 00:00:30"), 1.0), ("old", ts("2023-12-31 00:00:00"), 1.0)],
        "metric string, ts timestamp, value double")
    rules = metrics.rules_frame(spark, [("r1", "db_up", 1.0, 60, True, "critical", "db"),
                                        ("r2", "wh_up", 1.0, 60, True, "warning", "wh"),
                                        ("r3", "old", 1.0, 60, True, "critical", "app"),
                                        ("r4", "old", 1.0, 60, False, "info", "app")])
    out = {r.rule: r.state for r in metrics.threshold_alerts(samples, rules, "2024-01-01 00:01:00").collect()}
    assert out == {"r1": "Alerting", "r2": "Normal", "r3": "Alerting", "r4": "NoData"}
    last = {r.metric: r.value for r in metrics.metric_last_value(samples).collect()}
    assert last["db_up"] == 0.0
    bands = spark.createDataFrame([(69.9,), (70.0,), (89.99,), (90.0,)], "q double").select(
        metrics.threshold_band("q")).collect()
    assert [b[0] for b in bands] == ["red", "orange", "orange", "green"]
    st = spark.createDataFrame([(1,), (0,)], "u int").select(metrics.status_text("u"), metrics.overall_health("u"))
    assert [tuple(r) for r in st.collect()] == [("UP", "healthy"), ("DOWN", "degraded")]
    assert metrics.rules_frame(spark).count() == 3


def test_alert_label_filter(spark):
    """The job's own sample decides; other healthy jobs do not hide it."""
    samples = spark.createDataFrame([
        ("up", ts("2024-01-01 00:00:50"), 1.0, {"job": "other"}), ("up", ts("2024-01-01 00:00:40"), 0.0, {"job": "application"}),
        ("up", ts("2024-01-01 00:00:55"), 1.0, None)], "metric string, ts timestamp, value double, labels map<string,string>")
    out = {r.rule: (r.state, r.value) for r in metrics.threshold_alerts(
        samples, metrics.rules_frame(spark), "2024-01-01 00:01:00").collect()}
    assert out["application down"] == ("Alerting", 0.0)
    plain = samples.drop("labels")  # samples without labels cannot match a labelled rule
    assert {r.rule: r.state for r in metrics.threshold_alerts(
        plain, metrics.rules_frame(spark), "2024-01-01 00:01:00").collect()}["application down"] == "Alerting"


def test_scans_api_shape(spark):
    pts = frame(spark, "patients", [pt_row("PT2"), pt_row("PT1")])
    out = tables.scan_patients(pts)
    assert out.columns == S.api_columns("patients")
    r = out.first()
    assert r.id == "PT1" and r.registrationDate == "2024-01-01T00:00:00.000Z"
    deps = spark.createDataFrame([("D2", "A", 1, 1, None, 1), ("D1", "B", 1, 1, None, 1)],
                                 S.bronze_schema("departments"))
    assert [r.id for r in tables.scan_departments(deps, order="name").collect()] == ["D2", "D1"]
    assert [r.id for r in tables.scan_departments(deps).collect()] == ["D1", "D2"]
    snap = tables.jdbc_snapshot(spark, "/root/testdata/sf0.001/orders.parquet", "orders", ["o_orderkey", "o_custkey"])
    assert snap.columns == ["o_orderkey", "o_custkey"] and snap.count() > 0


def test_write_bronze_layout_and_register(spark, tmp_dir):
    from wardlake.operators import registers
    txs = frame(spark, "transactions", [tx_row("T1", date="2024-01-05 00:00:00"),
                                        tx_row("T2", date="2024-02-05 00:00:00")])
    path = os.path.join(tmp_dir, "bz")
    tables.write_bronze(txs, "transactions", path, month_partitions=True)
    assert sorted(d for d in os.listdir(path) if d.startswith("month=")) == ["month=2024-01", "month=2024-02"]
    back = spark.read.parquet(path).where("month = '2024-02'")
    assert [r.id for r in back.collect()] == ["T2"]
    pts = frame(spark, "patients", [pt_row(f"PT{i}", state="OH" if i % 2 else "TX") for i in range(5)])
    reg = registers.patient_register(pts, 1, 2, state="OH")
    assert reg["info"].first().total == 2 and reg["page"].count() == 2
    assert [r.state for r in reg["states"].collect()] == ["OH", "TX"]
    assert reg["categories"].count() == 3


def test_medallion_bundles_and_sync(spark, tmp_dir):
    from tests.conftest import SF_SMALL
    from wardlake.plans import medallion
    from wardlake.sources.fixtures import load_hospital
    h = load_hospital(spark, SF_SMALL)
    m = medallion.medallion_metrics(h.as_dict())
    assert set(m) == {"bronze_count", "silver", "insurance_utilization", "department_profitability",
                      "monthly_revenue_trend", "doctor_performance"}
    s = m["silver"].first()
    assert 0 <= s.silver_clean_percentage <= 100 and s.silver_rows <= s.bronze_rows
    assert medallion.summary_stats(h.as_dict())["appointment_trends"].count() == 10
    out = medallion.sync(spark, h.as_dict(), os.path.join(tmp_dir, "bz"))
    assert out["status"].first().overall_status == "SUCCESS"
    assert {"silver_patients", "gold_dept_profitability"} <= {r.view for r in out["views"].collect()}
    assert spark.sql("SELECT COUNT(*) FROM silver_transactions").first()[0] > 0


def test_csv_line_is_parsed_once(spark, tmp_dir):
    """The check of a record is a filter; pushed into the parse it parsed a line dozens of times."""
    df = frame(spark, "transactions", [tx_row("T1"), tx_row("T2")])
    path = os.path.join(tmp_dir, "csv-once")
    tables.export_csv(df, "transactions", path)
    back = tables.read_export_csv(spark, path, "transactions")
    assert back._jdf.queryExecution().optimizedPlan().toString().count("from_csv") == 1
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_export_json_compressed(spark, tmp_dir):
    df = frame(spark, "transactions", [tx_row(f"T{i}") for i in range(20)])
    path = os.path.join(tmp_dir, "json-gz")
    tables.export_json(df, "transactions", path, compression="gzip")
    assert {f.rsplit(".", 1)[1] for f in os.listdir(path) if f.startswith("part-")} == {"gz"}
    assert sorted(map(tuple, tables.read_export_json(spark, path, "transactions").collect())) == sorted(map(tuple, df.collect()))
