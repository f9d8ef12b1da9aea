"""Streams with state and timers: alerts, links and keys checked as rows arrive, the
insurer view, each over several availableNow runs against a plain version."""

import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tests.helpers import frame, pt_row, tx_row
from wardlake.operators import gold, metrics, quality
from wardlake.sources import tables
from wardlake.streaming import alerts, batches, integrity, insurers
from wardlake.streaming import incremental as inc

T0 = datetime(2024, 1, 1)
SAMPLES = "metric string, ts timestamp, value double, labels map<string,string>"
RULES = [("db down", "db_up", 1.0, 60, True, "critical", "db"), ("db slow", "db_rate", 5.0, 120, False, "warning", "db"),
         ("app down", "up", 1.0, 45, True, "critical", "app", {"job": "app"}), ("never there", "ghost", 1.0, 60, True, "info", "app"),
         ("no service", "db_up", 0.5, 60, True, "info", None)]


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def alerts_by_hand(samples, rules, start, end, every=10, wait=10, interval=60, repeat=4 * 3600):
    """Every rule at every tick, and every group's notifications, the slow way."""
    out, states, groups = [], {}, {}
    for t in range(-(-start // every) * every, end + 1, every):
        for name, metric, limit, back, no_data, severity, service, *labels in rules:
            seen = [(ts, v) for m, ts, v, own in samples if m == metric and v is not None and t - back <= ts < t
                    and (not labels or all((own or {}).get(k) == x for k, x in labels[0].items()))]
            value = max(seen)[1] if seen else None
            state = ("Alerting" if no_data else "NoData") if value is None else "Alerting" if value < limit else "Normal"
            if states.get((service or "", name)) != state:
                states[service or "", name] = state
                out.append((service or "", t, "change", name, severity, state, "no data" if value is None else "value", value, None, None))
        for service in {r[6] or "" for r in rules}:
            firing = sorted(n for (s, n), x in states.items() if s == service and x == "Alerting")
            g = groups.setdefault(service, {"sent": [], "last": None, "due": None})
            if firing == g["sent"]:
                g["due"] = None
            elif g["due"] is None:
                g["due"] = max(t, g["last"] + interval) if g["sent"] else t + wait
            if g["due"] is not None and g["due"] <= t:
                out.append((service, t, "notify", None, None, None, None, None, firing, [n for n in g["sent"] if n not in firing]))
                g.update(sent=firing, last=t, due=None)
            elif g["sent"] and g["last"] + repeat <= t:
                out.append((service, t, "repeat", None, None, None, None, None, g["sent"], []))
                g["last"] = t
    return sorted(out, key=str)


def random_samples(rng, until):
    out = []
    for metric, gap in (("db_up", 40), ("db_rate", 90), ("up", 30), ("other", 200)):
        t = rng.random() * gap
        while t < until:
            own = {"job": rng.choice(["app", "web"])} if metric == "up" else None
            out.append((metric, round(t, 3), rng.choice([0.0, 1.0, 1.0, 7.0, None]), own))
            t += rng.random() * 2 * gap if rng.random() < 0.9 else 400
    return sorted(out, key=lambda s: s[1])


def test_group_equals_evaluating_every_tick():
    rng = random.Random(4)
    for k in range(30):
        samples = random_samples(rng, 3000)
        group = alerts.Group(57, 10, 20, 60, 900)
        rules = [r[:6] + ("g",) for r in RULES if r[1] != "up"]
        for r in rules:
            group.add(*[r[i] for i in (0, 2, 3, 4, 5)])
        rows = {}
        for m, ts, v, _ in samples:
            if v is not None:
                for r in rules:
                    if r[1] == m:
                        rows.setdefault(int(ts // 10 * 10 + 10), {})[r[0]] = (round(ts * 1e6), v)
        got = []
        for tick in sorted(rows):
            got += group.samples(tick, [(n, *x) for n, x in rows[tick].items()])
            text = group.dump()  # as it is kept between two micro-batches
            group = alerts.Group(57, 10, 20, 60, 900).load(text)
        got += group.advance(5000)
        want = alerts_by_hand(samples, rules, 57, 5000, wait=20, repeat=900)
        assert sorted([("g", *x) for x in got], key=str) == want


def test_alert_stream_over_three_arrivals(spark, tmp_dir):
    rng = random.Random(8)
    samples = random_samples(rng, 5400)
    end = [("end", 40_000.0, 1.0, None)]  # event time goes on: nothing else arrives
    landing, out, ck = (os.path.join(tmp_dir, x) for x in ("landing", "out", "ck"))
    rules = metrics.rules_frame(spark, RULES)
    counts = []
    for i, part in enumerate([samples[:90], samples[90:180], samples[180:] + end]):
        rows = [(m, at(t), v, own) for m, t, v, own in part]
        rng.shuffle(rows)
        spark.createDataFrame(rows, SAMPLES).coalesce(2).write.parquet(f"{landing}/a{i}")
        stream = spark.readStream.schema(SAMPLES).parquet(f"{landing}/*")
        alerts.stream_threshold_alerts(stream, rules, out, ck, at(100), fold_every=2).awaitTermination()
        counts.append(alerts.read_alerts(spark, out).count())
    base = int(T0.replace(tzinfo=timezone.utc).timestamp())
    got = sorted([(r.service, int(r.at.replace(tzinfo=timezone.utc).timestamp()) - base, *r[2:])
                  for r in alerts.read_alerts(spark, out).collect()], key=str)
    want = alerts_by_hand(samples, RULES, 100, 39_940)  # the last watermark
    assert got == want
    assert counts[0] < counts[1] < counts[2] and {r[2] for r in got} == {"change", "notify", "repeat"}
    # the state and the states of the batch form agree at a time in between
    now = at(3000)
    shown = spark.createDataFrame([(m, at(t), v, own) for m, t, v, own in samples], SAMPLES)
    batch = {r.rule: r.state for r in metrics.threshold_alerts(shown.where(F.col("ts") < F.lit(now)), rules, now).collect()}
    last = {}
    for x in sorted((x for x in want if x[2] == "change" and x[1] <= 3000), key=lambda x: x[1]):
        last[x[3]] = x[5]
    assert last == batch


def test_errors_fire_in_both_forms(spark):
    from wardlake.operators.metrics import threshold_alerts
    rows = [("a", at(10), 5.0, None), ("a", at(20), None, "connection refused"), ("b", at(20), None, "timeout"), ("b", at(31), 2.0, None),
            ("c", at(20), 9.0, "both"), ("d", at(20), None, None)]
    df = spark.createDataFrame(rows, "metric string, ts timestamp, value double, error string")
    rules = [(m, m, 1.0, 60, False, "x", "s") for m in "abcd"]
    got = {r.rule: (r.state, r.value) for r in threshold_alerts(df, metrics.rules_frame(spark, rules), at(40)).collect()}
    assert got == {"a": ("Alerting", None), "b": ("Normal", 2.0), "c": ("Alerting", None), "d": ("NoData", None)}
    group = alerts.Group(0)
    for r in rules:
        group.add(*[r[i] for i in (0, 2, 3, 4, 5)])
    last = alerts.last_per_interval(df, metrics.rules_frame(spark, rules)).collect()
    base = int(T0.replace(tzinfo=timezone.utc).timestamp())
    out = []
    for tick in sorted({r.tick for r in last}):
        out += group.samples(tick, [(r.rule, r.ts, r.value, r.error) for r in last if r.tick == tick])
    states = {x[2]: (x[4], x[5]) for x in out if x[1] == "change" and x[0] <= base + 40}
    assert states == {"a": ("Alerting", "error"), "b": ("Normal", "value"), "c": ("Alerting", "error"), "d": ("NoData", "no data")}


def test_samples_of_a_hot_metric_are_not_dealt_by_metric(spark):
    df = spark.createDataFrame([("a", at(10), 5.0)], "metric string, ts timestamp, value double")
    plan = alerts.last_per_interval(df, metrics.rules_frame(spark, RULES))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning(metric" not in plan


def _arrive(spark, folder, rows, schema, hour):
    spark.createDataFrame(rows, schema).withColumn("_arrived", F.lit(str(T0 + timedelta(hours=hour))).cast("timestamp")) \
        .coalesce(1).write.mode("append").parquet(folder)


def test_orphans_after_the_bound(spark, tmp_dir):
    c, p, out, ck = (os.path.join(tmp_dir, x) for x in ("c", "p", "out", "ck"))
    child, parent = "id string, patient_id string", "id string"
    known = spark.createDataFrame([("P-old",)], parent)

    def run():
        streams = [spark.readStream.schema(s + ", _arrived timestamp").parquet(d) for s, d in ((child, c), (parent, p))]
        integrity.stream_orphans(*streams, "patient_id", out, ck, lambda s: known, bound="2 hours").awaitTermination()
        return sorted(r[0] for r in integrity.read_found(spark, out, child).collect())

    _arrive(spark, c, [("T1", "P1"), ("T2", "P-late"), ("T3", "P-never"), ("T4", "P-old"), ("T5", None), ("T6", "P-too-late")], child, 0)
    _arrive(spark, p, [("P1",), ("P1",)], parent, 0)
    assert run() == []
    _arrive(spark, p, [("P-late",)], parent, 1)
    _arrive(spark, c, [("T7", "P1"), ("T8", "P-never")], child, 1)
    assert run() == []
    _arrive(spark, p, [("P-too-late",)], parent, 5)
    _arrive(spark, c, [("T9", "P1")], child, 5)  # its patient came longer than the bound ago and is not in the table
    assert run() == ["T3", "T6", "T8"]
    _arrive(spark, p, [("P-end",)], parent, 20)
    _arrive(spark, c, [("T-end", "P-end")], child, 20)
    assert run() == ["T3", "T6", "T8", "T9"]
    assert run() == ["T3", "T6", "T8", "T9"]


def test_repeated_keys_within_a_gap(spark, tmp_dir):
    src, out, ck = (os.path.join(tmp_dir, x) for x in ("src", "out", "ck"))

    def run():
        df = spark.readStream.schema("id string, _arrived timestamp").parquet(src)
        integrity.stream_repeated_keys(df, out, ck).awaitTermination()
        return sorted(tuple(r) for r in integrity.read_found(spark, out, "id string, occurrences bigint").collect())

    _arrive(spark, src, [("A",), ("A",), ("B",), ("C",)], "id string", 0)
    assert run() == []
    _arrive(spark, src, [("C",), ("D",)], "id string", 0.5)
    _arrive(spark, src, [("B",)], "id string", 3)  # longer after the first than the gap
    assert run() == [("A", 2), ("C", 2)]
    _arrive(spark, src, [("end",)], "id string", 9)
    assert run() == [("A", 2), ("C", 2)]


def test_replayed_landing_file_adds_no_row_and_state_is_bounded(spark, tmp_dir):
    src, bronze, ck = (os.path.join(tmp_dir, x) for x in ("src", "bronze", "ck"))
    from wardlake import schemas as S
    schema = S.bronze_schema("transactions")
    state = []
    for hour in range(12):
        rows = [tx_row(f"T{hour}-{i}") for i in range(20)]
        _arrive(spark, src, rows, schema, hour)
        _arrive(spark, src, rows[:7], schema, hour + 0.25)  # the same again, in a later file
        df = spark.readStream.schema(S.bronze_schema("transactions").add("_arrived", "timestamp")).parquet(src)
        q = inc.stream_bronze_append(spark, "", "transactions", bronze, ck, source=df, once_within="2 hours", fold_every=4)
        q.awaitTermination()
        state.append(q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    ids = [r.id for r in tables.read_bronze_table(spark, bronze, "transactions").collect()]
    assert len(ids) == len(set(ids)) == 240
    assert max(state) <= 5 * 20  # the keys of the last hours, not of the whole day


def test_replayed_file_by_its_own_time(spark, tmp_dir):
    landing, bronze, ck = (os.path.join(tmp_dir, x) for x in ("landing", "bronze", "ck"))
    df = frame(spark, "transactions", [tx_row(f"T{i}") for i in range(5)])
    for name in ("a", "b"):  # the same rows delivered twice
        df.coalesce(1).write.parquet(f"{landing}/{name}")
        inc.stream_bronze_append(spark, f"{landing}/*", "transactions", bronze, ck, once_within="1 day").awaitTermination()
    assert tables.read_bronze_table(spark, bronze, "transactions").count() == 5


def test_insurer_view_is_current_after_every_arrival(spark, tmp_dir):
    tx, pt, out, ck = (os.path.join(tmp_dir, x) for x in ("tx", "pt", "out", "ck"))
    from wardlake import schemas as S
    rng = random.Random(6)
    charges, patients = [], {}
    for arrival in range(3):
        new = [tx_row(f"T{arrival}-{i}", patient="P0" if rng.random() < 0.4 else f"P{rng.randrange(12)}", amount=rng.randrange(9999) / 100)
               for i in range(60)] + [tx_row(f"U{arrival}", patient=None, amount=5)]
        moved = [pt_row(f"P{i}", insurer=rng.choice(["A", "B", "C"])) for i in range(12) if rng.random() < 0.5] + [
            pt_row("P0", insurer="ABC"[arrival])]
        frame(spark, "transactions", new).repartition(3).write.mode("append").parquet(tx)
        frame(spark, "patients", moved).withColumn("version", F.lit(arrival)).coalesce(1).write.mode("append").parquet(pt)
        charges += new
        for i in {r[0] for r in moved}:  # of equal versions the greater name counts
            patients[i] = max((r for r in moved if r[0] == i), key=lambda r: r[8])
        insurers.stream_insurance_utilization(
            spark.readStream.schema(S.bronze_schema("transactions")).parquet(tx),
            spark.readStream.schema(S.bronze_schema("patients").add("version", "integer")).parquet(pt), out, ck, fold_every=2).awaitTermination()
        want = gold.gold_insurance_utilization(frame(spark, "transactions", charges), frame(spark, "patients", list(patients.values())))
        got = insurers.read_insurance_utilization(spark, out)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


# ---- folders of micro-batches ----------------------------------------------------------

def test_fold_keeps_rows_and_recognises_replays(spark, tmp_dir):
    base = os.path.join(tmp_dir, "b")
    rows = lambda n: spark.range(n, n + 3)
    for i in range(5):
        assert batches.write_batch(rows(10 * i), base, "q", i)
    read = lambda: sorted(r[0] for r in spark.read.schema("id long").parquet(*batches.committed(spark, base)).collect())
    before = read()
    assert batches.fold(spark, base, "id long") and read() == before
    assert len(batches.committed(spark, base)) == 2  # the folded one, and the last
    assert not batches.write_batch(rows(99), base, "q", 4) and read() == before  # a replay
    for i in range(5, 8):
        batches.write_batch(rows(10 * i), base, "q", i)
    assert batches.fold(spark, base, "id long")
    assert read() == sorted(before + [x for i in range(5, 8) for x in range(10 * i, 10 * i + 3)])
    assert not os.path.exists(f"{base}/query=q/batch=0")  # covered by the fold before the last


def test_lost_mark_is_an_error(spark, tmp_dir):
    for i in range(3):
        batches.write_batch(spark.range(3), tmp_dir, "q", i)
    os.remove(f"{tmp_dir}/query=q/batch=2/{batches.MARK}")
    assert len(batches.committed(spark, tmp_dir)) == 2  # the newest may still be being written
    os.remove(f"{tmp_dir}/query=q/batch=0/{batches.MARK}")
    with pytest.raises(RuntimeError):
        batches.committed(spark, tmp_dir)


def test_marks_do_not_depend_on_the_committer(spark, tmp_dir):
    conf = spark._jsc.hadoopConfiguration()
    conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        silver = os.path.join(tmp_dir, "silver")
        inc.silver_upsert_batch(spark, frame(spark, "transactions", [tx_row(f"T{i}") for i in range(100)]), 0, silver)
    finally:
        conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")
    assert inc.read_silver(spark, silver).count() == 100


def test_stored_null_date_stays_as_in_a_merge(spark, tmp_dir):
    from wardlake.operators import upsert
    silver = os.path.join(tmp_dir, "silver")
    none = ("T1", "PT1", None, None) + tx_row("T1", amount=1)[4:]
    late = ("T2", "PT1", None, None) + tx_row("T2", amount=3)[4:]
    parts = [[none, tx_row("T2", amount=1)], [tx_row("T1", amount=2), late], [tx_row("T1", amount=4, date="2025-01-01 00:00:00")]]
    want = frame(spark, "transactions", [])
    for i, part in enumerate(parts):
        df = frame(spark, "transactions", part)
        inc.silver_upsert_batch(spark, df, i, silver)
        want = upsert.merge_upsert(want, quality.dedupe_latest(df, "id", "date"))
        assert sorted(map(str, inc.read_silver(spark, silver).collect())) == sorted(map(str, want.collect()))
        if i == 1:
            inc.compact_silver(spark, silver)
    assert {r.id: float(r.amount) for r in inc.read_silver(spark, silver).collect()} == {"T1": 1.0, "T2": 1.0}


# ---- state that does not sit on the heap ------------------------------------------------

def test_repeated_keys_keep_no_state_and_folds_keep_open_sessions(spark, tmp_dir):
    src, out, ck = (os.path.join(tmp_dir, x) for x in ("src", "out", "ck"))
    for hour, keys in [(0, "AABN"), (0.8, "AC"), (1.6, "AD"), (3, "BD"), (9, "EE"), (20, "F")]:
        _arrive(spark, src, [(None if k == "N" else k,) for k in keys] + [(None,)] * (hour == 0.8), "id string", hour)
        df = spark.readStream.schema("id string, _arrived timestamp").parquet(src)
        q = integrity.stream_repeated_keys(df, out, ck, fold_every=1)
        q.awaitTermination()
        assert not q.recentProgress[-1]["stateOperators"]
    got = {tuple(r) for r in integrity.read_found(spark, out, "id string, occurrences bigint").collect()}
    assert got == {("A", 4), (None, 2), ("E", 2)}


def test_orphans_keep_no_state_and_folds_keep_what_waits(spark, tmp_dir):
    c, p, out, ck = (os.path.join(tmp_dir, x) for x in ("c", "p", "out", "ck"))
    child, parent = "id string, patient_id string", "id string"
    for hour, charges, people in [(0, "ab", "a"), (1, "cd", "x"), (2.5, "ax", "c"), (5, "a", "b"), (20, "z", "z")]:
        _arrive(spark, c, [(f"T{hour}{x}", x) for x in charges], child, hour)
        _arrive(spark, p, [(x,) for x in people], parent, hour)
        streams = [spark.readStream.schema(s + ", _arrived timestamp").parquet(d) for s, d in ((child, c), (parent, p))]
        q = integrity.stream_orphans(*streams, "patient_id", out, ck, lambda s: None, bound="2 hours", fold_every=1)
        q.awaitTermination()
        assert not q.recentProgress[-1]["stateOperators"]
    assert sorted(r[0] for r in integrity.read_found(spark, out, child).collect()) == ["T0b", "T1d", "T2.5a", "T5a"]


def test_insurer_differences_need_no_state_store(spark, tmp_dir):
    known = spark.createDataFrame([("P1", "A", 0, 2, 300), ("P1", None, None, 1, 50), ("P2", None, None, 1, 10), ("P3", "A", 0, 1, 5)],
                                  insurers.PATIENT_SCHEMA)
    added = spark.createDataFrame([("P1", "B", 1, 1, 7), ("P2", "A", 0, 0, 0)], insurers.PATIENT_SCHEMA)
    assert sorted(map(tuple, insurers.differences(known, added).collect())) == [("A", -2, -340), ("B", 4, 357)]


def test_keys_of_repeated_files_are_kept_off_the_heap(spark, tmp_dir):
    landing, bronze, ck = (os.path.join(tmp_dir, x) for x in ("landing", "bronze", "ck"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    frame(spark, "transactions", [tx_row("T1"), tx_row("T1")]).write.parquet(f"{landing}/a")
    q = inc.stream_bronze_append(spark, f"{landing}/*", "transactions", bronze, ck, once_within="1 day", count_state=False)
    q.awaitTermination()
    assert any(k.startswith("rocksdb") for k in q.recentProgress[0]["stateOperators"][0]["customMetrics"])
    assert tables.read_bronze_table(spark, bronze, "transactions").count() == 1
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_silver_rows_are_dealt_once(spark, tmp_dir):
    for i in range(2):
        inc.silver_upsert_batch(spark, frame(spark, "transactions", [tx_row("T1", amount=10 + i), tx_row(f"T{i + 2}")]), i, tmp_dir)
    df = inc.read_silver(spark, tmp_dir)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    below = plan[plan.index("Exchange" if "Exchange" in plan else "Repartition"):] if "Exchange" in plan or "Repartition" in plan else plan
    assert "Aggregate" not in below  # no struct is built before the shuffle
    assert df.count() == 3
