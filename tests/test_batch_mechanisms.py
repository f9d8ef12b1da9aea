"""Quarantine of CSV records, refresh generations, month-wise merge, split reads, pages
by number, the metric grid, guarded ad hoc SQL, key blocks."""

import glob
import os
import random
import re
import shutil
import threading
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.helpers import frame, pt_row, tx_row
from wardlake.operators import key_blocks, metrics, partitioned, registers, upsert
from wardlake.plans import presets
from wardlake.sources import tables
from wardlake.sources.fixtures import load_hospital
from wardlake.streaming import incremental as inc


def rows(df):
    return sorted(map(str, df.collect()))


# ---- CSV records that do not parse -----------------------------------------------------

HEADER = "id,patientId,appointmentId,date,amount,type,insuranceCoverage,paymentType,department"
GOOD = "T1,P1,NULL,2024-01-05T10:00:00.000Z,100,Pharmacy,0,Insurance,\"Card, \"\"Main\"\"\""
LINES = [GOOD, "T2,P1,NULL,yesterday,100,Pharmacy,0,Insurance,X", "T3,P1", "", "T4,P1,NULL,,1e3x,Pharmacy,zero,Insurance,X",
         GOOD.replace("T1,", "T5,"), GOOD.replace("T1,", "T6,") + ",one more", "T7,P1,AP1,,1.5,Pharmacy,,Cash,\u0001", "T8,P1,AP1,,1.5,Pharmacy,,Cash,\"\""]


def landing(folder, files):
    os.makedirs(folder)
    for name, lines in files.items():
        with open(f"{folder}/{name}.csv", "w") as f:
            f.write("\n".join([HEADER, *lines]) + "\n")


def check_sorted_out(spark, bronze, lines):
    good = {r.id: r for r in tables.read_bronze_table(spark, bronze, "transactions").collect()}
    assert set(good) == {"T1", "T5", "T7", "T8"}
    assert (good["T1"].department, good["T7"].department, good["T8"].department) == ('Card, "Main"', "\u0001", "")
    assert good["T1"].appointment_id is None and good["T7"].date is None
    bad = tables.read_rejected(spark, bronze, "transactions").collect()
    assert {r.raw: r.reason for r in bad} == {
        LINES[1]: "date is no timestamp", "T3,P1": "wrong number of fields", "": "empty line",
        LINES[4]: "amount is no decimal(10,2); insuranceCoverage is no decimal(10,2)", LINES[6]: "wrong number of fields"}
    assert all(r.file.endswith((".csv")) for r in bad)
    assert len(good) + len(bad) == lines


def test_load_sets_bad_records_aside(spark, tmp_dir):
    landing(f"{tmp_dir}/in", {"a": LINES[:4], "b": LINES[4:]})
    bronze = f"{tmp_dir}/bronze"
    assert tables.load_bronze_csv(spark, f"{tmp_dir}/in", "transactions", bronze, load_id="monday").count() == 4
    tables.load_bronze_csv(spark, f"{tmp_dir}/in", "transactions", bronze, load_id="monday")  # once
    check_sorted_out(spark, bronze, len(LINES))
    with pytest.raises(Exception, match="bad CSV record in .*"):
        tables.read_export_csv(spark, f"{tmp_dir}/in", "transactions").collect()
    with pytest.raises(Exception, match="bad CSV record"):
        tables.read_export_csv(spark, f"{tmp_dir}/in", "transactions").count()


def test_stream_sets_bad_records_aside(spark, tmp_dir):
    bronze, ck = f"{tmp_dir}/bronze", f"{tmp_dir}/ck"
    for name, part in (("a", LINES[:4]), ("b", LINES[4:])):
        landing(f"{tmp_dir}/in/{name}", {name: part})
        inc.stream_bronze_append(spark, f"{tmp_dir}/in/*", "transactions", bronze, ck, fmt="csv").awaitTermination()
    check_sorted_out(spark, bronze, len(LINES))


def test_line_breaks_are_set_aside_or_escaped(spark, tmp_dir):
    df = frame(spark, "patients", [pt_row(f"PT{i}", name="Ann\nLee") for i in range(20)])
    tables.export_csv(df, "patients", f"{tmp_dir}/quoted")  # a record is two lines
    bronze = f"{tmp_dir}/bronze"
    assert tables.load_bronze_csv(spark, f"{tmp_dir}/quoted", "patients", bronze).count() == 0
    assert tables.read_rejected(spark, bronze, "patients").count() == 40
    assert rows(tables.read_export_csv(spark, f"{tmp_dir}/quoted", "patients", multi_line=True)) == rows(df)
    odd = frame(spark, "patients", [pt_row(f"PT{i}", name=n) for i, n in enumerate(
        ["a\nb", "\n", "\r\n", "\\n", "\\", "\\\\n\n", "\\_", "\\_n", "\u0001", "\u0001\n\u0001", "", "NULL", " x ", '"', ","])])
    tables.export_csv(odd, "patients", f"{tmp_dir}/escaped", one_line=True)
    assert rows(tables.read_export_csv(spark, f"{tmp_dir}/escaped", "patients", one_line=True)) == rows(odd)


def test_copied_bronze_reads_the_same(spark, tmp_dir):
    """Times of files say nothing: a copy of the folder holds the same rows."""
    bronze, old = f"{tmp_dir}/bronze", frame(spark, "transactions", [tx_row(f"O{i}") for i in range(100)])
    tables.export_csv(old, "transactions", f"{tmp_dir}/csv")
    tables.load_bronze_csv(spark, f"{tmp_dir}/csv", "transactions", bronze)
    full = frame(spark, "transactions", [tx_row(f"N{i}") for i in range(100)])
    assert tables.bronze_full_refresh(spark, {"transactions": full}, bronze).first().success
    shutil.copytree(bronze, f"{tmp_dir}/copy")  # new times
    for folder in (bronze, f"{tmp_dir}/copy"):
        assert {r.id[0] for r in tables.read_bronze_table(spark, folder, "transactions").collect()} == {"N"}
    tables.load_bronze_csv(spark, f"{tmp_dir}/csv", "transactions", f"{tmp_dir}/copy")
    assert tables.read_bronze_table(spark, f"{tmp_dir}/copy", "transactions").count() == 200


def test_loads_around_a_failed_refresh_stay(spark, tmp_dir):
    bronze, one = f"{tmp_dir}/bronze", lambda i: frame(spark, "transactions", [tx_row(i)])
    assert tables.bronze_full_refresh(spark, {"transactions": one("A")}, bronze).first().success

    def load(i):
        tables.export_csv(one(i), "transactions", f"{tmp_dir}/{i}")
        tables.load_bronze_csv(spark, f"{tmp_dir}/{i}", "transactions", bronze)
        return {r.id for r in tables.read_bronze_table(spark, bronze, "transactions").collect()}

    load("B")
    bad = one("X").withColumn("type", F.raise_error(F.lit("no")))
    assert not tables.bronze_full_refresh(spark, {"transactions": bad}, bronze).first().success
    assert load("C") == {"A", "B", "C"}
    assert tables.bronze_full_refresh(spark, {"transactions": one("D")}, bronze).first().success
    assert load("E") == {"D", "E"}
    left = [os.path.basename(p) for p in glob.glob(f"{bronze}/transactions/refresh/v=*")]
    assert len(left) == 2  # the failed one is gone


# ---- MERGE by month --------------------------------------------------------------------

def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/month=*/*.parquet")}


@pytest.mark.parametrize("bloom_limit", [partitioned.BLOOM_LIMIT, 0])
def test_merge_by_month_equals_the_full_merge(spark, tmp_dir, bloom_limit):
    rng, path = random.Random(3), f"{tmp_dir}/t"
    day = lambda: str(datetime(2024, 1, 1) + timedelta(days=rng.randrange(360)))
    target = frame(spark, "transactions", [tx_row(f"T{i:04d}", date=day(), amount=i) for i in range(800)]
                   + [("T9", "P", None, None) + tx_row("x")[4:]] + [tx_row("ALONE", date="2020-05-05 00:00:00")])
    partitioned.write_by_month(target, path)
    before = files(path)
    months = Counter(r[0] for r in target.select(partitioned.month_of()).collect())
    some = [r for r in target.collect() if r.date is not None and r.date.month == 3][:20]
    source = frame(spark, "transactions", [
        *[tx_row(r.id, date=str(r.date + timedelta(days=40)), amount=7, pay="Cash") for r in some],  # moves on
        *[tx_row(r.id, date=str(r.date - timedelta(days=90)), amount=8) for r in some[:5]],  # older: ignored
        tx_row("NEW1", date="2024-03-03 00:00:00"), tx_row("NEW2", date="2025-07-07 00:00:00"),
        tx_row("ALONE", date="2024-04-04 00:00:00"), tx_row("T9", date="2024-04-01 00:00:00")])
    done = partitioned.merge_by_month(spark, path, source, bloom_limit=bloom_limit)
    want = upsert.merge_upsert(target, source)
    assert rows(partitioned.read_by_month(spark, path).drop("month")) == rows(want)
    after = files(path)
    untouched = [f for f in before if f.split("month=")[1].split("/")[0] not in done]
    assert len(set(months) - set(done)) >= 6 and untouched and all(after.get(f) == before[f] for f in untouched)
    assert not os.path.exists(f"{path}/month=2020-05")  # its only row has moved
    assert partitioned.merge_by_month(spark, path, source.limit(0)) == []


def test_cut_off_merge_is_completed(spark, tmp_dir, monkeypatch):
    path = f"{tmp_dir}/t"
    target = frame(spark, "transactions", [tx_row(f"T{i}", date=f"2024-0{1 + i % 6}-01 00:00:00") for i in range(60)])
    source = frame(spark, "transactions", [tx_row(f"T{i}", date="2024-08-01 00:00:00", amount=3) for i in range(6)])
    partitioned.write_by_month(target, path)
    publish = partitioned._publish

    def half(spark, path, stage, months, *rest):  # one month is replaced, then the driver is lost
        staged = partitioned.read_by_month(spark, stage).where("month = '2024-08'")
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
        raise RuntimeError("lost")

    monkeypatch.setattr(partitioned, "_publish", half)
    with pytest.raises(RuntimeError):
        partitioned.merge_by_month(spark, path, source)
    monkeypatch.setattr(partitioned, "_publish", publish)
    assert partitioned.finish_merge(spark, path)
    assert rows(partitioned.read_by_month(spark, path).drop("month")) == rows(upsert.merge_upsert(target, source))
    assert not partitioned.finish_merge(spark, path) and not glob.glob(f"{path}/_*stage*")


def test_bloom_filter_loses_no_key(spark):
    keys = spark.range(0, 30_000, 3).select(F.concat(F.lit("K"), "id").alias("id"))
    blocks = -(-10_000 * partitioned.BITS_PER_KEY // partitioned.BLOCK_BITS)
    every = spark.range(0, 30_000).select("id", F.concat(F.lit("K"), "id").alias("k"))
    hit = partitioned.may_contain(every, "k", partitioned.bloom(keys, "id", blocks), blocks).select("id").collect()
    found = {r.id for r in hit}
    assert found >= set(range(0, 30_000, 3)) and len(found) < 10_000 + 0.04 * 20_000


def month_tables(spark):
    """A target with keys that come twice and rows without key or date, and a source
    that moves, changes and adds rows and empties months."""
    at = lambda i: f"2024-{1 + i % 6:02d}-{1 + i % 28:02d} 00:00:00"
    target = frame(spark, "transactions", [
        *[tx_row(f"T{i:03d}", date=at(i), amount=i) for i in range(240)], *[tx_row(f"T{i:03d}", date=at(i + 1), amount=i) for i in range(0, 240, 40)],
        tx_row(None, date=at(2)), tx_row(None, date=at(3)), tx_row("ALONE", date="2019-05-05 00:00:00"),
        tx_row("A0", date="2018-05-05 00:00:00"), ("T9", "P", None, None) + tx_row("x")[4:]])
    source = frame(spark, "transactions", [
        *[tx_row(f"T{i:03d}", date="2024-08-02 00:00:00", amount=7, pay="Cash") for i in range(0, 240, 7)],
        *[tx_row(f"T{i:03d}", date="2020-01-01 00:00:00", amount=8) for i in range(0, 240, 11)],
        *[tx_row(f"N{i:02d}", date=at(i)) for i in range(12)], tx_row(None, date=at(4), amount=9),
        tx_row("ALONE", date="2024-03-03 00:00:00"), tx_row("A0", date="2024-03-04 00:00:00"), tx_row("T9", date="2024-04-01 00:00:00")])
    return target, source


def test_merge_by_month_in_ranges_of_keys(spark, tmp_dir, monkeypatch):
    path, (target, source), ends = f"{tmp_dir}/t", month_tables(spark), []
    write = partitioned._write
    monkeypatch.setattr(partitioned, "SLICE_BYTES", 1)
    monkeypatch.setattr(partitioned, "_write", lambda df, *rest: (ends.append(df.agg(F.min("id"), F.max("id")).first()), write(df, *rest)))
    partitioned.write_by_month(target, path, slices=partitioned.slices_of(1 << 40))
    assert len(ends) == 4 and all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    assert rows(partitioned.read_by_month(spark, path).drop("month")) == rows(target)
    assert not glob.glob(f"{path}/_*stage*")
    ends.clear()
    partitioned.merge_by_month(spark, path, source)
    assert len(ends) > 4 and all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    assert rows(partitioned.read_by_month(spark, path).drop("month")) == rows(upsert.merge_upsert(target, source))


def test_merged_months_are_moved_not_copied(spark, tmp_dir, monkeypatch):
    path, (target, source), staged = f"{tmp_dir}/t", month_tables(spark), []
    partitioned.write_by_month(target, path)
    publish = partitioned._publish
    monkeypatch.setattr(partitioned, "_publish", lambda s, p, stage, *rest: (staged.extend(files(stage)), publish(s, p, stage, *rest)))
    done = partitioned.merge_by_month(spark, path, source)
    names = lambda fs: sorted(f.split("month=")[1] for f in fs)
    assert names(f for f in files(path) if f.split("month=")[1].split("/")[0] in done) == names(staged)
    assert not glob.glob(f"{path}/month=2018-05") and not glob.glob(f"{path}/month=2019-05")


@pytest.mark.parametrize("calls", [1, 5, 9])
def test_merge_cut_off_among_the_months_is_completed(spark, tmp_dir, monkeypatch, calls):
    path, (target, source) = f"{tmp_dir}/t", month_tables(spark)
    partitioned.write_by_month(target, path)
    remove, publish, left = partitioned.remove_path, partitioned._publish, [calls]

    def cut(s, p):  # the driver is lost before a removal
        if not left[0]:
            raise RuntimeError("lost")
        left[0] -= 1
        remove(s, p)

    def lossy(*args):
        monkeypatch.setattr(partitioned, "remove_path", cut)
        publish(*args)

    monkeypatch.setattr(partitioned, "_publish", lossy)
    with pytest.raises(RuntimeError, match="lost"):
        partitioned.merge_by_month(spark, path, source)
    monkeypatch.undo()
    if os.path.exists(f"{path}/_merging"):
        assert partitioned.finish_merge(spark, path)
    assert rows(partitioned.read_by_month(spark, path).drop("month")) == rows(upsert.merge_upsert(target, source))


def test_merge_by_month_drops_its_shuffles(spark, tmp_dir):
    path, (target, source) = f"{tmp_dir}/t", month_tables(spark)
    dirs = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffles = lambda: {f for d in dirs for _, _, fs in os.walk(d) for f in fs if f.startswith("shuffle_")}
    partitioned.write_by_month(target, path)
    before, end = shuffles(), time.time() + 10
    partitioned.merge_by_month(spark, path, source)
    while shuffles() - before and time.time() < end:  # removed in the background
        time.sleep(0.2)
    assert not shuffles() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


# ---- split reads -----------------------------------------------------------------------

def test_split_read_of_text_keys_with_hot_prefixes(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    key = (F.when(F.col("id") % 10 < 7, F.concat(F.lit("TX-2024-01-"), F.lpad("id", 9, "0")))
           .when(F.col("id") % 10 < 9, F.concat(F.lit("o'hara"), "id")).when(F.col("id") % 100 != 99, F.concat(F.lit("é"), "id")))
    spark.range(20_000).select(key.alias("k"), "id").write.parquet(path)
    df = spark.read.parquet(path)
    conditions = tables.split_predicates(tables.split_bounds(df, "k", 16), "k")
    counts = [df.where(c).count() for c in conditions]
    assert len(conditions) == 16 and sum(counts) == 20_000 and max(counts) <= 2 * 20_000 / 16
    out = tables.jdbc_snapshot(spark, path, "t", ["id"], split_by="k", num_partitions=16)
    assert sorted(r.id for r in out.collect()) == list(range(20_000))


def test_split_of_few_or_equal_keys(spark):
    none = spark.createDataFrame([], "k string")
    assert tables.split_predicates(tables.split_bounds(none, "k", 4), "k") == ["1 = 1"]
    same = spark.createDataFrame([("a",)] * 50 + [("b",)] * 2 + [(None,)], "k string")
    cond = tables.split_predicates(tables.split_bounds(same, "k", 4), "k")
    assert sum(same.where(c).count() for c in cond) == 53
    assert tables.split_predicates([5, 9], "n") == ["(n < 5 OR n IS NULL)", "(n >= 5 AND n < 9)", "(n >= 9)"]


# ---- pages by number -------------------------------------------------------------------

def test_page_by_number_equals_offset_over_ties(spark, tmp_dir):
    rng = random.Random(2)
    df = frame(spark, "transactions", [tx_row(f"T{i:05d}", date=f"2024-01-0{rng.randint(1, 3)} 00:00:00") for i in range(997)]).repartition(7)
    order = [("date", True), ("id", False)]
    registers.page_index(df, order, f"{tmp_dir}/index", limit=20)
    index = spark.read.parquet(f"{tmp_dir}/index")
    assert sorted(r.page for r in index.collect()) == list(range(1, 51))
    by = [F.col("date").desc(), F.col("id").asc()]
    for n in (1, 2, 25, 49, 50):
        got = registers.page_by_number(df, order, index, n, 20)
        assert [r.id for r in got.collect()] == [r.id for r in registers.page(df, by, n, 20).collect()]
    plan = got._jdf.queryExecution().toString()
    assert "Offset" not in plan and "TakeOrderedAndProject(limit=20" in plan
    assert registers.page_by_number(df, order, index, 51, 20).count() == 0
    kind = df.where("type = 'Pharmacy'")
    registers.page_index(kind, registers.REGISTER_ORDER["transactions"], f"{tmp_dir}/register")
    index = spark.read.parquet(f"{tmp_dir}/register")
    pages = [registers.page_transactions(df, 70, type="Pharmacy", index=i).collect() for i in (index, None)]
    assert pages[0] == pages[1] and len(pages[0]) == 10


def test_page_index_sorts_bounded_parts(spark, tmp_dir, monkeypatch):
    from wardlake import session
    monkeypatch.setattr(registers, "INDEX_ROWS", 100)
    kept = []
    monkeypatch.setattr(session, "remove_path", lambda s, p: kept.append(p))
    rng = random.Random(3)
    df = frame(spark, "transactions", [tx_row(f"T{i:05d}", date=f"2024-01-0{rng.randint(1, 3)} 00:00:00") for i in range(997)]).repartition(3)
    order = registers.REGISTER_ORDER["transactions"]
    registers.page_index(df, order, f"{tmp_dir}/index", limit=20)
    index = spark.read.parquet(f"{tmp_dir}/index")
    parts = spark.read.parquet(next(p for p in kept if "page-index" in p)).groupBy("_part").count().collect()
    # more parts than the session's four shuffle partitions, none much larger than the bound
    assert len(parts) == 10 and max(r["count"] for r in parts) < 200 and sum(r["count"] for r in parts) == 997
    for n in (1, 6, 31, 50):
        want = registers.page(df, [F.col("date").desc(), F.col("id").desc()], n, 20).collect()
        assert [r.id for r in registers.page_by_number(df, [(c, True) for c in order], index, n, 20).collect()] == [r.id for r in want]


def test_large_charges_are_dealt_to_bounded_tasks(spark, monkeypatch):
    from wardlake.plans import registry
    from wardlake.sources import fixtures
    small = {n: sorted(registry.QUERIES[n](spark, SF_SMALL).collect()) for n in ("check_unique_key", "check_constraints", "page_by_number")}
    assert fixtures.load_hospital(spark, SF_SMALL).parts is None
    monkeypatch.setattr(fixtures, "LARGE_BYTES", 1)
    monkeypatch.setattr(fixtures, "PART_BYTES", 12_000)
    h = fixtures.load_hospital(spark, SF_SMALL)
    assert h.parts > 4
    plan = h.transactions._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(rf"hashpartitioning\(l_orderkey#\d+L, {h.parts}\)", plan)) == 2
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n, want in small.items():
        assert sorted(registry.QUERIES[n](spark, SF_SMALL).collect()) == want, n
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


# ---- metric grid -----------------------------------------------------------------------

def test_metric_grid_by_hand(spark, monkeypatch):
    monkeypatch.setattr(metrics, "GRID_CHUNK", 7)
    rng, t0 = random.Random(1), datetime(2024, 1, 1)
    data = [(m, t0 + timedelta(seconds=rng.randrange(-50, 2000), milliseconds=rng.randrange(2) * 500), rng.choice([1.0, 2.0, None]))
            for m in "abc" for _ in range(25)] + [("late", t0 + timedelta(seconds=5000), 1.0), ("a", None, 1.0)]
    df = spark.createDataFrame(data, "metric string, ts timestamp, value double")
    for carry in (None, 90):
        got = {(r.metric, int((r.ts - t0).total_seconds())): (r.value, r.age)
               for r in metrics.metric_grid(df, t0, t0 + timedelta(seconds=1800), 15, carry).collect()}
        want = {}
        for m in "abc":
            for s in range(0, 1801, 15):
                seen = [(t, v) for k, t, v in data if k == m and t and v is not None and t0 <= t <= t0 + timedelta(seconds=s)]
                t, v = max(seen, default=(None, None))
                age = (t0 + timedelta(seconds=s) - t).total_seconds() if t else None
                want[m, s] = (v, age) if t and (carry is None or age <= carry) else (None, None)
        assert got == want


# ---- ad hoc SQL ------------------------------------------------------------------------

@pytest.fixture(scope="module")
def views(spark):
    presets.register_views(spark, load_hospital(spark, SF_SMALL).as_dict())


REFUSED = [
    "DROP VIEW patients", "INSERT INTO patients SELECT * FROM patients", "CREATE TABLE t AS SELECT 1", "SET a=1", "SHOW TABLES",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.dir')", "SELECT id FROM patients WHERE java_method('a','b') = 'x'",
    "SELECT * FROM (SELECT try_reflect('a', 'b') x)", "SELECT * FROM parquet.`/root/testdata/sf0.001/orders.parquet`",
    "SELECT * FROM nowhere", "SELECT (SELECT max(id) FROM csv.`/etc/passwd`) x", "SELECT 1 WHERE EXISTS (SELECT 1 FROM text.`/etc/hosts`)",
    "SELECT id FROM patients WHERE id IN (SELECT value FROM text.`/etc/hosts`)", "WITH a AS (SELECT * FROM text.`/etc/hosts`) SELECT * FROM a",
    "FROM patients INSERT OVERWRITE DIRECTORY '/tmp/x' SELECT id", "selec 1", "ADD JAR '/tmp/x.jar'", "SELECT * FROM b, (WITH b AS (SELECT 1) SELECT * FROM b)",
    "DELETE FROM patients", "EXPLAIN SELECT 1", "CACHE TABLE patients",
]
ALLOWED = [
    "SELECT count(*) c FROM patients", "WITH a AS (SELECT id FROM patients), b AS (SELECT * FROM a) SELECT * FROM b",
    "VALUES (1), (2)", "SELECT p.id FROM patients p JOIN transactions t ON p.id = t.patient_id WHERE t.amount > (SELECT avg(amount) FROM transactions)",
    "SELECT 'reflect(drop)' x, row_number() OVER (PARTITION BY city ORDER BY id) n FROM patients ORDER BY n DESC LIMIT 5",
    "SELECT city, count(*) n FROM patients GROUP BY city HAVING count(*) > 1 UNION ALL SELECT 'x', 1",
    "SELECT id FROM patients WHERE id IN (SELECT patient_id FROM transactions) EXCEPT SELECT id FROM patients WHERE age < 5",
    "SELECT x FROM patients LATERAL VIEW explode(array(1, 2)) t AS x", "SELECT DISTINCT state FROM patients TABLESAMPLE (50 PERCENT)",
]


def test_adhoc_refuses(spark, views):
    for sql in REFUSED:
        with pytest.raises(presets.NotASelect):
            presets.adhoc_sql(spark, sql)


def test_adhoc_allows(spark, views):
    for sql in ALLOWED:
        res = presets.adhoc_sql(spark, sql)
        assert res.status == "SUCCEEDED" and (res.row_count() == spark.sql(sql).count() or "TABLESAMPLE" in sql), sql


def test_adhoc_runs_once_in_order_with_count_status_and_time(spark, views):
    runs = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        runs.add(1)
        return x

    spark.range(0, 5000, 1, 6).select(seen("id").alias("id")).createOrReplaceTempView("counted")
    res = presets.adhoc_sql(spark, "SELECT id FROM counted", max_rows=30)
    assert [r.id for r in res.rows.collect()] == list(range(30)) and res.row_count() == 5000
    assert res.status == "SUCCEEDED" and res.error is None and res.duration_ms > 0 and res.rows.count() == 30
    assert runs.value == 5000
    res = presets.adhoc_sql(spark, "SELECT id FROM patients ORDER BY id DESC", max_rows=7)
    assert [r.id for r in res.rows.collect()] == [r.id for r in spark.sql("SELECT id FROM patients ORDER BY id DESC LIMIT 7").collect()]
    bad = presets.adhoc_sql(spark, "SELECT raise_error('broken') x FROM patients")
    assert bad.status == "FAILED" and "broken" in bad.error and bad.duration_ms >= 0
    with pytest.raises(RuntimeError):
        bad.rows


# ---- numbers for several writers -------------------------------------------------------

def test_two_writers_and_a_replay_share_no_number(spark, tmp_dir):
    pts = frame(spark, "patients", [pt_row("PT000007"), pt_row("PT000003")])
    out, errors = {}, []

    def write(name, n):
        try:
            batch = frame(spark, "patients", [pt_row(f"{name}{i}", name=f"{name}{i:03d}") for i in range(n)])
            df = upsert.append_with_keys(spark, pts, batch, "PT", order_by="name", numbers=f"{tmp_dir}/numbers", batch_id=name)
            out.setdefault(name, []).append([(r.name, r.id) for r in df.collect()])
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(f"w{k}", 20 + k)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    write("w1", 21)  # written again: the same block
    assert not errors
    assert sorted(out["w1"][0]) == sorted(out["w1"][1])
    ids = [int(i[2:]) for k in out for _, i in out[k][0]]
    assert sorted(ids) == list(range(8, 8 + 20 + 21 + 22 + 23))
    write("w1", 22)
    assert isinstance(errors[0], ValueError)  # another batch under the same name


def test_reservation_races(spark, tmp_dir):
    got = []
    lock = threading.Lock()

    def take(k):
        for i in range(5):
            start = key_blocks.reserve(spark, tmp_dir, f"{k}-{i}", 10, lambda: 100)
            with lock:
                got.append(start)

    threads = [threading.Thread(target=take, args=(k,)) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got) == list(range(101, 101 + 300, 10))


def test_merge_by_month_reads_its_source_once(spark, tmp_dir):
    from wardlake.operators import partitioned
    path, seen = os.path.join(tmp_dir, "table"), spark.sparkContext.accumulator(0)
    partitioned.write_by_month(frame(spark, "transactions", [tx_row(f"T{i}") for i in range(6)]), path)
    src = frame(spark, "transactions", [tx_row(f"T{i}") for i in range(4, 9)])

    def counted(parts):
        for b in parts:
            seen.add(b.num_rows)
            yield b

    partitioned.merge_by_month(spark, path, src.mapInArrow(counted, src.schema))
    assert seen.value == 5
    assert partitioned.read_by_month(spark, path).count() == 9
    assert not [f for f in os.listdir(path) if f.startswith("_source")]
