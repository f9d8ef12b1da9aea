"""Streaming = batch: availableNow runs over split landing files, in several
micro-batches, with a late older row and a late new id; a restart from the
checkpoint adds nothing."""

import os
import time

import pytest

from tests.helpers import frame, tx_row
from wardlake.operators import quality, upsert
from wardlake.sources import tables
from wardlake.streaming import batches
from wardlake.streaming import incremental as inc


def _write(df, path):
    df.coalesce(1).write.mode("overwrite").parquet(path)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_bronze_append_exactly_once(spark, tmp_dir):
    landing, bronze, ck = (os.path.join(tmp_dir, x) for x in ("landing", "bronze", "ck"))
    _write(frame(spark, "transactions", [tx_row("T1"), tx_row("T2")]), f"{landing}/f1")
    q = inc.stream_bronze_append(spark, f"{landing}/*", "transactions", bronze, ck)
    q.awaitTermination()
    _write(frame(spark, "transactions", [tx_row("T3")]), f"{landing}/f2")
    inc.stream_bronze_append(spark, f"{landing}/*", "transactions", bronze, ck).awaitTermination()
    assert tables.read_bronze_table(spark, bronze, "transactions").count() == 3
    inc.stream_bronze_append(spark, f"{landing}/*", "transactions", bronze, ck).awaitTermination()
    assert tables.read_bronze_table(spark, bronze, "transactions").count() == 3  # restart adds nothing


def _stream(spark, landing, bronze, ck, ids, name):
    _write(frame(spark, "transactions", [tx_row(i) for i in ids]), f"{landing}/{name}")
    inc.stream_bronze_append(spark, f"{landing}/*", "transactions", bronze, ck).awaitTermination()


def _load(spark, tmp_dir, bronze, ids, name):
    tables.export_csv(frame(spark, "transactions", [tx_row(i) for i in ids]), "transactions", f"{tmp_dir}/{name}")
    tables.load_bronze_csv(spark, f"{tmp_dir}/{name}", "transactions", bronze)


def test_stream_and_batch_writers_share_bronze(spark, tmp_dir):
    for first in ("stream", "load"):
        landing, bronze, ck = (os.path.join(tmp_dir, first, x) for x in ("landing", "bronze", "ck"))
        s, b = [f"S{i}" for i in range(5)], [f"B{i}" for i in range(7)]
        if first == "stream":
            _stream(spark, landing, bronze, ck, s, "f1")
            _load(spark, tmp_dir, bronze, b, f"{first}-csv")
        else:
            _load(spark, tmp_dir, bronze, b, f"{first}-csv")
            _stream(spark, landing, bronze, ck, s, "f1")
        assert {r.id for r in tables.read_bronze(spark, bronze)["transactions"].collect()} == set(s + b)


def test_refresh_between_stream_runs(spark, tmp_dir):
    landing, bronze, ck = (os.path.join(tmp_dir, x) for x in ("landing", "bronze", "ck"))
    _stream(spark, landing, bronze, ck, ["S1", "S2"], "f1")
    time.sleep(1.1)  # file times have the resolution of the file system
    full = frame(spark, "transactions", [tx_row(f"F{i}") for i in range(4)])
    assert tables.bronze_full_refresh(spark, {"transactions": full}, bronze).first().success
    assert {r.id for r in tables.read_bronze(spark, bronze)["transactions"].collect()} == {"F0", "F1", "F2", "F3"}
    _stream(spark, landing, bronze, ck, ["S3"], "f2")
    assert {r.id for r in tables.read_bronze(spark, bronze)["transactions"].collect()} == {"F0", "F1", "F2", "F3", "S3"}


def test_silver_upsert_stream_equals_batch(spark, tmp_dir):
    landing, silver, ck = (os.path.join(tmp_dir, x) for x in ("landing", "silver", "ck"))
    b1 = frame(spark, "transactions", [
        tx_row("T1", date="2024-01-05 00:00:00", amount=10), tx_row("T2", date="2024-01-05 00:00:00", amount=20),
        tx_row("T0", date="2024-01-05 00:00:00", amount=0)])                      # fails the Silver rule
    b2 = frame(spark, "transactions", [
        tx_row("T1", date="2024-01-07 00:00:00", amount=11, pay="Cash"),          # newer -> update
        tx_row("T2", date="2024-01-01 00:00:00", amount=99, pay="Cash")])         # late older -> ignored
    b3 = frame(spark, "transactions", [
        tx_row("T9", date="2019-01-01 00:00:00", amount=5),                       # late unseen id -> insert
        tx_row("T1", date="2024-01-06 00:00:00", amount=12)])                     # older than kept -> ignored
    for i, b in enumerate([b1, b2, b3]):
        _write(b, f"{landing}/f{i}")
    src = inc.bronze_stream(spark, f"{landing}/*", "transactions", max_files_per_trigger=1)
    q = inc.stream_silver_upsert(spark, src, silver, ck)
    q.awaitTermination()
    assert len(q.recentProgress) >= 3
    got = inc.read_silver(spark, silver)
    expect = frame(spark, "transactions", [])
    for b in (b1, b2, b3):
        clean = quality.dedupe_latest(quality.silver_transactions(b, lineage=False), "id", "date")
        expect = upsert.merge_upsert(expect, clean)
    assert _rows(got) == _rows(expect)
    rows = {r.id: r for r in got.collect()}
    assert set(rows) == {"T1", "T2", "T9"} and float(rows["T1"].amount) == 11 and float(rows["T2"].amount) == 20
    inc.stream_silver_upsert(spark, inc.bronze_stream(spark, f"{landing}/*", "transactions"), silver, ck) \
        .awaitTermination()
    assert _rows(inc.read_silver(spark, silver)) == _rows(expect)
    # compaction keeps the rows and leaves one folder; later batches still apply
    inc.compact_silver(spark, silver)
    assert len(batches.committed(spark, silver)) == 1 and _rows(inc.read_silver(spark, silver)) == _rows(expect)
    inc.silver_upsert_batch(spark, frame(spark, "transactions", [
        tx_row("T1", date="2024-01-06 12:00:00", amount=13), tx_row("T2", date="2024-01-09 00:00:00", amount=21)]), 0, silver)
    rows = {r.id: float(r.amount) for r in inc.read_silver(spark, silver).collect()}
    assert rows == {"T1": 11.0, "T2": 21.0, "T9": 5.0}


def test_replayed_batch_changes_nothing(spark, tmp_dir):
    silver = os.path.join(tmp_dir, "silver")
    b = frame(spark, "transactions", [tx_row("T1", amount=10), tx_row("T2", amount=5)])
    inc.silver_upsert_batch(spark, b, 0, silver)
    before = _rows(inc.read_silver(spark, silver))
    inc.silver_upsert_batch(spark, b, 0, silver)
    assert _rows(inc.read_silver(spark, silver)) == before


def test_new_checkpoint_adds_to_committed_rows(spark, tmp_dir):
    landing, silver = (os.path.join(tmp_dir, x) for x in ("landing", "silver"))
    for run in range(2):  # batch numbers start at 0 again, under another query id
        _write(frame(spark, "transactions", [tx_row(f"R{run}T{i}") for i in range(10)]), f"{landing}/f{run}")
        src = inc.bronze_stream(spark, f"{landing}/f{run}", "transactions")
        inc.stream_silver_upsert(spark, src, silver, f"{tmp_dir}/ck{run}").awaitTermination()
    assert inc.read_silver(spark, silver).count() == 20


def test_uncommitted_batch_is_not_read_and_broken_storage_raises(spark, tmp_dir):
    silver = os.path.join(tmp_dir, "silver")
    inc.silver_upsert_batch(spark, frame(spark, "transactions", [tx_row(f"T{i}") for i in range(200)]), 0, silver)
    inc.silver_upsert_batch(spark, frame(spark, "transactions", [tx_row("T900")]), 1, silver)
    os.remove(f"{silver}/query=batch/batch=1/{batches.MARK}")  # as if it were still being written
    assert inc.read_silver(spark, silver).count() == 200
    part = next(f for f in os.listdir(f"{silver}/query=batch/batch=0") if f.endswith(".parquet"))
    with open(f"{silver}/query=batch/batch=0/{part}", "w") as f:
        f.write("damaged")
    with pytest.raises(Exception):
        inc.read_silver(spark, silver).count()
    assert inc.read_silver(spark, os.path.join(tmp_dir, "none")).count() == 0


def test_equal_dates_keep_the_earlier_arrival(spark, tmp_dir):
    silver = os.path.join(tmp_dir, "silver")
    for i, (amount, dept) in enumerate([(1, "A"), (2, "B"), (3, "C")]):
        inc.silver_upsert_batch(spark, frame(spark, "transactions", [tx_row("T1", amount=amount, dept=dept)]), i, silver)
    r = inc.read_silver(spark, silver).first()
    assert (float(r.amount), r.department) == (1.0, "A")


def test_pipeline_counts_stream(spark, tmp_dir):
    landing = os.path.join(tmp_dir, "landing")
    _write(frame(spark, "transactions", [tx_row("T1"), tx_row("T2")]), f"{landing}/tx/f1")
    _write(frame(spark, "transactions", [tx_row("T3")]), f"{landing}/ap/f1")

    def run():
        streams = {"transactions": inc.bronze_stream(spark, f"{landing}/tx/*", "transactions"),
                   "other": inc.bronze_stream(spark, f"{landing}/ap/*", "transactions")}
        inc.stream_pipeline_counts(streams, f"{tmp_dir}/out", f"{tmp_dir}/ck").awaitTermination()
        return {r.table: r.rows for r in inc.read_complete(spark, f"{tmp_dir}/out", inc.COUNTS_SCHEMA).collect()}

    assert inc.read_complete(spark, f"{tmp_dir}/out", inc.COUNTS_SCHEMA).count() == 0
    assert run() == {"transactions": 2, "other": 1}
    for n in range(2, 5):
        _write(frame(spark, "transactions", [tx_row(f"N{n}")]), f"{landing}/tx/f{n}")
        assert run() == {"transactions": n + 1, "other": 1}
    assert len(batches.committed(spark, f"{tmp_dir}/out")) == 2


def test_growth_history_stream(spark, tmp_dir):
    from tests.helpers import ap_row, pt_row
    from wardlake.streaming.growth import read_growth_history, stream_growth_history
    landing, hist, ck = (os.path.join(tmp_dir, x) for x in ("landing", "hist", "ck"))
    _write(frame(spark, "patients", [pt_row("P1"), pt_row("P2")]), f"{landing}/pt/f1")
    _write(frame(spark, "appointments", [ap_row("A1")]), f"{landing}/ap/f1")
    _write(frame(spark, "transactions", [tx_row("T1"), tx_row("T2"), tx_row("T3")]), f"{landing}/tx/f1")
    streams = {"patients": inc.bronze_stream(spark, f"{landing}/pt/*", "patients"),
               "appointments": inc.bronze_stream(spark, f"{landing}/ap/*", "appointments"),
               "transactions": inc.bronze_stream(spark, f"{landing}/tx/*", "transactions")}
    stream_growth_history(spark, streams, hist, ck, month="2024-05").awaitTermination()
    _write(frame(spark, "patients", [pt_row("P3")]), f"{landing}/pt/f2")
    streams["patients"] = inc.bronze_stream(spark, f"{landing}/pt/*", "patients")
    stream_growth_history(spark, streams, hist, ck, month="2024-06").awaitTermination()
    rows = [tuple(r) for r in read_growth_history(spark, hist).collect()]
    assert rows == [("2024-05", 2, 1, 3), ("2024-06", 3, 1, 3)]


def test_insert_ignore_batches(spark, tmp_dir):
    silver = os.path.join(tmp_dir, "silver")
    inc.silver_upsert_batch(spark, frame(spark, "transactions", [tx_row("T1", amount=10)]), 0, silver, op="insert_ignore")
    b = frame(spark, "transactions", [tx_row("T1", amount=99, date="2030-01-01 00:00:00"),
                                      tx_row("T2", amount=5, date="2024-01-02 00:00:00"),
                                      tx_row("T2", amount=6, date="2024-01-01 00:00:00")])
    inc.silver_upsert_batch(spark, b, 1, silver, op="insert_ignore")
    got = {r.id: float(r.amount) for r in inc.read_silver(spark, silver, op="insert_ignore").collect()}
    assert got == {"T1": 10.0, "T2": 6.0}


def test_csv_landing_stream_to_bronze(spark, tmp_dir):
    landing, bronze, ck = (os.path.join(tmp_dir, x) for x in ("landing", "bronze", "ck"))
    rows = [tx_row("T1", ap=None, dept='Card, "Main"'), tx_row("T2", ap="AP1", dept="Line\nBreak", amount=12.5)]
    tables.export_csv(frame(spark, "transactions", rows), "transactions", f"{landing}/e1")
    inc.stream_bronze_append(spark, f"{landing}/*", "transactions", bronze, ck, fmt="csv",
                             api_names=True, multi_line=True).awaitTermination()
    got = {r.id: r for r in tables.read_bronze_table(spark, bronze, "transactions").collect()}
    assert got["T1"].appointment_id is None and got["T1"].department == 'Card, "Main"'
    assert got["T2"].department == "Line\nBreak" and float(got["T2"].amount) == 12.5
