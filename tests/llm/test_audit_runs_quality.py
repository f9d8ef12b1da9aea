"""Filter audit, periodic runs and quality scores against plain versions."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.conftest import SF_MID
from tests.llm import data
from wardlake.llm import filter_audit, periodic_runs, queries, rff_quality


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def tokens(t):
    return (t or "").encode().split()


def label_rows(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality", "toxic").collect()]


# ---- 11 filter audit -----------------------------------------------------------------

def audit_by_hand(table, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, *_ in table:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    parts = defaultdict(list)
    for i, t, _, source in table:
        t = t or ""
        w = tokens(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
                 "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t),
                 "E": i is not None and i > first[t]}
        parts[source or ""].append(({f for f in fails if fails[f]}, i in good, i in toxic))
    rows, shapley = [], Counter()
    for part, docs in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                out = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[part, f] += len(out)
                rows.append([part, "".join(order), step, len(left), len(out), sum(f in d[0] for d in docs) - len(out),
                             sum(d[0] == {f} for d in docs), sum(d[1] for d in out), sum(d[2] for d in out)])
    return [tuple(r + [shapley[r[0], r[1][r[2] - 1]]]) for r in rows]


def test_op11(spark, small, table):
    df = queries.QUERIES["op11_filter_audit"](spark, small)
    assert df.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
                          "shapley"]
    got, want = sorted(tuple(r) for r in df.collect()), sorted(audit_by_hand(table, label_rows(spark, small)))
    assert got == want
    assert len(got) == 600 * len({r[3] or "" for r in table})


@pytest.mark.parametrize("n", range(1, 6))
def test_adjacent_swaps_visit_every_order_once(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for k in filter_audit.adjacent_swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        seen.add(tuple(order))
    assert seen == set(itertools.permutations(range(n)))
    assert sum(1 for _ in filter_audit.adjacent_swaps(n)) == len(seen) - 1


def test_diagram_keeps_its_function_and_shares_nodes():
    counts = {m: (bin(m).count("1"), 1, m % 2) for m in range(32)}
    d = filter_audit.Diagram([0, 1, 2, 3, 4], counts, 3)
    rng = random.Random(3)
    for _ in range(40):
        d.swap(rng.randrange(4))
        for mask, values in counts.items():
            node = 0
            for k, v in enumerate(d.order):
                node = d.levels[k][node][(mask >> v) & 1]
            assert tuple(d.ends[node]) == values
        assert d.weights()[0].tolist() == [[80, 32, 16]]
    # symmetric but for the first variable: at most two nodes for each number of fails
    assert all(len(nodes) <= 2 * (k + 1) for k, nodes in enumerate(d.levels))


# ---- 12 periodic runs ----------------------------------------------------------------

def runs_by_hand(w):
    found = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - p:
            s = i
            while i < len(w) - p and w[i] == w[i + p]:
                i += 1
            if i - s + p >= max(6, 4 * p):
                found.setdefault((s, i - s + p), p)
            i += 1
    return sorted((s, n, p) for (s, n), p in found.items())


def digest_by_hand(i, t, planted=True):
    w, n = tokens(t), len(tokens(t))
    h = 1 if i is None else zlib.crc32(str(i).encode())
    if planted and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
    r = runs_by_hand(w)
    dropped = {j for s, m, p in r for j in range(s + p, s + m)}
    best = min(r, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
    return (i, len(r), *best, None if best[0] is None else 1000 * best[1] // best[2],
            sha("".join(f"{a},{b},{c}\n" for a, b, c in r)), sha(b" ".join(x for j, x in enumerate(w) if j not in dropped)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_op12(spark, small, table):
    got = queries.QUERIES["op12_periodic_runs"](spark, small)
    assert got.columns == COLUMNS
    want = [digest_by_hand(i, t) for i, t, *_ in table]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 8


def test_op12_on_documents(spark):
    rows = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text").where("length(text) < 6000").collect()
    want = {r[0]: digest_by_hand(*r) for r in rows}
    got = {r[0]: tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, SF_MID).collect()}
    assert all(got[i] == want[i] for i in want)


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            letters, w = "abcdefgh"[:rng.choice([1, 2, 3, 5])], []
            for _ in range(rng.randint(0, 8)):
                unit = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
                w += (unit * rng.randint(1, 7))[:rng.randint(1, 50)]
            texts.append([x.encode() for x in w])
        assert [r for r, _ in periodic_runs.chunk_runs(texts)] == [runs_by_hand(w) for w in texts]


def test_long_runs_and_chunks(spark, monkeypatch):
    assert periodic_runs.chunk_runs([[b"a"] * 200_000])[0] == ([(0, 200_000, 1)], b"a")
    many = [b"%d" % (i // 6) for i in range(60_000)]
    assert periodic_runs.chunk_runs([many])[0][0] == [(6 * i, 6, 1) for i in range(10_000)]
    long = [b"%d" % (i % 9000) for i in range(40_000)]
    assert periodic_runs.chunk_runs([[], long, []]) == [([], b""), ([(0, 40_000, 9000)], b" ".join(long[:9000])), ([], b"")]


def test_wavelet_tree():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 64, 200):
        v = rng.permutation(n)
        tree = periodic_runs.WaveletTree(v)
        lo = rng.integers(0, n + 1, 300)
        hi = np.maximum(lo, rng.integers(0, n + 1, 300))
        x = rng.integers(0, n, 300)
        want = [min((y for y in v[a:b] if y > c), default=-1) for a, b, c in zip(lo, hi, x)]
        assert tree.successor(lo, hi, x).tolist() == want


def test_detect_returns_runs_and_text(spark):
    df = spark.createDataFrame([(1, "x a b a b a b a b y", 0), (1, None, 0), (None, "q q q q q q", 0)], "doc_id long, text string, runs int")
    got = {(r[0], r[1]): (sorted(map(tuple, r[2])), r[3]) for r in periodic_runs.detect(df).collect()}
    assert got == {(1, 10): ([(1, 8, 2)], "x a b y"), (1, 0): ([], ""), (None, 6): ([(0, 6, 1)], "q")}


# ---- 13 quality ----------------------------------------------------------------------

def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def test_op13_on_held_out_documents(spark):
    got = queries.QUERIES["op13_quality_score"](spark, SF_MID).collect()
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{SF_MID}/labels.parquet").select("doc_id", "quality").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert len(held) > 80 and auc(held) > 0.97
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.95
    # calibrated: the mean score is near the share of label 1
    assert abs(np.mean([s for s, _ in held]) - np.mean([y for _, y in held])) < 0.06


def test_op13_does_not_learn_from_held_out_labels(spark, tmp_path):
    rows = data.documents()
    a = data.write(spark, tmp_path / "a", rows)
    labels = spark.read.parquet(f"{a}/labels.parquet")
    from pyspark.sql import functions as F
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    b = data.write(spark, tmp_path / "b", [(r[0], r[1], "xx", "yy") + r[4:] for r in rows])
    labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))).coalesce(1) \
        .write.mode("overwrite").parquet(f"{b}/labels.parquet")
    x, y = (sorted(((r[0], round(r[2], 9)) for r in queries.QUERIES["op13_quality_score"](spark, f).collect()), key=str) for f in (a, b))
    assert x == y


def test_op13_without_labels(spark, tmp_path):
    folder = data.write(spark, tmp_path / "x", data.documents())
    spark.createDataFrame([], data.LABELS).write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    assert {r.score for r in queries.QUERIES["op13_quality_score"](spark, folder).collect()} == {0.5}


def test_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(0)
    k = len(rff_quality.STATISTICS)
    model = rff_quality.Model(np.zeros(k), np.ones(k), rng.normal(size=(k, 20_000)) / np.sqrt(k), rng.uniform(0, 2 * np.pi, 20_000))
    import pyarrow as pa
    x = rng.normal(size=(12, k))
    z = model.features(pa.record_batch([pa.array(x[:, i]) for i in range(k)], names=list(rff_quality.STATISTICS)))[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * k))
    assert np.abs(z @ z.T - want).max() < 0.05


def test_normal_equations_are_those_of_all_rows(spark):
    rows = rff_quality.described(spark.read.parquet(f"{SF_MID}/documents.parquet")).selectExpr(
        "*", "cast(doc_id % 2 as int) as quality").repartition(9)
    k = len(rff_quality.STATISTICS)
    rng = np.random.default_rng(0)
    model = rff_quality.Model(np.zeros(k), np.ones(k), rng.normal(size=(k, 12)), rng.uniform(0, 6, 12))
    batch = rows.toArrow().combine_chunks()
    z = np.column_stack([model.features(batch), batch.column("quality").to_numpy()])
    assert np.allclose(rff_quality.normal_equations(rows, model), z.T @ z)


def test_rising_is_isotonic_regression():
    rng = np.random.default_rng(1)
    y, n = rng.random(40), rng.integers(1, 9, 40).astype(float)
    x, level = rff_quality.rising(np.arange(40.0), y, n)
    assert (np.diff(level) > 0).all() and (np.diff(x) > 0).all()
    # max-min formula of isotonic regression
    total, weight = np.concatenate(([0], np.cumsum(y * n))), np.concatenate(([0], np.cumsum(n)))
    want = [max(min((total[b + 1] - total[a]) / (weight[b + 1] - weight[a]) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert sorted(set(np.round(want, 12))) == sorted(set(np.round(level, 12)))


# ---- mended: settings, values inside other candidates, long texts ----------------------

def test_licenses_without_ansi(spark, small):
    want = sorted(map(tuple, queries.QUERIES["op8_license_scan"](spark, small).collect()), key=str)
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        got = sorted(map(tuple, queries.QUERIES["op8_license_scan"](spark, small).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert got == want and all(r[2] >= 0 for r in got)


def test_values_covered_by_invalid_candidates(spark):
    texts = ["pay ID42 4111 1111 1111 1111 now", "NR12 4041 8949 7460 8795", "1234 4111 1111 1111 1111 end",
             "bad 4041894974608796 and 0000 1111 2222 3333 4444 5555 4111 1111 1111 1111", "ip 300.1.2.3 then 42.144.35.254",
             "_ ID42 4111 1111 1111 1111"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from wardlake.llm import pii_feistel
    got = {r.doc_id: r.text for r in pii_feistel.replaced(df, "k").collect()}
    assert all("4111 1111 1111 1111" not in got[i] and "8949 7460 8795" not in got[i] and len(got[i]) == len(texts[i]) for i in range(5))
    assert got[0].startswith("pay ID42 ") and got[3].startswith("bad 4041894974608796 and 0000 1111 2222 3333 4444 5555 ")
    assert got[4].startswith("ip 300.1.2.3 then ") and "42.144.35.254" not in got[4]
    assert not any("" in got[i] for i in range(5)) and got[5] == texts[5]
    back = {r.doc_id: r.text for r in pii_feistel.restore(spark.createDataFrame(list(got.items()), "doc_id long, text string"), "k").collect()}
    assert back == dict(enumerate(texts))


def test_long_lists_of_spans(spark):
    import re

    from pyspark.sql import functions as F

    from wardlake.llm.common import matched_spans
    texts = ["", "none", "x1", "a1é2b" * 700 + "z", "12 " * 256, "7" * 257, " 5" * 20_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    keep = lambda m: m != "2"
    rows = df.select("text", matched_spans(F.col("text"), "[0-9]", keep).alias("s")).collect()
    assert {r.text: [tuple(x) for x in r.s] for r in rows} == {
        t: [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]", t) if m.group() != "2"] for t in texts}


# ---- cleaned texts, many automata --------------------------------------------------------

def test_frequent_lines_are_cut_out(spark, small, table):
    from wardlake.llm import line_frequency as lf
    df = spark.read.parquet(f"{small}/documents.parquet")
    rows = lf.cleaned(df, 2, 0.4).collect()
    judged = Counter((r.doc_id, r.removed_words, r.kept) for r in lf.judge(df, 2, 0.4).collect())
    assert Counter((r.doc_id, r.removed_words, r.kept) for r in rows) == judged
    texts = defaultdict(list)
    for i, t, *_ in table:
        texts[i].append(t)
    assert sum(r.removed_words > 0 for r in rows) > 5
    for r in rows:
        def cut(t):
            for x in reversed(r.spans):
                t = t[:x.start] + t[x.end:]
            return t
        if r.text is None:
            assert None in texts[r.doc_id] and not r.spans
        else:  # a last line that goes takes the line break before it along
            assert r.text in [x for t in texts[r.doc_id] if t is not None for x in (cut(t), cut(t)[:-1])]
    assert lf.without_lines("a b\nc\n\nA  b", {lf.line_hash("a b")}) == ("c\n", [(0, 4), (7, 11)], 4)


def test_automata_are_built_once_for_many_batches(spark, small, monkeypatch):
    from wardlake.llm import decontam
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(str, decontam.scan(docs.coalesce(1), items).drop("row").collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(str, decontam.scan(docs.coalesce(1), items, automaton_words=20).drop("row").collect())) == one
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    import pyarrow as pa
    batches = [pa.record_batch([pa.array(range(100))], names=["x"])] * 10
    assert [len(c) for c in decontam._chunks(iter(batches), 0)] == [1] * 10
    assert [len(c) for c in decontam._chunks(iter(batches), 2400)] == [3, 3, 3, 1]
