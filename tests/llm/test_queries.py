"""Every registered query against a brute-force version, on the awkward documents."""

import collections
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.conftest import SF_MID, SF_SMALL
from tests.llm import data
from tests.oracle_compare import compare, duck
from wardlake.llm import (chosen_path, common, decontam, hmm_lm, lang_bitmask, license_rules, line_frequency, mixing, pfp_dedup,
                          pii_feistel, queries, secrets_markov)

SPACE = "[^\x20\x09-\x0d]+"
PLAIN = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def ascii_lower(s):
    return re.sub("[A-Z]", lambda m: m.group().lower(), s or "")


def rows_of(df, cols):
    return sorted(([r[c] for c in cols] for r in df.collect()), key=str)


def same(df, cols, expected):
    got, want = rows_of(df, cols), sorted((list(x) for x in expected), key=str)
    assert got == want, [(a, b) for a, b in zip(got, want) if a != b][:3]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_table(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op11_filter_audit"}))  # op11: rows per part
def test_one_row_per_document(spark, small, table, name):
    got = queries.QUERIES[name](spark, small).select("doc_id").collect()
    assert Counter(r[0] for r in got) == Counter(r[0] for r in table)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_sql(spark, name, sf):
    compare(queries.QUERIES[name](spark, sf), duck(sf), queries.ORACLE_SQL[name])


# ---- 1 secrets ---------------------------------------------------------------------

def base_secrets(t):
    t = t or ""
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(
        r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t)
        if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 32]
    return sorted(out)


def test_op1(spark, small, table):
    df = queries.QUERIES["op1_secret_scan"](spark, small)
    want = []
    for i, t, *_ in table:
        b = base_secrets(t)
        n = Counter(x[3] for x in b)
        want.append((i, n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in b))))
    same(df, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"], want)
    texts = {i: t for i, t, *_ in table}
    for r in df.where("n_markov > 0 and doc_id is not null").collect():
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(","))]
        base = [(s, e) for s, _, e, _ in base_secrets(texts[r["doc_id"]])]
        assert [x[1] for x in spans] == sorted(x[1] for x in spans)
        for k, s, e in spans:
            assert k != "markov" or not any(a < e and s < b for a, b in base)
    found = [x for r in df.where("n_markov > 0").collect() for x in [texts[r["doc_id"]][int(s):int(e)] for k, s, e in (
        y.split(":") for y in r["spans"].split(",")) if k == "markov"]]
    assert "Zx9Qw7Lk2Vb8Nm4Rt6Yp1Hs3" in found
    assert not any("thndandreonhaeredin" in x for x in found)


# ---- 2 repeated substrings -----------------------------------------------------------

def removed(rows, n):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, out = set(), {}
    for k in order:
        b = (rows[k][1] or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if b[s:s + n] in seen:
                gone[s:s + n] = b"\x01" * n
            seen.add(b[s:s + n])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[k] = (rows[k][0], len(b), sum(gone), spans, sha(kept))
    return list(out.values())


def test_op2(spark, small, table):
    same(queries.QUERIES["op2_remove_repeats"](spark, small),
         ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], removed(table, 100))


def test_op2_pieces_and_flushes(spark, small, table, monkeypatch):
    # the same phrases when a long text is cut and tasks send early
    long = np.frombuffer((data.BASE * 3 + data.prose(3000)).encode(), np.uint8)
    whole = [np.concatenate(x) for x in zip(*pfp_dedup.phrases_of(long))]
    monkeypatch.setattr(pfp_dedup, "PIECE", 1000)
    cut = [np.concatenate(x) for x in zip(*pfp_dedup.phrases_of(long))]
    assert whole[1].sum() == cut[1].sum() == len(long) - 99
    starts = lambda p: np.concatenate([np.arange(a, a + n) for a, n in zip(p[0], p[1])])
    assert (starts(whole) == starts(cut)).all()
    assert (np.repeat(whole[0] + whole[2], whole[1]) == np.repeat(cut[0] + cut[2], cut[1])).all()


def test_op2_other_length(spark, small, table):
    df = pfp_dedup.dedup(spark.read.parquet(f"{small}/documents.parquet"), min_length=40)
    got = sorted([r["doc_id"], r["n_bytes"], sum(x["end"] - x["start"] for x in r["spans"]), len(r["spans"]),
                  sha(bytes(r["kept"]))] for r in df.where("doc_id is not null").collect())
    want = sorted(list(x) for x in removed(table, 40) if x[0] is not None)
    assert got == want


# ---- 3 hidden Markov scores ------------------------------------------------------------

def test_op3_base(spark, small, table):
    toks = lambda t: ascii_lower(t).encode().split() + [b""]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t, *_ in table if not held(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    got = queries.QUERIES["op3_hmm_score"](spark, small).collect()
    assert {r["train_tokens"] for r in got} == {n}
    key = lambda x: (str(x[0]), x[2], round(x[4], 6))
    want = sorted(((i, held(i), len(toks(t)), sum(c[w] > 0 for w in toks(t)),
                    sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks(t))) for i, t, *_ in table), key=key)
    have = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"]) for r in got), key=key)
    for a, b in zip(have, want):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], abs=1e-6)
    assert all(r["score"] < 0 for r in got)


def _paths(text, start, trans, emit):
    """Likelihood by the sum over all state sequences."""
    import itertools
    total = 0.0
    for path in itertools.product(range(len(start)), repeat=len(text)):
        p = start[path[0]] * emit[path[0], text[0]]
        for t in range(1, len(text)):
            p *= trans[path[t - 1], path[t]] * emit[path[t], text[t]]
        total += p
    return total


def test_forward_and_expected_counts_are_exact():
    rng = np.random.default_rng(2)
    k, m = 3, 4
    start, trans, emit = (rng.dirichlet(np.ones(x), size) for x, size in ((k, None), (k, k), (m, k)))
    texts = [np.array(x) for x in ([0, 1, 2, 3, 1], [2, 2, 0], [1, 3, 0], [3])]
    got = hmm_lm.forward(texts, start, trans, emit)[0]
    for g, t in zip(got, texts):
        assert 10 ** g == pytest.approx(_paths(t, start, trans, emit))
    starts, moves, emitted, loglik = hmm_lm.expected_counts(texts, start, trans, emit)
    assert starts.sum() == pytest.approx(len(texts)) and moves.sum() == pytest.approx(sum(len(t) - 1 for t in texts))
    assert emitted.sum(0) == pytest.approx(np.bincount(np.concatenate(texts), minlength=m))
    # an EM step does not lower the likelihood
    new = (starts / starts.sum(), moves / moves.sum(1, keepdims=True), emitted / emitted.sum(1, keepdims=True))
    assert hmm_lm.forward(texts, *new)[0].sum() >= loglik


def test_warm_up_counts_every_neighbour_of_every_text(spark):
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 6, n).astype(np.uint16) for n in [1, 2, *rng.integers(1, 40, 3000)]]
    df = spark.createDataFrame([(bytearray(x.tobytes()),) for x in texts], "seq binary").repartition(3)
    want = Counter((int(a), int(b)) for x in texts for a, b in zip(x[:-1], x[1:]))
    found = hmm_lm.pairs(df, 6)
    assert {(r.a, r.b): r.n for r in found.collect()} == want
    # a warm-up pass covers all of them, and raises their likelihood
    k = hmm_lm.STATES
    start, trans, emit = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(6), k)
    (starts, moves, emitted), before = hmm_lm.baum_welch_pass(found, (start, trans, emit), 6, hmm_lm._pair_counts)
    total = sum(want.values())
    assert starts.sum() == pytest.approx(total) and moves.sum() == pytest.approx(total) and emitted.sum() == pytest.approx(2 * total)
    new = (starts / starts.sum(), moves / moves.sum(1, keepdims=True), emitted / emitted.sum(1, keepdims=True))
    assert hmm_lm.baum_welch_pass(found, new, 6, hmm_lm._pair_counts)[1] >= before


def test_op3_beats_unigrams_on_held_out_text(spark):
    r = queries.QUERIES["op3_hmm_score"](spark, SF_MID).where("held_out").selectExpr(
        "sum(score) as s", "sum(base_score) as b").first()
    assert r["s"] > r["b"] + 0.02 * abs(r["b"])


def test_symbol_probabilities_sum_to_one(spark, small):
    from wardlake.llm.common import documents, utf8
    docs = documents(spark, small)
    texts = docs.select(utf8(docs["text"]).alias("text"))
    counts = hmm_lm.word_counts(texts)
    parts = hmm_lm.vocabulary(counts)
    vocab = hmm_lm.Vocabulary(*parts)
    n = {bytes(r["word"]): r["n"] for r in counts.collect()}
    mass = Counter()
    for w in n:
        s = vocab.symbol[vocab.number[w]] if w in vocab.number else vocab.own_words + hmm_lm.class_of(w)
        mass[int(s)] += 10 ** vocab.within[vocab.number[w]] if w in vocab.number else \
            (n[w] + 0.5) / 10 ** vocab.class_size[hmm_lm.class_of(w)]
    for s, p in mass.items():
        unseen = 0.5 / 10 ** vocab.class_size[s - vocab.own_words] if s >= vocab.own_words else 0
        assert p + unseen == pytest.approx(1)


# ---- 4 pseudonyms ------------------------------------------------------------------------

def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def test_op4_values(spark, small, table):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    new = pii_feistel.replaced(docs, "k")
    assert new.columns == docs.columns
    old = {t for _, t, *_ in table if t}
    mail = next(t for t in old if t.startswith("mail bosbt"))
    card = next(t for t in old if t.startswith("card "))
    iban = next(t for t in old if t.startswith("iban "))
    by = {r["doc_id"]: r["text"] for r in new.where("doc_id is not null").collect()}
    ids = {t: i for i, t, *_ in table}
    m = re.fullmatch(r"mail ([a-z]{5})\.(\d\d)@mail8\.example\.com call \+1 \((\d{3})\) (\d{3})-(\d{4}) or "
                     r"(\d{3})-(\d{3})-(\d{4}) ip (\S+) (\d{16}) 42\.", by[ids[mail]])
    assert m and m.group(3, 4, 5) == m.group(6, 7, 8) != ("988", "555", "2485")
    assert m.group(1, 2) != ("bosbt", "42") and all(int(x) < 256 for x in m.group(9).split("."))
    assert luhn(m.group(10)) and m.group(10) != "4041894974608795"
    c = re.fullmatch(r"card (\S+) bad 4041894974608796 ip 300\.1\.2\.3 ssn (\d{3}-\d\d-\d{4}) born (\S+) or (\S+), not 1981-02-29",
                     by[ids[card]])
    assert c.group(1).replace("-", "") == m.group(10)  # the same card, punctuated
    y, mo, d = c.group(3).split("-")
    assert c.group(4) == f"{mo}/{d}/{y}" and c.group(3) != "1980-02-29"
    b = re.fullmatch(r"iban GB(\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d) (DE\d{20}) bad DE89370400440532013001", by[ids[iban]])
    for s in ("GB" + b.group(1).replace(" ", ""), b.group(2)):
        assert int("".join(str(int(x, 36)) for x in s[4:] + s[:4])) % 97 == 1
    back = pii_feistel.restore(new, "k")
    assert rows_of(back, ["doc_id", "text", "n_chars"]) == rows_of(docs.selectExpr(
        "doc_id", "text", "n_chars"), ["doc_id", "text", "n_chars"]) or \
        rows_of(back, ["doc_id", "text"]) == rows_of(docs, ["doc_id", "text"])


def test_op4_is_a_permutation(spark):
    from pyspark.sql import functions as F
    df = spark.range(256 * 10).select("id", F.array((F.col("id") / 10).cast("bigint"), F.col("id") % 10).alias("v"))
    mod = F.array(F.lit(256).cast("bigint"), F.lit(10).cast("bigint"))
    out = df.select("id", pii_feistel.feistel(F.col("v"), mod, "k").alias("p")).select(
        "id", "p", pii_feistel.feistel(F.col("p"), mod, "k", reverse=True).alias("v"))
    rows = out.collect()
    assert len({tuple(r["p"]) for r in rows}) == 2560
    assert all(r["v"] == [r["id"] // 10, r["id"] % 10] for r in rows)


def test_op4_dates_and_ssn_stay_valid(spark):
    from pyspark.sql import functions as F
    df = spark.range(3000).select(
        F.concat(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), (F.col("id") * 24).cast("int")), "yyyy-MM-dd"),
                 F.lit(" "), F.lpad((F.col("id") % 665 + 1).cast("string"), 3, "0"), F.lit("-45-"),
                 F.lpad((F.col("id") + 1).cast("string"), 4, "0")).alias("text"))
    docs = df.withColumn("doc_id", F.lit(1))
    out = pii_feistel.pseudonymise(docs, "q").select("text", F.col("doc.text").alias("old"), "found").collect()
    import datetime
    for r in out:
        day, ssn = r["text"].split(" ")
        assert 1900 <= datetime.date.fromisoformat(day).year <= 2099
        a, b, c = map(int, ssn.split("-"))
        assert 0 < a < 900 and a != 666 and 0 < b < 100 and c > 0
    assert len({r["text"].split(" ")[0] for r in out}) == 3000 and len({r["text"].split(" ")[1] for r in out}) == 3000


# ---- 5 n-gram Jaccard join ------------------------------------------------------------------

def near_groups(rows):
    sets = {}
    for k, (_, t, *_) in enumerate(rows):
        w = re.findall(PLAIN, ascii_lower(t))
        sets[k] = frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset([t]) if t else None
    distinct = [s for s in dict.fromkeys(sets.values()) if s]
    links = {s: [o for o in distinct if o is not s and 10 * len(s & o) >= 8 * len(s | o)] for s in distinct}
    group = {}
    for s in distinct:
        todo, seen = [s], {s}
        while todo:
            for o in links[todo.pop()]:
                if o not in seen:
                    seen.add(o)
                    todo.append(o)
        group[s] = frozenset(seen)
    order = lambda k: (rows[k][0] is None, rows[k][0] or 0, k)
    out = []
    for k, s in sets.items():
        if s is None:
            out.append((rows[k][0], rows[k][0], 0, 0, True))
            continue
        top = min((j for j, o in sets.items() if o in group[s]), key=order)
        out.append((rows[k][0], rows[top][0], len(links[s]), sum(o == s for o in sets.values()) - 1, k == top))
    return out


def test_op5(spark, small, table):
    want = near_groups(table)
    same(queries.QUERIES["op5_ngram_jaccard"](spark, small), ["doc_id", "class_id", "n_links", "n_copies", "kept"], want)
    assert sum(w[2] > 0 for w in want) >= 4


def test_op5_large_buckets_split_and_blocks(spark):
    rng = data.random.Random(4)
    base = data.words(150, rng=rng)
    rows = []
    for i in range(60):
        w = list(base)
        for j in rng.sample(range(150), i % 5):
            w[j] = f"edit{i}x{j}"
        rows.append((i, " ".join(w), "en", "s", 0) + tuple([1] * 9))
    rows += [(100 + i, data.prose(80, rng=rng), "en", "s", 0) + tuple([1] * 9) for i in range(30)]
    df = spark.createDataFrame(rows, data.SCHEMA).repartition(4).cache()
    found = chosen_path.join(df, bucket=8, depth=2).selectExpr("doc_id", "`group`", "n_links", "n_copies", "first")
    same(found, ["doc_id", "group", "n_links", "n_copies", "first"], near_groups([r[:2] for r in rows]))


def test_op5_recall_of_runs():
    roots = chosen_path.runs_for(0.999, 0.8)
    assert (1 - 0.8) ** len(set(np.concatenate([chosen_path.sampled(r) for r in roots]).tolist())) <= 0.001


def test_op5_recall_counts_deeper_splits_and_the_cut():
    # every bucket split again: the roots alone find the pair, the splits part it
    n = len(set(np.concatenate([chosen_path.sampled(r) for r in chosen_path.runs_for(0.99999, 0.8)]).tolist()))
    least, rng = chosen_path.least_equal(0.99999, 0.8), np.random.default_rng(3)
    few = sum(math.comb(96, m) * 0.8 ** m * 0.2 ** (96 - m) for m in range(least))
    assert chosen_path.missed(n, 0.8) + few <= 1e-5
    assert chosen_path.missed(n, 0.8, 0) == pytest.approx(0.2 ** n, rel=1e-3)
    # the formula against simulated trees, with few coordinates so that misses are frequent
    def parted(equal, depth):
        return depth > 0 and all(not equal[c] or parted(equal, depth - 1)
                                 for c in rng.choice(96, chosen_path.SPLIT, replace=False))
    lost = 0
    for _ in range(20_000):
        equal = rng.random(96) < 0.8
        lost += all(not equal[c] or parted(equal, 3) for c in rng.choice(96, 2, replace=False))
    assert lost / 20_000 == pytest.approx(chosen_path.missed(2, 0.8, 3), rel=0.15)


def test_op5_pair_with_few_equal_tokens_is_checked(spark):
    # Jaccard exactly 0.8, 58 to 61 of 96 tokens equal: the former cut at 62 dropped it
    rng, rows = np.random.default_rng(5), []
    while len(rows) < 2:
        w = [f"w{x}" for x in rng.integers(0, 1 << 40, 31)]  # 27 windows, 3 of them changed: 24 / 30
        texts = [" ".join(w), " ".join([*w[:28], *(x + "z" for x in w[28:])])]
        a, b = (chosen_path.shingles(t.encode()) for t in texts)
        assert len(np.intersect1d(a, b)) * 10 == 8 * len(np.union1d(a, b))
        x, y = chosen_path.tokens(a) & 0xFFFF, chosen_path.tokens(b) & 0xFFFF
        if chosen_path.least_equal(0.99999, 0.8) <= (x == y).sum() < 62:
            rows = [(i, t, "en", "s", 0) + tuple([1] * 9) for i, t in enumerate(texts)]
    found = chosen_path.join(spark.createDataFrame(rows, data.SCHEMA)).collect()
    assert [r["n_links"] for r in found] == [1, 1]


# ---- 6 language ID -----------------------------------------------------------------------------

def test_op6(spark, small, table):
    got = queries.QUERIES["op6_language_id"](spark, small).collect()
    learned = {"en", "fr", "de"}
    lang = {i: x for i, _, x, _ in table if i is not None and i >= 1000}
    assert all(r["lang_pred"] == lang[r["doc_id"]] for r in got if r["doc_id"] in lang)
    texts = collections.defaultdict(set)
    for i, t, *_ in table:
        texts[i].add(t)
    for r in got:
        assert 0 <= r["score"] <= 1
        letter = any(c.isalpha() for t in texts[r["doc_id"]] for c in t or "")
        if len(texts[r["doc_id"]]) == 1:
            assert (r["lang_pred"] in learned) if letter else (r["lang_pred"], r["score"]) == ("und", 0.0)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_op6_accuracy_on_held_out_documents(spark):
    got = queries.QUERIES["op6_language_id"](spark, SF_MID).where("held_out")
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "lang")
    r = got.join(docs, "doc_id").selectExpr("avg(int(lang = lang_pred)) as a").first()
    assert r["a"] > 0.97


def test_op6_more_languages_than_bits_and_long_pieces(monkeypatch):
    masks = np.zeros((lang_bitmask.SLOTS, 2), np.uint64)
    text = data.prose(500)
    for grams in lang_bitmask.ngrams(lang_bitmask.letters(text)):
        for slot in lang_bitmask.slots_of(grams):
            masks[slot, 1] |= np.uint64(1 << 5)
    model = lang_bitmask.Filters([f"l{i:02}" for i in range(70)], masks, 0)
    assert model.predict(text) == ("l69", 1.0)
    whole = Counter(np.concatenate(list(lang_bitmask.ngrams(lang_bitmask.letters(text)))).tolist())
    monkeypatch.setattr(lang_bitmask, "PIECE", 64)
    assert Counter(np.concatenate(list(lang_bitmask.ngrams(lang_bitmask.letters(text)))).tolist()) == whole


def test_op6_counts_within_a_long_text_are_given_out_in_parts(monkeypatch):
    """A task's n-grams are summed up within a text, not only after it."""
    text, found = " ".join(data.prose(500) for _ in range(4)), []
    monkeypatch.setattr(lang_bitmask, "COUNTED_AT_ONCE", 4_000)
    monkeypatch.setattr(lang_bitmask, "PIECE", 512)

    class Samples:
        def mapInArrow(self, f, schema):
            found.append(f)
            raise StopIteration

    with pytest.raises(StopIteration):
        lang_bitmask.fit(Samples())
    got = list(found[0]([pa.record_batch([["x", "x"], [text, text]], names=["lang", "text"])]))
    assert max(sum(b.column(2).to_pylist()) for b in got) <= 4_000 + 512
    assert {x for b in got for x in b.column(0).to_pylist()} == {"x"}
    total = Counter()
    for b in got:
        total.update(dict(zip(b.column(1).to_numpy().view(np.uint64).tolist(), b.column(2).to_pylist())))
    grams = np.concatenate(list(lang_bitmask.ngrams(lang_bitmask.letters(text)))).tolist()
    assert total == Counter(grams + grams)


# ---- the pipeline's tasks: whole batches are not held at once ---------------------------------------

def test_pieces_hold_all_rows_in_order():
    doc = pa.StructArray.from_arrays([pa.array(range(1000)), pa.array([None if i % 7 == 0 else "é" * (i % 90) for i in range(1000)])],
                                     names=["doc_id", "text"])
    batch = pa.record_batch([doc], names=["doc"])
    for size in (1, 700, 1 << 30):
        got = list(common.pieces([batch.slice(0, 0), batch, batch.slice(3, 5)], size))
        assert [x for b in got for x in b.column(0).to_pylist()] == doc.to_pylist() + doc.to_pylist()[3:8]
        assert [x for b in got for x in b.column(0).field(1).to_pylist()] == [
            x["text"] for x in doc.to_pylist() + doc.to_pylist()[3:8]]
    assert len(list(common.pieces([batch], 1))) == 1000


TASKS = {
    "language_id": lambda docs, bench: lang_bitmask.predict(docs, lang_bitmask.Filters(
        ["x"], np.ones((lang_bitmask.SLOTS, 1), np.uint64), 0)),
    "near_duplicates": lambda docs, bench: chosen_path.embedded(docs, [1], chosen_path.WIDTH),
    "decontamination": lambda docs, bench: decontam.scan(docs, bench, carry=True),
    "mixing": lambda docs, bench: mixing.count_words(docs)}
INPUTS = {"language_id": [["doc_id", "text"]], "near_duplicates": ["doc_id", "row", "text"],
          "decontamination": ["doc_id", "row", "text", ["doc_id", "text"]], "mixing": ["doc_id", "source", "text"]}


@pytest.mark.parametrize("stage", sorted(TASKS))
def test_a_task_takes_up_a_large_batch_in_pieces(spark, monkeypatch, stage):
    """Its results come in batches of a few MB of texts, so neither Python nor the
    reading side holds those of 10,000 rows."""
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string").selectExpr(
        "doc_id", "doc_id as row", "'s' as source", "text")
    bench = spark.createDataFrame([("i", "one two three")], "item_id string, text string")
    found, kept = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a: (found.append(f), kept(self, f, *a))[1])
    if stage == "language_id":
        docs = docs.select("doc_id", "text")
    TASKS[stage](docs, bench)
    n, word = 1200, data.prose(60)
    texts = [f"{i} {word * 20}" for i in range(n)]
    whole = {"doc_id": pa.array(range(n)), "row": pa.array(range(n)), "source": pa.array(["s"] * n),
             "text": pa.array(texts) if stage == "language_id" else pa.array([t.encode() for t in texts])}
    column = lambda c: whole[c] if isinstance(c, str) else pa.StructArray.from_arrays([whole[x] for x in c], names=c)
    batch = pa.record_batch([column(c) for c in INPUTS[stage]], names=["doc" if isinstance(c, list) else c for c in INPUTS[stage]])
    assert batch.nbytes > 3 * common.PIECE_BYTES
    got = list(found[-1](iter([batch])))
    assert max(b.num_rows for b in got) <= 1 + n * common.PIECE_BYTES // batch.nbytes
    assert [x for b in got for x in b.column(0).to_pylist()] == batch.column(0).to_pylist()


def test_mixing_starts_no_other_kind_of_python_worker(spark, small):
    """The few targets come as an Arrow table, not as a job of pickled Python rows."""
    plan = mixing.mix(corpus_pipeline.documents(spark, small))._jdf.queryExecution().toString()
    assert "LogicalRDD [source_key" not in plan and "LocalRelation [source_key" in plan


# ---- 7 mixing -------------------------------------------------------------------------------------

def reshared(sizes):
    """Targets by repeated resharing of what is above twice a source's size."""
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total = 1.5 * sum(sizes.values())
    t = {s: total * w[s] / sum(w.values()) for s in order}
    full = set()
    for _ in range(100):
        excess = sum(t[s] - 2 * sizes[s] for s in order if t[s] > 2 * sizes[s])
        full |= {s for s in order if t[s] >= 2 * sizes[s]}
        for s in order:
            t[s] = min(t[s], 2 * sizes[s])
        free = [s for s in order if s not in full]
        if excess < 1e-9 or not free:
            break
        for s in free:
            t[s] += excess * w[s] / sum(w[x] for x in free)
    return t


def test_op7(spark, small, table):
    query = queries.QUERIES["op7_mix_sources"]
    got = query(spark, small).collect()
    assert sorted(map(str, got)) == sorted(map(str, query(spark, small).collect()))
    size = lambda t: len((t or "").encode().split())
    sums = Counter()
    for _, t, _, s in table:
        sums[s] += size(t)
    goal = reshared(sums)
    assert Counter(r["size"] for r in got) == Counter(size(t) for _, t, *_ in table)
    full = mixing.mix(spark.read.parquet(f"{small}/documents.parquet")).collect()
    taken = Counter()
    for r in full:
        taken[r["source"]] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["source_size"] == sums[r["source"]]
        assert r["target"] == pytest.approx(goal[r["source"]])
    for s, t in goal.items():
        assert abs(taken[s] - t) <= max(1, 0.02 * t), (s, taken[s], t)


@pytest.mark.parametrize("seed", range(6))
def test_subset_sum(seed):
    rng = data.random.Random(seed)
    sizes = sorted(rng.sample(range(1, 40), 5))
    counts = [rng.randint(1, 3) for _ in sizes]
    budget = rng.randint(1, 90)
    sums = {0}
    for s, c in zip(sizes, counts):
        sums = {x + s * k for x in sums for k in range(c + 1)}
    take = mixing.subset_sum(sizes, counts, budget)
    assert all(t <= c for t, c in zip(take, counts))
    assert sum(t * s for t, s in zip(take, sizes)) == min(sums, key=lambda x: (abs(x - budget), x))


def test_fit_source_at_size():
    rng = data.random.Random(1)
    sizes = sorted(rng.sample(range(1, 20000), 3000))
    counts = [rng.randint(1, 50) for _ in sizes]
    total = sum(s * c for s, c in zip(sizes, counts))
    for share in (0.01, 0.4, 0.999, 1.3, 2.0):
        take = mixing.fit_source(sizes, counts, share * total)
        assert all(0 <= t <= 2 * c for t, c in zip(take, counts))
        assert sum(t * s for t, s in zip(take, sizes)) == pytest.approx(share * total, abs=1)


def test_fit_source_around_a_large_document():
    assert sum(t * s for t, s in zip(mixing.fit_source([1, 300, 400, 6000], [100, 3, 1, 1], 12960), [1, 300, 400, 6000])) == 12960
    assert mixing.fit_source([10], [1], 16) == [2] and mixing.fit_source([10], [1], 14) == [1]
    assert sum(t * s for t, s in zip(mixing.fit_source([1, 90000], [5, 4], 500_000), [1, 90000])) in (450_010, 540_000, 540_010)


# ---- 8 licenses -----------------------------------------------------------------------------------

def test_op8(spark, small, table):
    want = []
    for i, t, *_ in table:
        w = re.findall(PLAIN, ascii_lower(t))
        at = [(p, name) for phrase, name in license_rules.BASE for p in range(len(w))
              if w[p:p + len(phrase.split())] == phrase.split()]
        want.append((i, len(w), len(at), min([p for p, _ in at], default=None), max([p for p, _ in at], default=None),
                     ",".join(sorted({n for _, n in at}))))
    df = queries.QUERIES["op8_license_scan"](spark, small)
    same(df, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"], want)
    by = {next(t for i, t, *_ in table if i == r["doc_id"]): r for r in df.where("doc_id is not null").collect()}
    label = lambda start: next(r["labels"] for t, r in by.items() if t and t.startswith(start))
    assert label("Licensed under CC BY-NC") == "cc-by,cc-by-nc-4.0,reserved"
    assert label("This work is licensed") == "gpl,gpl-3.0,mit"
    assert label("SPDX") == "apache-2.0,gpl"
    for r in by.values():
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def brute_detections(text):
    """All rules on a lower-cased text; contained ones of no better priority go."""
    found = [(m.start(), m.end(), r["prio"], k, r["label"]) for k, r in enumerate(license_rules.rules())
             for m in re.finditer(r["regex"], text, re.A)]
    out = set()
    for d in found:
        inside = [e for e in found if e is not d and e[0] <= d[0] and e[1] >= d[1] and e[2] <= d[2]
                  and (e[:3] != d[:3])]
        if not inside:
            out.add((d[0], d[1], d[2]))
    return out


def test_op8_rules_and_suppression(spark):
    rules = license_rules.rules()
    assert len(rules) > 250
    texts = ["licensed under the apache license, version 2.0 and the mit license", "gnu lgpl, version 2.1 or mit license",
             "license: mpl-2.0\nall rights reserved, copyright (c) 2020", "terms of the mozilla public license, version 2.0",
             "spdx-license-identifier: gpl-3.0-or-later", "bsd 3-clause license; new bsd license; bsd license"]
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", license_rules.detections(F.col("t")).alias("d"))
    for r in df.collect():
        assert {(d["start"], d["stop"], d["prio"]) for d in r["d"]} == brute_detections(r["t"]), r["t"]
    # a rule's keyword stands in every text that its regex matches
    for r in rules:
        for t in texts:
            assert not re.search(r["regex"], t) or r["keyword"] in t


def test_op8_gate_and_keywords_drop_no_rule(spark):
    lines = ["Released under MIT", "distributed under Apache-2.0.", "available under the terms of MPL-2.0",
             "published\nunder EPL-2.0", "MIT No Attribution", "mit no\n  attribution", "placed in the public\ndomain",
             "Permission is\nhereby granted, free of charge", "permission\nto use, copy, modify, and distribute this software",
             "published by the free software\nfoundation", "creative\ncommons attribution 4.0", "CC\nBY 4.0",
             "all\nrights\treserved", "without warranty\nof any kind", "confidential and\nproprietary",
             "redistribution and use in source\nand binary forms", "Copyright\n(c) 2021", "placed into the public\tdomain"]
    texts = [f"Some words. {x}" for x in lines]
    for label, ident, name in license_rules.LICENSES:
        plain = re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", re.sub(r"\(\?:[^()]*\)\?", "", name.split("|")[0])).replace(
            "[sc]", "s").replace("[u*]", "u").replace("[- ]", "-").replace(" ?", " ").replace("\\", "").replace("?", "")
        texts += [f"provided under the\nterms of {label.upper()}, as is", f"Covered under {label}\n",
                  f"here {plain.upper()} 1.0", "x " + plain.replace(" ", "\n")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(4)
    hits = 0
    for r in license_rules.scan(df).collect():
        want = brute_detections(ascii_lower(texts[r["doc_id"]]))
        assert {(d["start"], d["stop"], d["prio"]) for d in r["found"] or ()} == want, texts[r["doc_id"]]
        assert want or r["doc_id"] >= len(lines), texts[r["doc_id"]]
        hits += bool(want)
    assert hits > 200
    for x in license_rules.rules():
        assert " " not in x["keyword"]


# ---- 9 quality ----------------------------------------------------------------------------------------

def quality(rows, max_docs, max_removed):
    out, lines_of, seen = [], [], Counter()
    for _, t, _, s in rows:
        lines = Counter()
        for x in (t or "").split("\n"):
            w = re.findall(SPACE, ascii_lower(x))
            if w:
                lines[" ".join(w)] += len(w)
        lines_of.append(lines)
        seen.update((s, x) for x in lines)
    for (i, t, _, s), lines in zip(rows, lines_of):
        t = t or ""
        w = re.findall(SPACE, t)
        grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        c = Counter(grams)
        hit = {k + j for k, g in enumerate(grams) if c[g] > 1 for j in range(3)}
        own = [x for x in t.split("\n") if re.search(SPACE, x)]
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        gone = sum(n for x, n in lines.items() if seen[(s, x)] > max_docs)
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(own) - len(set(own)), len(hit),
                    failed, not failed and gone <= max_removed * len(w), gone))
    return out


COLS9 = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"]


def test_op9(spark, small, table):
    same(queries.QUERIES["op9_quality_rules"](spark, small), COLS9, quality(table, 50, 0.5))


def test_op9_low_limit(spark, small, table):
    want = quality(table, 1, 0.3)
    same(line_frequency.judge(spark.read.parquet(f"{small}/documents.parquet"), 1, 0.3), COLS9, want)
    assert any(not w[6] and not w[7] for w in want)


def test_op9_many_different_words():
    w = [str(k) for k in range(3000)] + ["1", "2", "3", "1", "2", "3"]
    assert line_frequency.repeated_window_words(w) == 3 + 6


# ---- 10 decontamination ----------------------------------------------------------------------------------

def hits(rows, items):
    windows = collections.defaultdict(set)
    for item, t, *_ in items:
        w = re.findall(PLAIN, ascii_lower(t))
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if w else ():
            windows[tuple(w[k:k + n])].add(item)
    out = []
    for i, t, *_ in rows:
        w = re.findall(PLAIN, ascii_lower(t))
        hit, ids = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[tuple(w[k:k + n])]
        ids = sorted(str(x) for x in ids if x is not None)
        out.append((i, len(w), len(hit), len(ids), sha(",".join(ids)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


COLS10 = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_op10(spark, small, table):
    want = hits(table, data.ITEMS)
    same(queries.QUERIES["op10_decontaminate"](spark, small), COLS10, want)
    assert sum(w[5] for w in want) >= 4


@pytest.mark.parametrize("limits", [{"automaton_words": 20}, {"max_broadcast_bytes": 200}])
def test_op10_parts_agree(spark, small, limits):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    from pyspark.sql import functions as F
    cols = ["row", "doc_id", "n_words", "n", "items"]
    one = decontam.scan(docs, items).withColumn("n", decontam.hit_words(F.col("hits")))
    more = decontam.scan(docs, items, carry=True, **limits).withColumn("n", decontam.hit_words(F.col("hits")))
    assert rows_of(one, cols) == rows_of(more, cols)


def test_op10_offsets(spark, small):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    for r in decontam.scan(docs, items, carry=True).where("doc_id = 24").collect():
        text = r["doc"]["text"].encode()
        assert [text[s["start"]:s["end"]] for s in r["spans"]] == [b"short ITEM, here"]


# ---- pipeline ------------------------------------------------------------------------------------------------

def test_pipeline_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    ops = [m for _, f in corpus_pipeline.STAGES for m in [f.__name__]]
    assert ops == ["language_id", "near_duplicates", "decontaminated", "pseudonymised", "mixed"]
    rows = lambda df: [tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]
    tables = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        if k < 4:
            assert out.columns == columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{k}")
        before = rows(docs)
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        tables.append((before, docs))
    before, after = tables[0][0], rows(tables[0][1])
    letters = lambda t: any(c.isalpha() for c in t or "")
    assert not any(not letters(t) for _, t, *_ in after) and all(x[2] for x in after)
    assert Counter(i for i, *_ in before) - Counter(i for i, *_ in after) == Counter(
        i for i, t, *_ in before if not letters(t))
    before, after = tables[1][0], rows(tables[1][1])
    assert Counter(x[0] for x in after) == Counter(
        b[0] for b, g in zip(before, near_groups(before)) if g[4])
    before, after = tables[2][0], rows(tables[2][1])
    assert Counter(after) == Counter(b for b, h in zip(before, hits(before, data.ITEMS)) if not h[5])
    before, after = tables[3][0], rows(tables[3][1])
    assert Counter(x[0] for x in before) == Counter(x[0] for x in after)
    assert not any("4041894974608795" in t or "bosbt.42@" in t for _, t, *_ in after)
    before = tables[4][0]
    assert Counter(r["doc_id"] for r in tables[4][1].collect()) == Counter(x[0] for x in before)


def test_pipeline_of_an_empty_table(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
