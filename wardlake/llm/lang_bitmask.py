"""Language ID with bit-sliced n-gram Bloom filters.

Each of ``SLOTS`` slots holds one bit per language, so ``HASHES`` lookups and an
AND return all languages whose filter contains an n-gram at once.  A text's
n-grams are looked up, the bits are counted per language, each language's count
is corrected by its filter's false-positive rate, and the largest corrected share
decides.

Training counts character n-grams (1 to 4 letters or word boundaries) per
language; an n-gram enters a language's filter when it is seen at least
``MIN_COUNT`` times there and its rate is at least ``RATIO`` of the highest rate
in any language, so a stray foreign document does not fill a filter.  The fit
uses a bounded sample of labelled rows: about ``train_docs`` of them, chosen by a
hash of the id; every text is predicted.

Defined results: null texts and texts without a letter are ``und`` with score 0;
without labelled rows all are ``und``; a text none of whose n-grams is known gets
the language with most training rows and score 0; ties go to the smaller name;
repeated rows are predicted alike; only the text is read in a prediction.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_bucket, documents, mix64, pieces

SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
HASHES = 3
ORDERS = (1, 2, 3, 4)
MIN_COUNT = 2
RATIO = 0.5
#: Code points handled at once; the n-grams across a cut are those of the overlap.
PIECE = 1 << 18
#: N-grams that a task holds before it sums them up.
COUNTED_AT_ONCE = 1_000_000
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower case, words separated and enclosed by single spaces; '' without a letter."""
    if not text:
        return ""
    s = _NOT_LETTERS.sub(" ", text.lower()).strip(" ")
    if not s or not any(map(str.isalpha, s)):
        return ""
    return f" {s} "


def ngrams(s: str):
    """Arrays of 64-bit n-gram hashes of a normalised text, all orders."""
    codes = np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.uint64)
    top = max(ORDERS)
    for at in range(0, max(1, len(codes) - top + 1), PIECE):
        c = codes[at:at + PIECE + top - 1]
        final = at + PIECE + top - 1 >= len(codes)
        h = c + np.uint64(1)
        for n in range(1, top + 1):
            if n > 1:
                if len(c) < n:
                    break
                h = h[:len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1:] + np.uint64(1)
            if n in ORDERS:
                grams = h if final else h[:PIECE]
                if n == 1:
                    grams = grams[c[:len(grams)] != 32]
                yield mix64(grams + np.uint64(n << 56))


def slots_of(grams: np.ndarray):
    """The HASHES slots of each n-gram."""
    for k in range(HASHES):
        yield ((grams >> np.uint64(k * 21)) & np.uint64(SLOTS - 1)).astype(np.int64)


class Filters:
    """masks: uint64 (SLOTS, words), bit l % 64 of word l // 64 for language l."""

    def __init__(self, langs: list[str], masks: np.ndarray, default: int):
        self.langs, self.masks, self.default = langs, masks, default
        fill = np.array([np.mean((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(langs))])
        self.false_rate = np.minimum(fill ** HASHES, 0.999)

    def predict(self, text: str | None) -> tuple[str, float]:
        s = letters(text)
        if not s or not self.langs:
            return "und", 0.0
        hits, total = np.zeros(len(self.langs)), 0
        for grams in ngrams(s):
            total += len(grams)
            found = None
            for slot in slots_of(grams):
                found = self.masks[slot] if found is None else found & self.masks[slot]
            for i in range(len(self.langs)):
                hits[i] += np.count_nonzero(found[:, i // 64] & np.uint64(1 << (i % 64)))
        if not hits.any():
            return self.langs[self.default], 0.0
        share = np.maximum((hits / total - self.false_rate) / (1 - self.false_rate), 0.0)
        if not share.any():
            return self.langs[self.default], 0.0
        best = int(np.argmax(share))
        return self.langs[best], float(share[best] / share.sum())


def labelled(docs: DataFrame, train_docs: int) -> DataFrame:
    """(lang, text) of about ``train_docs`` rows that may be learned from."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() &
                      (F.coalesce(crc_bucket(F.col("doc_id"), 4), F.lit(0)) != 2))
    n = max(rows.select("doc_id", "lang").count(), 1)
    limit = int(min(1.0, train_docs / n) * (1 << 30))
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30)) < limit).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def fit(samples: DataFrame) -> Filters:
    """Filters from (lang, text) rows: counts are summed by Spark; the driver gets
    the slots that are set, at most SLOTS rows."""
    def count(batches):
        parts: dict[str, list[np.ndarray]] = {}
        held = 0

        def counted():
            for lang, arrays in parts.items():
                grams, n = np.unique(np.concatenate(arrays), return_counts=True)
                yield pa.record_batch([pa.repeat(pa.scalar(lang, pa.string()), len(grams)), pa.array(grams.view(np.int64)),
                                       pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
            parts.clear()

        for batch in pieces(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for grams in ngrams(s) if (s := letters(text)) else ():
                    parts.setdefault(lang, []).append(grams)
                    held += len(grams)
                    if held > COUNTED_AT_ONCE:
                        yield from counted()
                        held = 0
        yield from counted()

    counts = samples.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))
    totals = {r["lang"]: (r["docs"], max(r["chars"], 1)) for r in samples.groupBy("lang").agg(
        F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars")).collect()}
    langs = sorted(totals)
    default = max(range(len(langs)), key=lambda i: (totals[langs[i]][0], -i)) if langs else 0
    words = max(1, -(-len(langs) // 64))
    masks = np.zeros((SLOTS, words), np.uint64)
    if langs:
        number = F.create_map(*[x for i, name in enumerate(langs) for x in (F.lit(name), F.lit(i))])
        size = F.create_map(*[x for name in langs for x in (F.lit(name), F.lit(float(totals[name][1])))])
        rated = counts.select("gram", "n", number[F.col("lang")].alias("lang"),
                              (F.col("n") / size[F.col("lang")]).alias("rate"))
        each = rated.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(
            F.struct("lang", "n", "rate")).alias("by"))
        member = F.explode(F.filter("by", lambda x: (x["n"] >= MIN_COUNT) & (x["rate"] >= RATIO * F.col("top")))).alias("m")
        slot = F.explode(F.array(*[F.shiftrightunsigned(F.col("gram"), 21 * k).bitwiseAND(F.lit(SLOTS - 1))
                                   for k in range(HASHES)])).alias("slot")
        bits = each.select("gram", member).select(slot, F.col("m.lang").alias("lang"))
        set_bits = bits.groupBy("slot", F.floor(F.col("lang") / 64).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, lang % 64)")).alias("mask")).toArrow()
        masks[set_bits["slot"].to_numpy(), set_bits["word"].to_numpy().astype(np.int64)] = \
            set_bits["mask"].to_numpy().view(np.uint64)
    return Filters(langs, masks, default)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """The rows of ``docs`` as a struct ``doc``, with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast((filters.langs, filters.masks, filters.default))
    at = docs.columns.index("text")

    def run(batches):
        model = Filters(*shared.value)
        for batch in pieces(batches):
            got = [model.predict(t) for t in batch.column(0).field(at).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([x for x, _ in got], pa.string()),
                                   pa.array([x for _, x in got], pa.float64())], names=["doc", "lang_pred", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def identified(docs: DataFrame, filters: Filters, min_score: float = 0.0) -> DataFrame:
    """The rows of ``docs`` with an identified language (texts without a letter or
    without a known n-gram go); a missing lang is filled."""
    found = predict(docs, filters).where((F.col("lang_pred") != "und") & (F.col("score") > min_score))
    return found.select([F.coalesce(F.col("doc.lang"), F.col("lang_pred")).alias(c) if c == "lang"
                         else F.col(f"doc.`{c}`") for c in docs.columns])


def op6_language_id(spark: SparkSession, sf_dir: str, train_docs: int = 20_000) -> DataFrame:
    docs = documents(spark, sf_dir)
    filters = fit(labelled(docs, train_docs))
    found = predict(docs.select("doc_id", F.col("text").cast("string").alias("text")), filters)
    doc_id = F.col("doc.doc_id")
    return found.select(doc_id, F.coalesce(crc_bucket(doc_id, 4) == 2, F.lit(False)).alias("held_out"),
                        "lang_pred", "score")
