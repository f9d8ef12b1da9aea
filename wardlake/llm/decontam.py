"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items and documents are normalised to words (A-Z lower-cased, ASCII
punctuation and white space separate).  Every window of 13 consecutive item
words -- an item of fewer words is one window -- is a pattern over word numbers
of a single automaton; each text is scanned once, and the hit words are mapped
back to byte offsets of the original text.

The automaton holds about 13 nodes per benchmark word, so the memory of a task bounds
it: patterns are built in groups of at most ``automaton_words`` item words.  One group
is built once per task; of several, one is in memory at a time, and a task scans
``CHUNK_BYTES`` of text with each before it goes on to the next, so that building
them does not count.  The broadcast benchmark is checked against
``max_broadcast_bytes``: beyond it the benchmark is dealt into parts by a hash of the
item, each part is fetched, sent out and scanned in its own pass (the driver holds one
part at a time), and the parts' hits are merged per document.

Defined results: a null or empty text, or one without words, has no hit; a null
or empty item has no window; windows of an item without an id count as hits but
name no item; repeated items count once per id; repeated documents get their own
rows; without items nothing is contaminated; other columns are not read.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NORMALISE, documents, pieces, text_bytes, utf8

WINDOW = 13
#: Text that a task scans with each of several automata before it builds them again.
CHUNK_BYTES = 256 << 20
_WORD_AT = re.compile(rb"[^ ]+")

HITS = ("doc_id bigint, row bigint, n_words bigint, hits array<struct<first:bigint,last:bigint>>, "
        "spans array<struct<start:bigint,end:bigint>>, items array<string>")


def normalised(data: bytes) -> list[bytes]:
    return data.translate(NORMALISE).split()


class Patterns:
    """The benchmark's windows as word-number automata."""

    def __init__(self, items: list[tuple[str | None, bytes]], automaton_words: int):
        self.number: dict[bytes, int] = {}
        self.groups: list[list[tuple[str | None, list[int]]]] = [[]]
        size = 0
        for item, data in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in normalised(data)]
            if not words:
                continue
            if size and size + len(words) > automaton_words:
                self.groups.append([])
                size = 0
            self.groups[-1].append((item, words))
            size += len(words)

    def automata(self):
        """One automaton after the other; a value is (length, item ids)."""
        for group in self.groups:
            windows: dict[tuple[int, ...], set] = {}
            for item, words in group:
                n = min(WINDOW, len(words))
                for i in range(len(words) - n + 1):
                    windows.setdefault(tuple(words[i:i + n]), set()).add(item)
            if windows:
                a = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
                for key, ids in windows.items():
                    a.add_word(key, (len(key), ids))
                a.make_automaton()
                yield a


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _numbered(texts: list[bytes], number: dict[bytes, int]) -> list[np.ndarray]:
    """The words of each text as numbers (0: none of the benchmark's)."""
    get = number.get
    return [np.array([get(w, 0) for w in normalised(t)], np.int32) for t in texts]


def _scan_rows(rows: list[np.ndarray], automata) -> list[tuple[int, list, set]]:
    """Per text: number of words, merged hit ranges of word positions, item ids."""
    found: list[tuple[list, set]] = [([], set()) for _ in rows]
    for a in automata:
        for (ranges, ids), row in zip(found, rows):
            for end, (n, items) in a.iter(tuple(row.tolist())):
                ranges.append((end - n + 1, end))
                ids |= items
    return [(len(row), _merged(ranges), ids) for row, (ranges, ids) in zip(rows, found)]


def _chunks(batches, limit: int):
    """Lists of successive batches of about ``limit`` bytes (0: each on its own)."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def scan(docs: DataFrame, benchmark: DataFrame, automaton_words: int = 200_000,
         max_broadcast_bytes: int = 32 << 20, carry: bool = False) -> DataFrame:
    """doc_id, row (number of the input row), n_words, hits (ranges of word
    positions, merged), spans (the same as byte offsets of the text), items; with
    ``carry`` also doc, a struct of all columns of the input row."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), utf8(F.col("text")).alias("data")) \
        .where("data IS NOT NULL")
    size = items.agg(F.sum(F.length("data") + 16)).first()[0] or 0
    parts = max(1, -(-size // max_broadcast_bytes))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                        F.monotonically_increasing_id().alias("row"), utf8(F.col("text")).alias("text"),
                        *[F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] * carry)
    schema = T.StructType([*T.StructType.fromDDL(HITS).fields, *texts.schema.fields[3:]])
    scans = []
    for part in range(parts):
        mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("item", "data"), F.lit(parts)) == part)
        shared = spark.sparkContext.broadcast([(r["item"], bytes(r["data"])) for r in mine.collect()])

        def find(batches, shared=shared):
            patterns = Patterns(shared.value, automaton_words)
            kept = list(patterns.automata()) if len(patterns.groups) == 1 else None

            def scanned(chunk):
                rows = [_numbered(text_bytes(b), patterns.number) for b in chunk]
                got = iter(_scan_rows([r for b in rows for r in b], kept if kept is not None else patterns.automata()))
                for b in chunk:
                    yield b, [next(got) for _ in range(b.num_rows)]

            for batch, got in (x for chunk in _chunks(pieces(batches), 0 if kept is not None else CHUNK_BYTES) for x in scanned(chunk)):
                spans = []
                for t, (_, ranges, _ids) in zip(text_bytes(batch), got):
                    at = [m.span() for m in _WORD_AT.finditer(t.translate(NORMALISE))] if ranges else []
                    spans.append([{"start": at[a][0], "end": at[b][1]} for a, b in ranges])
                yield pa.record_batch([
                    batch.column(0), batch.column(1), pa.array([n for n, _, _ in got], pa.int64()),
                    pa.array([[{"first": a, "last": b} for a, b in r] for _, r, _ in got],
                             pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([sorted(i for i in ids if i is not None) for _, _, ids in got], pa.list_(pa.string())),
                    *batch.columns[3:],
                ], names=["doc_id", "row", "n_words", "hits", "spans", "items", *batch.schema.names[3:]])

        scans.append(texts.mapInArrow(find, schema))
    if parts == 1:
        return scans[0]
    every = scans[0]
    for s in scans[1:]:
        every = every.unionByName(s)
    together = lambda c: F.sort_array(F.flatten(F.collect_set(c)))  # noqa: E731  one entry per part
    return every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
                                    together("hits").alias("hits"), together("spans").alias("spans"),
                                    F.array_distinct(together("items")).alias("items"),
                                    *[F.first("doc").alias("doc")] * carry).select(schema.names)


def hit_words(hits):
    """Number of words in the union of the ranges (sorted by start)."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("upto"))
    return F.aggregate(hits, zero, lambda acc, h: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("bigint"), h["last"] - F.greatest(h["first"] - 1, acc["upto"]))).alias("n"),
        F.greatest(acc["upto"], h["last"]).alias("upto")), lambda acc: acc["n"])


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated."""
    found = scan(docs, benchmark, carry=True)
    bad = contaminated(hit_words(F.col("hits")), F.col("n_words"))
    return found.where(~bad).select([F.col(f"doc.`{c}`") for c in docs.columns])


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))
    n_hit = hit_words(F.col("hits"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        contaminated(n_hit, F.col("n_words")).alias("contaminated"))


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
         "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce({_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n,
  unnest(list_transform(range(1, len(w) - least({WINDOW}, len(w)) + 2), lambda p: array_to_string(w[p:p + least({WINDOW}, len(w)) - 1], ' '))) AS k
  FROM i WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM iw),
dp AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n),
dk AS (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS k FROM dp),
h AS (SELECT dk.rid, dk.n, dk.p, iw.item_id FROM dk JOIN iw ON dk.n = iw.n AND dk.k = iw.k),
c AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM h) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item_id) AS n_items,
  string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
 CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN it USING (rid)
"""
