"""Quality rules with cross-document line frequency.

Lines are normalised (trimmed, white space squeezed, A-Z lower-cased) and hashed;
for every host (here: the source) the distinct documents of a line are counted,
lines in more than ``max_docs`` documents of the host are removed, and a document
that loses more than ``max_removed`` of its words is rejected.  Rules on the text
alone (too few words, too many repeated 3-word windows) reject first.

Texts are read twice: once to count lines (the counts are summed before they are
shuffled), once for a document's own figures, which travel with its lines, each once
per document, through one shuffle by (host, line).  A line that fills a third of all
documents is one skewed join key, which AQE splits (the other side has one row per
line).  ``judge`` tells what the removal leaves over; ``cleaned`` carries it out and
returns the texts, which then take part in the shuffle by document.

Defined results: null and empty texts have no words and fail the base rules; the
null source is a host of its own; repeated rows count as documents of their own;
lines without a word are ignored; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITESPACE, checkpointed, documents, null_safe_key

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Documents of a host that may share a line before it counts as boilerplate.
MAX_DOCS = 50
#: Share of its words that a document may lose.
MAX_REMOVED = 0.5
SYMBOLS = "#*$%&|<>"
_SPACES = WHITESPACE.decode()
_WORD = re.compile(r"[^ \t-\r]+")
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_window_words(words: list[str], width: int = 3) -> int:
    """Words covered by windows of ``width`` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    m = len(number)
    key = np.zeros(n, np.uint64)
    if m ** width < 1 << 64:
        for k in range(width):
            key = key * np.uint64(m) + ids[k:k + n]
    else:  # too many different words for exact keys of 64 bits: number the pairs first
        pair = np.unique(ids[:-1] * np.uint64(m) + ids[1:], return_inverse=True)[1].astype(np.uint64)
        key = pair[:n] * np.uint64(m) + ids[2:2 + n]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(covered[:-1])))


def normalised_line(line: str) -> str:
    """ASCII lower case, words joined by single spaces."""
    return " ".join(_WORD.findall(line.translate(_LOWER) if not line.isascii() else line.lower()))


def line_hash(line: str) -> int:
    h = xxhash.xxh64_intdigest(line.encode())
    return h - (1 << 64) if h >= 1 << 63 else h


_LOWER = {c: c + 32 for c in range(65, 91)}


def figures(text: str) -> tuple[tuple[int, ...], dict[int, int]]:
    """The rules' figures of a text, and words by hash of its normalised lines
    (all occurrences of a line together)."""
    words = _WORD.findall(text)
    seen: set[str] = set()
    lines: dict[int, int] = {}
    dup = 0
    for line in text.split("\n"):
        if not line.strip(_SPACES):
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        norm = normalised_line(line)
        h = line_hash(norm)
        lines[h] = lines.get(h, 0) + norm.count(" ") + 1
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in SYMBOLS), dup,
            repeated_window_words(words)), lines


def hashed_lines(docs: DataFrame) -> DataFrame:
    """host and line (hash): each different line of a document once."""
    def run(batches):
        for batch in batches:
            lines = [{line_hash(normalised_line(x)) for x in (t or "").split("\n") if x.strip(_SPACES)}
                     for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([list(x) for x in lines], pa.list_(pa.int64()))],
                                  names=["host", "line"])

    return docs.select(null_safe_key(F.col("source")).alias("host"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "host string, line array<bigint>").select("host", F.explode("line").alias("line"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, host, the figures, and the arrays line (hash) and words."""
    def run(batches):
        for batch in batches:
            rows = [figures(t or "") for t in batch.column(2).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), batch.column(1)]
                + [pa.array([r[0][i] for r in rows], pa.int64()) for i in range(len(FIGURES))]
                + [pa.array([list(r[1]) for r in rows], pa.list_(pa.int64())),
                   pa.array([list(r[1].values()) for r in rows], pa.list_(pa.int64()))],
                names=["doc_id", "host", *FIGURES, "line", "words"])

    kinds = ", ".join(f"{c} bigint" for c in FIGURES)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), null_safe_key(F.col("source")).alias("host"),
                       F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id bigint, host string, {kinds}, line array<bigint>, words array<bigint>")


def frequent_lines(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """host and line (hash) of the lines in more than ``max_docs`` documents of a host."""
    # a table of its own, so that a join can split the documents of a hot line
    return checkpointed(hashed_lines(docs).groupBy("host", "line").agg(
        F.count("*").alias("docs")).where(F.col("docs") > max_docs).drop("docs"))


def without_lines(text: str, lines: set[int]) -> tuple[str, list[tuple[int, int]], int]:
    """The text without the lines of these hashes, the removed ranges (code points,
    each with its line break), and the number of removed words."""
    kept, spans, at, words = [], [], 0, 0
    for line in text.split("\n"):
        norm = normalised_line(line) if line.strip(_SPACES) else ""
        if norm and line_hash(norm) in lines:
            end = min(at + len(line) + 1, len(text))
            if spans and spans[-1][1] == at:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((at, end))
            words += norm.count(" ") + 1
        else:
            kept.append(line)
        at += len(line) + 1
    return "\n".join(kept), spans, words


def cleaned(docs: DataFrame, max_docs: int = MAX_DOCS, max_removed: float = MAX_REMOVED) -> DataFrame:
    """One row per input row: doc_id, text (without the frequent lines of its host),
    spans (what was removed, as ranges of the old text), removed_words, and kept: what
    ``judge`` says, here from the texts themselves."""
    def lines_of(batches):
        for batch in batches:
            found = [{line_hash(normalised_line(x)) for x in (t or "").split("\n") if x.strip(_SPACES)}
                     for t in batch.column(2).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array([list(x) for x in found], pa.list_(pa.int64()))],
                                  names=["doc_id", "host", "text", "line"])

    base = "doc_id bigint, host string, text string"
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), null_safe_key(F.col("source")).alias("host"),
                       F.col("text").cast("string").alias("text")).mapInArrow(lines_of, f"{base}, line array<bigint>")
    # the row's number decides which rows come together, so it is stored before it is used
    rows = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
    found = rows.select("row", "host", F.explode("line").alias("line")).join(
        frequent_lines(docs, max_docs), ["host", "line"]).groupBy("row").agg(F.collect_set("line").alias("frequent"))

    def cut(batches):
        for batch in batches:
            out = []
            for t, lines in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = figures(t or "")[0]
                left, spans, words = without_lines(t, set(lines or ())) if t is not None else (None, [], 0)
                failed = own[0] < MIN_WORDS or 100 * own[4] > MAX_REPEATED_PERCENT * own[0]
                out.append((left, [{"start": a, "end": b} for a, b in spans], words, not failed and words <= max_removed * own[0]))
            yield pa.record_batch([
                batch.column(0), pa.array([r[0] for r in out], pa.string()),
                pa.array([r[1] for r in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.bool_())],
                names=["doc_id", "text", "spans", "removed_words", "kept"])

    return rows.join(found, "row", "left").select("doc_id", "text", "frequent").mapInArrow(
        cut, "doc_id bigint, text string, spans array<struct<start:bigint,end:bigint>>, removed_words bigint, kept boolean")


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, max_removed: float = MAX_REMOVED) -> DataFrame:
    """One row per input row: doc_id, figures, removed_words, base_failed, kept."""
    rows = measured(docs)
    # a document sends one row with its figures and one for each different line; the
    # first has the hash of its own number for a line, which spreads these rows
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    head = F.struct(F.col("doc_id").alias("doc_id"), *FIGURES)
    own = F.array(F.struct(F.xxhash64("row").alias("line"), F.lit(None).cast("bigint").alias("words"),
                           head.alias("head")))
    body = F.transform(F.arrays_zip("line", "words"), lambda x: F.struct(
        x["line"].alias("line"), x["words"].alias("words"), F.lit(None).cast(_head_type()).alias("head")))
    sent = rows.select("row", "host", F.explode(F.concat(own, body)).alias("x")).select("row", "host", "x.*")
    marked = sent.join(frequent_lines(docs, max_docs).withColumn("frequent", F.lit(True)), ["host", "line"], "left")
    by_doc = marked.groupBy("row").agg(
        F.max("head").alias("head"),
        F.coalesce(F.sum(F.when(F.col("frequent"), F.col("words"))), F.lit(0)).cast("bigint").alias("removed_words"))
    out = by_doc.select("head.*", "removed_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.col("removed_words") <= max_removed * F.col("n_words")))


def _head_type() -> str:
    return "struct<doc_id:bigint," + ",".join(f"{c}:bigint" for c in FIGURES) + ">"


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select("doc_id", *FIGURES, "base_failed", "kept", "removed_words")


_W = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"
_LOW = "translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, {_W.format('t')} AS w FROM d),
pos AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM w),
k AS (SELECT rid, p, w[p:p + 2] AS k FROM pos),
rep AS (SELECT rid, p FROM k QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
nrep AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + 3)) AS q FROM rep) GROUP BY rid),
l AS (SELECT rid, source, unnest(string_split(t, chr(10))) AS l FROM d),
lw AS (SELECT rid, source, l, {_W.format(_LOW)} AS nw FROM l WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM lw GROUP BY rid),
nl AS (SELECT rid, source, array_to_string(nw, ' ') AS nl, sum(len(nw)) AS words FROM lw GROUP BY ALL),
fr AS (SELECT source, nl FROM nl GROUP BY ALL HAVING count(*) > {MAX_DOCS}),
rm AS (SELECT nl.rid, sum(nl.words) AS n FROM nl JOIN fr ON nl.source IS NOT DISTINCT FROM fr.source AND nl.nl = fr.nl GROUP BY nl.rid),
f AS (SELECT d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words,
 CAST(coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(nrep.n, 0) AS BIGINT) AS n_repeat_words,
 CAST(coalesce(rm.n, 0) AS BIGINT) AS removed_words
 FROM d JOIN w USING (rid) LEFT JOIN nrep USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rm USING (rid))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed,
 NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words) AND removed_words <= {MAX_REMOVED} * n_words AS kept
FROM f
"""
