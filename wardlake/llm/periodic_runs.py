"""Periodic run detection by internal pattern matching.

A run is a stretch of words with smallest period q that is as long as it can be and
at least ``max(6, 4 q)`` words long.  Blocks of 4, 8, 16, ... words that start at
every half of their length are taken as patterns; the range successor in a wavelet
tree over the suffix array gives the next occurrence of a block in the window that
follows it.  Occurrences of a pattern in a window of twice its length are an
arithmetic progression, and the first difference is the candidate period.

Why that is complete: let m be the power of two with m/2 < q <= m (m = 4 for
q <= 4).  Of any m/2 successive starts one is a block's, and a run has 4 q - m - q + 1
>= m/2 starts whose block and its copy q words later both lie in the run.  That
block has at least q words, so inside the run it recurs only at multiples of q: its
next occurrence is at q.  A candidate is then extended to both sides, word by word.

Only suffixes that can take part are ordered: each word of a run occurs four times
in the text, and a block must recur.  The order (prefix doubling) is cut where the
next block of a suffix does not recur.  The range of a block in the order is
written down when the doubling reaches its length.

A text is one row and is looked at in one task; texts are put together up to
``CHUNK`` words, so that the arrays are neither tiny nor larger than the longest
text asks for.  Nothing is shuffled.

Defined results: null and empty texts have no words, no runs and an empty rest;
repeated rows are treated alike; a null doc_id is an id like others, but its text
is not changed by ``with_period``; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_bytes, utf8

MIN_LENGTH = 6
MIN_EXPONENT = 4
#: Words that are ordered together.
CHUNK = 400_000
FIRST = 4  # words of the shortest block
RUN = "struct<start:bigint,length:bigint,period:bigint>"


class WaveletTree:
    """Level-wise wavelet tree over a permutation of 0 .. n - 1; all queries are
    arrays."""

    def __init__(self, values: np.ndarray):
        self.zeros: list[np.ndarray] = []  # zeros before each place, per level from the highest bit
        self.bits = max(1, int(len(values)).bit_length())
        for b in range(self.bits - 1, -1, -1):
            bit = (values >> b) & 1 == 1
            self.zeros.append(np.concatenate(([0], np.cumsum(~bit))))
            values = np.concatenate((values[~bit], values[bit]))

    def smaller(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values in the places [lo, hi) are below x."""
        count = np.zeros(len(lo), np.int64)
        for level, zeros in enumerate(self.zeros):
            one = (x >> (self.bits - 1 - level)) & 1 == 1
            zlo, zhi = zeros[lo], zeros[hi]
            count += np.where(one, zhi - zlo, 0)
            lo, hi = np.where(one, lo - zlo + zeros[-1], zlo), np.where(one, hi - zhi + zeros[-1], zhi)
        return count

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) in the places [lo, hi)."""
        value = np.zeros(len(lo), np.int64)
        for zeros in self.zeros:
            zlo, zhi = zeros[lo], zeros[hi]
            one = k >= zhi - zlo
            value = 2 * value + one
            k = np.where(one, k - (zhi - zlo), k)
            lo, hi = np.where(one, lo - zlo + zeros[-1], zlo), np.where(one, hi - zhi + zeros[-1], zhi)
        return value

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The smallest value above x in the places [lo, hi); -1 if there is none."""
        below = self.smaller(lo, hi, x + 1)
        out = np.full(len(lo), -1, np.int64)
        some = np.flatnonzero(below < hi - lo)
        out[some] = self.kth(lo[some], hi[some], below[some])
        return out


def groups(rank: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the pairs (equal pairs by place), and of each place in that order
    the first place and the size of its group of equal pairs."""
    order = np.lexsort((second, rank))
    r, s = rank[order], second[order]
    new = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (s[1:] != s[:-1])))) if len(r) else np.zeros(0, np.int64)
    size = np.diff(np.append(new, len(r)))
    return order, np.repeat(new, size), np.repeat(size, size)


def candidates(codes: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, block length and distance to the block's next occurrence, for the
    blocks that recur within their own length.  ``codes``: the words as numbers,
    different in different texts, -1 behind each text; ``often``: whether the word
    can lie in a run."""
    n = len(codes)
    # order the pairs, then the blocks of FIRST words, of which all words occur often
    place = np.flatnonzero(often & (codes >= 0))
    rank = np.full(n + FIRST, -1, np.int64)
    rank[place] = codes[place]
    h = 1
    while h < FIRST:
        place = place[rank[place + h] >= 0]
        order, first, size = groups(rank[place], rank[place + h])
        rank = np.full(n + FIRST, -1, np.int64)
        place, first = place[order][size > 1], first[size > 1]
        rank[place] = first
        place = np.sort(place)
        h *= 2
    # the suffix array of what is left, as numbers of ``place``
    count = len(place)
    if not count:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, first, size = groups(rank[place], place * 0)
    at = np.full(n + 1, -1, np.int64)
    at[place] = np.arange(count)
    suffixes, start, live = order, np.empty(count, np.int64), np.ones(count, bool)
    start[order] = first
    asked: list[tuple[np.ndarray, ...]] = []
    while live.any():
        # ``start``: first place of the block's range in the order; live: it recurs
        sizes = np.empty(count, np.int64)
        sizes[suffixes] = size
        use = np.flatnonzero(live & (place % (h // 2) == 0))
        asked.append((use, start[use], start[use] + sizes[use], np.full(len(use), h)))
        after = np.minimum(place + h, n)
        later = at[after]
        follows = live & (later >= 0)
        second = np.where(follows, np.where(live[later], start[later], -1), -1)
        order, first, size = groups(start, second)
        suffixes, start = order, np.empty(count, np.int64)
        start[order] = first
        big = np.empty(count, bool)
        big[order] = size > 1
        live = big & (second >= 0)
        h *= 2
    use, lo, hi, m = (np.concatenate(x) for x in zip(*asked))
    following = WaveletTree(suffixes).successor(lo, hi, use)
    found = following >= 0
    start, m, d = place[use[found]], m[found], place[following[found]] - place[use[found]]
    near = (d <= m) & ((m == FIRST) | (2 * d > m))
    return start[near], m[near], d[near]


def _equal_words(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two sequences have in common from their start."""
    n, at, step = min(len(a), len(b)), 0, 16
    while at < n:
        differ = a[at:at + step][:n - at] != b[at:at + step][:n - at]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, step = at + len(differ), step * 4
    return n


def runs(codes: np.ndarray, often: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs, sorted; texts lie between ``bounds``."""
    start, m, d = candidates(codes, often)
    order = np.lexsort((start, d))
    best: dict[tuple[int, int], int] = {}
    known_d, known_end = -1, -1
    for s, k, p in zip(start[order].tolist(), m[order].tolist(), d[order].tolist()):
        if p == known_d and s + k + p <= known_end:
            continue  # lies in the stretch before
        i = int(np.searchsorted(bounds, s, "right"))
        left, right = int(bounds[i - 1]), int(bounds[i])
        end = s + k + p
        end += _equal_words(codes[end:right], codes[end - p:right - p])
        begin = s - _equal_words(codes[left:s][::-1], codes[left + p:s + p][::-1])
        known_d, known_end = p, end
        if end - begin >= max(MIN_LENGTH, MIN_EXPONENT * p):
            best[begin, end] = min(p, best.get((begin, end), p))
    return sorted((a, b, p) for (a, b), p in best.items())


def with_period(words: list[bytes], h: int) -> list[bytes]:
    """The words with a periodic tail where the id's hash ``h`` asks for one."""
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * ((n - a) // len(unit) + 1))[:n - a]


def chunk_runs(texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """Per text: its runs as (start, length, period) and the rest, the words that no
    run repeats, joined by spaces."""
    parts, often, offset = [], [], 0
    for words in texts:
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        parts += [codes + offset, np.array([-1])]
        often += [np.bincount(codes, minlength=len(number))[codes] >= MIN_EXPONENT, np.zeros(1, bool)]
        offset += len(number)
    # a text's border: the place behind its closing mark
    bounds = np.concatenate(([0], np.cumsum([len(w) + 1 for w in texts])))
    found = runs(np.concatenate(parts), np.concatenate(often), bounds)
    own: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (a, b, p), i in zip(found, (np.searchsorted(bounds, [r[0] for r in found], "right") - 1).tolist()):
        own[i].append((a - int(bounds[i]), b - a, p))
    out = []
    for words, mine in zip(texts, own):
        if mine:
            cut = np.zeros(len(words) + 1, np.int64)
            np.add.at(cut, [a + p for a, _, p in mine], 1)
            np.add.at(cut, [a + n for a, n, _ in mine], -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(cut[:-1]) == 0).tolist()]
        out.append((mine, b" ".join(words)))
    return out


def detect(docs: DataFrame, planted: bool = False) -> DataFrame:
    """doc_id, n_words, runs (by start, then period; words from 0) and collapsed, the
    text without the repetitions.  ``planted`` rewrites texts by ``with_period``."""
    def flush(rows):
        done = chunk_runs([w for _, w in rows])
        spans = [[{"start": a, "length": n, "period": p} for a, n, p in r] for r, _ in done]
        return pa.record_batch(
            [pa.array([i for i, _ in rows], pa.int64()), pa.array([len(w) for _, w in rows], pa.int64()),
             pa.array(spans, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
             pa.array([t.decode() for _, t in done], pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for i, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch)):
                words = text.split()
                if planted and h is not None:
                    words = with_period(words, h)
                if rows and size + len(words) > CHUNK:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append((i, words))
                size += len(words)
        if rows:
            yield flush(rows)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"),
                       utf8(F.col("text")).alias("text")).mapInArrow(
        run, f"doc_id bigint, n_words bigint, runs array<{RUN}>, collapsed string")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(documents(spark, sf_dir), planted=True)
    # the runs are sorted, so the first of equal exponents is the one asked for
    best = F.aggregate("runs", F.lit(None).cast(RUN), lambda acc, x: F.when(
        acc.isNull() | (x["length"] * acc["period"] > acc["length"] * x["period"]), x).otherwise(acc))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.expr("1000 * best.length div best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
