"""Filter interaction audit with count-weighted decision diagrams.

Every document gets a mask: bit k says that it fails filter k.  Per part (the
source) the documents of each mask are counted, with how many of them are marked as
good and as toxic; that table of at most 2^k masks is a function of k variables
and becomes a diagram: one level per filter, a node's two children are the
documents that pass and that fail it, equal nodes are shared, the ends are the
counts, and a node's weight is the sum over both children.  Swapping two adjacent
levels rebuilds only those two.  All orders of the filters follow each other by
one swap (Steinhaus, Johnson and Trotter); in each, the path on which every filter
passes gives the steps: what a step keeps is the weight of the pass child, what it
removes that of the fail child.

The text is read once; what is shuffled is one narrow row per document.  Copies of
a text are found by its SHA-256 and the least doc_id of each digest is a table of
its own, so that the joins can split a text that fills a third of all rows.  The
counts per mask are summed before the shuffle; a diagram sees one part's masks.

Defined results: null text is empty text (both fail nothing but A, and are equal);
the null source and the empty one are the same part; repeated rows count as often
as they occur, and rows that share their doc_id are no copies of each other; a row
without a doc_id fails E never and has no labels; of several label rows of a
document any quality = 1 marks it as good and any toxic = 1 as toxic; an empty
table has no part and no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, documents, text_bytes, utf8

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 2
SYMBOLS = b"#$%&*|"
_UPPER = bytes(range(65, 91))
_FOLLOWING = bytes(range(0x80, 0xC0))  # bytes of a code point after its first


def failures(text: bytes) -> int:
    """The mask of the filters that look at the text alone (A is bit 0)."""
    words = text.split()
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _FOLLOWING))
    return (len(words) < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1 \
        | (100 * upper > MAX_UPPER_PERCENT * points) << 2 | (len(text.translate(None, SYMBOLS)) < len(text)) << 3


def examined(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, and mask without the copies."""
    def run(batches):
        for batch in batches:
            texts = text_bytes(batch)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                                   pa.array([failures(t) for t in texts], pa.int32())], names=["doc_id", "part", "digest", "mask"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       utf8(F.col("text")).alias("text")).mapInArrow(run, "doc_id bigint, part string, digest binary, mask int")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, docs, good, toxic: the documents of each failure mask."""
    rows = checkpointed(examined(docs))
    copied = checkpointed(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
                          .where("n > 1 and first is not null").select("digest", "first"))
    marks = checkpointed(labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
        .where("good = 1 or toxic = 1"))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    failed = rows.join(copied, "digest", "left").select("doc_id", "part", F.col("mask").bitwiseOR(F.shiftleft(copy, 4)).alias("mask"))
    return failed.join(marks, "doc_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("docs"), F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))


class Diagram:
    """A count-weighted decision diagram over the variables ``order``.

    ``levels[k]`` holds a node of variable ``order[k]`` per row: the numbers of its
    pass and its fail child on the next level; ``ends`` the counts of the masks."""

    def __init__(self, order: list[int], counts: dict[int, tuple[int, ...]], width: int):
        self.order = list(order)
        cube = np.zeros((1 << len(order), width), np.int64)
        for mask, values in counts.items():
            # the first variable of the order is the highest bit of the row
            cube[sum(((mask >> v) & 1) << (len(order) - 1 - k) for k, v in enumerate(order))] = values
        self.ends, row = np.unique(cube, axis=0, return_inverse=True)
        row = row.reshape(-1)
        self.levels: list[np.ndarray] = []
        for _ in order:
            nodes, row = np.unique(row.reshape(-1, 2), axis=0, return_inverse=True)
            row = row.reshape(-1)
            self.levels.insert(0, nodes)

    def swap(self, k: int) -> None:
        """Exchange the variables of levels k and k + 1.  A node of level k still
        stands for the same documents, so no other level changes."""
        upper, lower = self.levels[k], self.levels[k + 1]
        passed, failed = lower[upper[:, 0]], lower[upper[:, 1]]
        pairs = np.stack([passed[:, 0], failed[:, 0], passed[:, 1], failed[:, 1]], axis=1).reshape(-1, 2)
        self.levels[k + 1], number = np.unique(pairs, axis=0, return_inverse=True)
        self.levels[k] = number.reshape(-1, 2)
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]

    def weights(self) -> list[np.ndarray]:
        """The counts below every node, level by level, the ends last."""
        out = [self.ends]
        for nodes in reversed(self.levels):
            out.insert(0, out[0][nodes[:, 0]] + out[0][nodes[:, 1]])
        return out

    def steps(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Along the path on which every filter passes: the variable, the counts
        that are kept and the counts that are removed."""
        weights, node = self.weights(), 0
        for k, v in enumerate(self.order):
            passed, failed = self.levels[k][node]
            yield v, weights[k + 1][passed], weights[k + 1][failed]
            node = passed


def adjacent_swaps(n: int) -> Iterator[int]:
    """The n! - 1 adjacent swaps (k with k + 1) that lead through all orders of n."""
    if n < 2:
        return
    inner, down = adjacent_swaps(n - 1), True
    while True:
        yield from (range(n - 2, -1, -1) if down else range(n - 1))  # the last walks through
        k = next(inner, None)
        if k is None:
            return
        yield k + 1 if down else k  # it stands first after walking down
        down = not down


def audited(counts: dict[int, tuple[int, int, int]], n: int = len(FILTERS)) -> list[tuple]:
    """order, step, variable, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley of every step of every order."""
    diagram = Diagram(list(range(n)), counts, 3)
    fails, alone, shapley, rows = [0] * n, [0] * n, [0] * n, []
    swaps = adjacent_swaps(n)
    while True:
        steps = list(diagram.steps())
        order = tuple(diagram.order)
        fails[order[0]], alone[order[-1]] = int(steps[0][2][0]), int(steps[-1][2][0])
        for k, (v, kept, removed) in enumerate(steps):
            shapley[v] += int(removed[0])
            rows.append((order, k + 1, v, int(kept[0]), int(removed[0]), int(removed[1]), int(removed[2])))
        k = next(swaps, None)
        if k is None:
            break
        diagram.swap(k)
    return [(order, step, v, kept, removed, fails[v] - removed, alone[v], good, toxic, shapley[v])
            for order, step, v, kept, removed, good, toxic in rows]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    by_part = masks(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("counts"))
    counted = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def run(batches):
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = audited({c["mask"]: (c["docs"], c["good"], c["toxic"]) for c in counts})
                yield pa.record_batch(
                    [pa.array([part] * len(rows), pa.string()),
                     pa.array(["".join(FILTERS[v] for v in r[0]) for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())]
                    + [pa.array([r[3 + i] for r in rows], pa.int64()) for i in range(len(counted))],
                    names=["part", "filter_order", "step", *counted])

    return by_part.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in counted))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
 (len(w) < {MIN_WORDS})::INT, (100 * len(list_distinct(w)) < {MIN_DISTINCT_PERCENT} * len(w))::INT,
 (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MAX_UPPER_PERCENT} * length(t))::INT,
 regexp_matches(t, '[#$%&*|]')::INT, coalesce(doc_id > first, false)::INT] AS f FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, f),
v AS (SELECT unnest([1, 2, 3, 4, 5]) AS v),
o AS (SELECT [a.v, b.v, c.v, d.v, e.v] AS o FROM v a, v b, v c, v d, v e WHERE len(list_distinct([a.v, b.v, c.v, d.v, e.v])) = 5),
s AS (SELECT o, s.v AS step, o[s.v] AS own, o[1:s.v - 1] AS before FROM o, v s),
r AS (SELECT part, o, step, own,
 sum(CASE WHEN list_sum(list_transform(before, lambda x: f[x])) > 0 THEN 0 ELSE n * (1 - f[own]) END) AS kept,
 sum(CASE WHEN list_sum(list_transform(before, lambda x: f[x])) > 0 THEN 0 ELSE n * f[own] END) AS removed,
 sum(CASE WHEN list_sum(list_transform(before, lambda x: f[x])) > 0 THEN n * f[own] ELSE 0 END) AS redundant,
 sum(CASE WHEN list_sum(f) = 1 THEN n * f[own] ELSE 0 END) AS unique_fails,
 sum(CASE WHEN list_sum(list_transform(before, lambda x: f[x])) > 0 THEN 0 ELSE good * f[own] END) AS good_lost,
 sum(CASE WHEN list_sum(list_transform(before, lambda x: f[x])) > 0 THEN 0 ELSE toxic * f[own] END) AS toxic_lost
 FROM c, s GROUP BY part, o, step, own)
SELECT part, array_to_string(list_transform(o, lambda x: substr('{FILTERS}', x, 1)), '') AS filter_order, step::INT AS step,
 kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
 good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
 (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""
