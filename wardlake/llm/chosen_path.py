"""N-gram Jaccard join with the chosen-path method.

Texts are sets of 5-word shingles.  Words are runs of letters, digits and bytes
beyond ASCII, A-Z lower-cased, so punctuation and case do not part copies; a text
of fewer words is one shingle, and so is the whole text where it has no word.
Texts with the same set are one class; the join finds all pairs of classes with a
Jaccard similarity of at least ``threshold``.

* A class is embedded as ``COORDS`` min-hash tokens.  A node of the recursion
  samples coordinates by a hash of its path and splits its bucket by the tokens
  there: a run's root each with probability 1 / (LAMBDA * COORDS), a deeper node
  ``SPLIT`` of them.  A pair at the threshold is lost with a probability of at most
  ``1 - recall``, taken over all places where it can be: runs are added until the
  roots and all deeper splits lose it in at most 9/10 of that, and the cut of the
  sampled tokens is set to lose it in at most 1/10.
* Buckets of one class vanish; those of up to ``BUCKET`` classes are compared by
  brute force; larger ones are split again while that shrinks them.  A large bucket
  that keeps half of its node's classes holds really similar texts: it is compared
  blockwise, each pair of blocks in a task of its own, so no task gets an unbounded
  group.
* A pair belongs to the largest of its common buckets and is checked only there:
  first by the sampled tokens, then exactly on the shingle sets.  Tasks return
  numbers of links and local groups, one row per member, never the pairs.

Output: one row per document with its group (smallest doc_id), the number of
*other* sets linked to its own, and the number of other documents with its set.

Defined results: null and empty texts are alone, without links; null ids come last in a group's order and repeated ids are ordered by their place
in the input; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, setting
from .common import (NORMALISE, checkpointed, documents, grouped, mix64, pieces, prefix_hash, range_hash, signed,
                     text_bytes, utf8, word_ranges)
from .components import components
from .pfp_dedup import packed

WIDTH = 5
THRESHOLD = 0.8
COORDS = 96
LAMBDA = 0.7
BUCKET = 512
DEPTH = 12
#: Coordinates that a node below the root splits on.
SPLIT = 2
RECALL = 0.99999
#: Share of the misses allowed by the recall that the cut of the sampled tokens may take.
CUT_SHARE = 0.1
#: Rows of candidate pairs that a batch brings to a task's Python.
PAIR_ROWS = 1000
_LAST = (1 << 63) - 1
_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 1 << 32, COORDS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, COORDS, dtype=np.uint32)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    data = np.frombuffer(text.translate(NORMALISE), np.uint8)
    start, end = word_ranges(data)
    if not len(start):  # no word: the text itself, if any
        data = np.frombuffer(text, np.uint8)
        return range_hash(prefix_hash(data), np.array([0]), np.array([len(data)])) if text else np.zeros(0, np.uint64)
    words = range_hash(prefix_hash(data), start, end)
    n = max(1, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[k:k + n])
    return np.unique(out)


def tokens(sets: np.ndarray) -> np.ndarray:
    """The COORDS min-hash tokens of a set."""
    best = np.full(COORDS, 0xFFFFFFFF, np.uint32)
    x = (sets >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(best, (x[at:at + 2048, None] * _A + _B).min(0), out=best)
    return best


def _hash(*parts) -> np.ndarray:
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for p in parts:
            h = mix64(np.atleast_1d(np.asarray(p)).astype(np.uint64) + np.uint64(0x632BE59BD9B4E019) + h * np.uint64(31))
    return h


def sampled(path: int) -> np.ndarray:
    """Coordinates that the root with this number splits on."""
    draw = _hash(np.uint64(path), np.arange(COORDS))
    return np.flatnonzero(draw < np.uint64((1 << 64) // (LAMBDA * COORDS)))


def agreeing(threshold: float) -> list[float]:
    """Probability that a pair at the threshold agrees on m of the tokens, by m."""
    return [math.comb(COORDS, m) * threshold ** m * (1 - threshold) ** (COORDS - m) for m in range(COORDS + 1)]


def missed(n: int, threshold: float, depth: int = DEPTH) -> float:
    """Probability that a pair at the threshold shares no final bucket with n root
    coordinates, when every bucket is split again ``depth`` times."""
    total = 0.0
    for m, weight in enumerate(agreeing(threshold)):
        p, lost = m / COORDS, 0.0  # lost: a pair that shares a root bucket is parted below it
        for _ in range(depth):
            lost = (1 - p + p * lost) ** SPLIT
        # the root coordinates are different ones: j of them among the m equal tokens
        total += weight * sum(math.comb(m, j) * math.comb(COORDS - m, n - j) * lost ** j
                              for j in range(n + 1)) / math.comb(COORDS, n)
    return total


def runs_for(recall: float, threshold: float, depth: int = DEPTH) -> list[int]:
    """Roots of as many runs as the target recall needs, deeper splits included."""
    roots, seen = [], set()
    while missed(len(seen), threshold, depth) > (1 - CUT_SHARE) * (1 - recall):
        roots.append(len(roots) + 1)
        seen |= set(sampled(roots[-1]).tolist())
    return roots


def least_equal(recall: float, threshold: float) -> int:
    """Equal tokens that a pair needs to be checked exactly: one at the threshold has
    fewer in at most CUT_SHARE of the allowed misses."""
    below, chances = 0.0, agreeing(threshold)
    for m in range(COORDS + 1):
        below += chances[m]
        if below > CUT_SHARE * (1 - recall):
            return m
    return COORDS


def _children(path: int, value: np.ndarray) -> list[int]:
    node = np.uint64(path & ((1 << 64) - 1))
    at = np.argsort(_hash(node, np.arange(COORDS)), kind="stable")[:SPLIT]
    return signed(_hash(node, at, value[at])).tolist()


def embedded(texts: DataFrame, roots: list[int], width: int) -> DataFrame:
    """doc_id, row, key (16 bytes, the set; null for an empty text), tokens (16 bits
    each) and the paths of the first level."""
    at = [(np.uint64(r), sampled(r)) for r in roots]

    def run(batches):
        for batch in pieces(batches):
            keys, sigs, paths = [], [], []
            for text in text_bytes(batch):
                s = shingles(text, width)
                if not len(s):
                    keys.append(None), sigs.append(None), paths.append([])
                    continue
                two = np.array([mix64(s).sum(), mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()], np.uint64)
                keys.append((two + np.uint64(len(s))).tobytes())
                t = tokens(s)
                sigs.append((t & np.uint32(0xFFFF)).astype(np.uint16).tobytes())
                paths.append(np.concatenate([signed(_hash(r, i, t[i])) for r, i in at]).tolist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(keys, pa.binary()),
                                   pa.array(sigs, pa.binary()), pa.array(paths, pa.list_(pa.int64()))],
                                  names=["doc_id", "row", "key", "tokens", "paths"])

    return texts.mapInArrow(run, "doc_id bigint, row bigint, key binary, tokens binary, paths array<bigint>")


def buckets(classes: DataFrame, bucket: int = BUCKET, depth: int = DEPTH) -> DataFrame:
    """(path, class, size) of the final buckets with at least two classes."""
    def sized(rows):
        # the sizes are a table of their own, so that the join can split a hot path
        sizes = checkpointed(rows.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"))
        return checkpointed(rows.join(sizes, "path"))

    def split(batches):
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in range(4))
            out = [(child, c, n) for c, p, s, n in zip(*columns) for child in _children(p, np.frombuffer(s, np.uint16))]
            yield pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in range(3)],
                                  names=["path", "class", "parent"])

    level = sized(classes.select(F.explode("paths").alias("path"), "class", F.lit(None).cast("bigint").alias("parent")))
    final = None
    for left in range(depth, -1, -1):
        split_on = (F.col("size") > bucket) & (F.col("parent").isNull() | (2 * F.col("size") < F.col("parent")))
        done = level.where(~split_on if left else F.lit(True)).select("path", "class", "size")
        final = done if final is None else final.unionByName(done)
        large = level.where(split_on)
        if not left or large.isEmpty():
            return final
        level = sized(large.join(classes.select("class", "tokens"), "class").select("class", "path", "tokens", "size")
                      .mapInArrow(split, "path bigint, class bigint, parent bigint"))


def _blocks(final: DataFrame, bucket: int) -> DataFrame:
    """Members dealt to tasks: a bucket's group, or a large bucket's pairs of blocks."""
    n = F.ceil(F.col("size") / bucket).cast("int")
    rows = final.withColumn("n", n).withColumn("block", F.pmod(F.xxhash64("class", "path"), F.col("n")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda x: F.struct(
        F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))).alias("pair")
    return rows.select("path", "class", "block", pair).select(
        F.xxhash64("path", "pair.i", "pair.j").alias("task"), "path", "class", "block",
        (F.col("pair.i") == F.col("pair.j")).alias("inner"))


def _candidates(least: int):
    """mapInArrow function over tasks: members with their partners among the pairs
    that belong to the task's bucket and agree on ``least`` tokens."""
    def run(batches):
        for group in grouped(batches):
            if group.num_rows < 2:
                continue
            path, inner = group["path"][0].as_py(), group["inner"][0].as_py()
            ids, block = group["class"].to_numpy(), group["block"].to_numpy()
            sig = np.stack([np.frombuffer(x, np.uint16) for x in group["tokens"].to_pylist()])
            mine = group["buckets"].to_pylist()
            sets = [set(x) for x in mine]
            partners: dict[int, list[int]] = {}
            for a in range(len(ids) - 1):
                near = a + 1 + np.flatnonzero((sig[a + 1:] == sig[a]).sum(1) >= least)
                for b in near:
                    if not inner and block[a] == block[b]:
                        continue  # compared within the block
                    if next(p for p in mine[a] if p in sets[b]) == path:
                        partners.setdefault(a, []).append(int(ids[b]))
                        partners.setdefault(int(b), [])
            if partners:
                yield pa.record_batch([pa.array([group["task"][0].as_py()] * len(partners), pa.int64()),
                                       pa.array([int(ids[a]) for a in partners], pa.int64()),
                                       pa.array(list(partners.values()), pa.list_(pa.int64()))],
                                      names=["task", "class", "partners"])

    return run


def _verified(threshold: float, width: int):
    """mapInArrow function over tasks: per member its links and local group."""
    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for group in grouped(batches):
            ids = group["class"].to_pylist()
            sets = {c: shingles(unpack(x), width) for c, x in zip(ids, group["packed"].to_pylist())}
            links, root = dict.fromkeys(ids, 0), {c: c for c in ids}

            def find(c):
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            for a, partners in zip(ids, group["partners"].to_pylist()):
                for b in partners:
                    x, y = sets[a], sets[b]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both >= threshold * (len(x) + len(y) - both) - 1e-9:
                        links[a] += 1
                        links[b] += 1
                        p, q = find(a), find(b)
                        root[max(p, q)] = min(p, q)
            hit = [c for c in ids if links[c]]
            yield pa.record_batch([pa.array(hit, pa.int64()), pa.array([links[c] for c in hit], pa.int64()),
                                   pa.array([find(c) for c in hit], pa.int64())], names=["class", "links", "root"])

    return run


def join(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, recall: float = RECALL,
         bucket: int = BUCKET, depth: int = DEPTH) -> DataFrame:
    """doc_id, row, group (doc_id of the group's first document), n_links, n_copies,
    first (whether the document is the group's first) of every row."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                        utf8(F.col("text")).alias("text"))
    path = scratch_path(spark, "chosen-path")
    embedded(texts, runs_for(recall, threshold, depth), width).write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema("doc_id bigint, row bigint, key binary, tokens binary, paths array<bigint>").parquet(path)
    order = F.struct(F.coalesce(F.col("doc_id"), F.lit(_LAST)).alias("doc"), F.col("row").alias("row"))
    # one row per set; its number is that of its first document
    classes = rows.where("key IS NOT NULL").select("key", order.alias("first"), "tokens", "paths").groupBy("key").agg(
        F.min(F.struct("first", "tokens", "paths")).alias("x"), F.count("*").alias("copies"))
    classes = classes.select(F.col("x.first.row").alias("class"), F.col("x.first.doc").alias("doc"), "key", "copies",
                             F.col("x.tokens").alias("tokens"), F.col("x.paths").alias("paths"))
    class_path = scratch_path(spark, "chosen-path-classes")
    classes.write.option("compression", "zstd").parquet(class_path)
    classes = spark.read.schema("class bigint, doc bigint, key binary, copies bigint, tokens binary, "
                                "paths array<bigint>").parquet(class_path)

    final = buckets(classes, bucket, depth)
    # a pair belongs to the first common bucket of its lists: the largest, then by path
    lists = final.groupBy("class").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("s"), "path")))
                                       .alias("b")).select("class", F.col("b.path").alias("buckets"))
    members = _blocks(final, bucket).join(lists.join(classes.select("class", "tokens"), "class"), "class")
    candidates = members.select("task", "path", "class", "block", "inner", "tokens", "buckets").repartition("task") \
        .sortWithinPartitions("task", "class").mapInArrow(
            _candidates(least_equal(recall, threshold)), "task bigint, class bigint, partners array<bigint>")
    linked = packed(texts).select(F.col("row").alias("class"), "packed").join(candidates, "class") \
        .select("task", "class", "partners", "packed").repartition("task").sortWithinPartitions("task", "class") \
        .mapInArrow(_verified(threshold, width), "class bigint, links bigint, root bigint")
    # a row may hold a text and hundreds of partners: fewer of them are sent to Python at once
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(PAIR_ROWS)):
        linked = checkpointed(linked)
    links = linked.groupBy("class").agg(F.sum("links").alias("n_links"))
    parts = components(linked.select(F.col("class").alias("a"), F.col("root").alias("b")))
    member = links.join(parts, links["class"] == parts["node"], "left").select(
        "class", "n_links", F.coalesce("component", "class").alias("component"))
    known = classes.select("class", "doc", "key", "copies").join(member, "class", "left").withColumn(
        "component", F.coalesce("component", "class"))
    top = known.groupBy("component").agg(F.min(F.struct("doc", "class")).alias("top"))
    known = known.join(top, "component").select("key", "copies", "n_links", "top")
    out = rows.select("doc_id", "row", "key").join(known, "key", "left")
    alone = F.col("top").isNull()
    first_doc = F.when(F.col("top.doc") == _LAST, F.lit(None)).otherwise(F.col("top.doc"))
    return out.select("doc_id", "row", F.when(alone, F.col("doc_id")).otherwise(first_doc).alias("group"),
                      F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      F.coalesce(F.col("copies") - 1, F.lit(0)).cast("bigint").alias("n_copies"),
                      (alone | (F.col("row") == F.col("top.class"))).alias("first"))


def firsts(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the first of their group."""
    gone = join(docs).where(~F.col("first")).select(F.col("row").alias("gone"))
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), doc)
    return rows.join(gone, rows["row"] == gone["gone"], "left_anti").select([F.col(f"doc.`{c}`") for c in docs.columns])


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = join(documents(spark, sf_dir))
    return found.select("doc_id", F.col("group").alias("class_id"), "n_links", "n_copies", F.col("first").alias("kept"))


ORACLE = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS rid, doc_id, text,
  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, unnest(CASE WHEN len(w) = 0 THEN [text] ELSE list_transform(
  range(1, greatest(len(w) - {WIDTH} + 1, 1) + 1), lambda p: array_to_string(w[p:p + {WIDTH} - 1], ' ')) END) AS g
  FROM d WHERE text <> ''),
k AS (SELECT rid, string_agg(g, chr(10) ORDER BY g) AS key, count(*) AS size FROM s GROUP BY rid),
c AS (SELECT key, min(rid) AS cls, any_value(size) AS size, count(*) AS members FROM k GROUP BY key),
cs AS (SELECT c.cls, c.size, s.g FROM c JOIN s ON s.rid = c.cls),
l AS (SELECT a.cls AS x, b.cls AS y FROM cs a JOIN cs b ON a.g = b.g AND a.cls < b.cls
  GROUP BY a.cls, b.cls, a.size, b.size HAVING 10 * count(*) >= {round(10 * THRESHOLD)} * (a.size + b.size - count(*))),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(x, y) AS (SELECT cls, cls FROM c UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
top AS (SELECT x AS cls, min(y) AS top FROM reach GROUP BY x),
n AS (SELECT x AS cls, count(*) AS n_links FROM e GROUP BY x)
SELECT d.doc_id, CASE WHEN top.top IS NULL THEN d.doc_id ELSE t.doc_id END AS class_id,
  CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(c.members - 1, 0) AS BIGINT) AS n_copies,
  top.top IS NULL OR top.top = d.rid AS kept
FROM d LEFT JOIN k USING (rid) LEFT JOIN c USING (key) LEFT JOIN top ON top.cls = c.cls LEFT JOIN n ON n.cls = c.cls
LEFT JOIN d t ON t.rid = top.top
"""
