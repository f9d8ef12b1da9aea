"""Mixing sources to target weights by subset-sum budget fitting.

1. Sizes: words per document.  2. Targets: weights 5, 2, 1 (repeating, sources in
code-point order, null last) share 150 % of all words; a target stops at twice
its source and the excess is reshared.  3. Per source, documents are counted by
exact size, each for as many takes as it may have; a proportional number of each size is
set, and a bounded-knapsack dynamic program over the size counts fits the remaining
budget exactly where a subset sum allows it.  4. The takes of a size are dealt
evenly, and a seeded hash chooses the documents that get one more.

What is gathered: one row per source on the driver (sizes and targets), and per
source the histogram of sizes (as many rows as there are different sizes) in one
task.  Choosing within a size ranks only documents of one hash bucket, so a size
that holds many documents is spread over ``BUCKETS`` groups.

Defined results: null and empty texts have size 0 and nothing taken; the null
source is a source of its own; repeated rows are single documents; an empty table
gives an empty result; a source without words has target 0; other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, documents, null_safe_key, pieces, text_bytes, utf8, word_ranges

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BUCKETS = 1024
#: Words that the dynamic program fits at the end of a source's budget.
DP_WORDS = 16384


def count_words(docs: DataFrame) -> DataFrame:
    """doc_id, source, source_key, size, draw (seeded hash) of every row."""
    def count(batches):
        for batch in pieces(batches):
            sizes = [len(word_ranges(np.frombuffer(x, np.uint8))[0]) for x in text_bytes(batch)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())],
                                  names=["doc_id", "source", "size"])

    sized = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        utf8(F.col("text")).alias("text")).mapInArrow(
        count, "doc_id bigint, source string, size bigint")
    return sized.withColumn("source_key", null_safe_key(F.col("source")))


def targets(sizes: list[tuple[str | None, int]]) -> dict[str | None, float]:
    """Water filling: weight shares, capped at MOST times the source."""
    order = sorted((s for s, _ in sizes if s is not None)) + [s for s, _ in sizes if s is None]
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    have = dict(sizes)
    left, open_ = SHARE * sum(have.values()), set(order)
    out = {s: 0.0 for s in order}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > MOST * have[s]]
        if not over:
            for s in open_:
                out[s] = left * weight[s] / total
            break
        for s in over:
            out[s] = float(MOST * have[s])
            open_.discard(s)
        left = SHARE * sum(have.values()) - sum(out[s] for s in order if s not in open_)
    return out


def subset_sum(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each size to take so that the sum is nearest to the budget
    (bounded knapsack, exact; of two equally near sums the smaller)."""
    top = budget + min((s for s, c in zip(sizes, counts) if c), default=0)
    last = np.full(top + 1, -1, np.int32)  # item that first reached a sum
    reach = np.zeros(top + 1, bool)
    reach[0] = True
    items: list[tuple[int, int]] = []
    for k, (size, count) in enumerate(zip(sizes, counts)):
        count = min(count, top // size)
        piece = 1
        while count > 0 and not reach[budget]:
            piece = min(piece, count)
            w = size * piece
            if w <= top:
                new = np.zeros_like(reach)
                new[w:] = reach[:-w]
                new &= ~reach
                last[new] = len(items)
                items.append((k, piece))
                reach |= new
            count -= piece
            piece *= 2
    take = [0] * len(sizes)
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        k, piece = items[last[at]]
        take[k] += piece
        at -= sizes[k] * piece
    return take


def fit_source(sizes: list[int], counts: list[int], target: float, dp_words: int = DP_WORDS) -> list[int]:
    """How often documents of each size are taken in all, each at most MOST times."""
    pieces = [MOST * c for c in counts]
    total = sum(s * p for s, p in zip(sizes, pieces))
    budget = min(int(round(target)), total)
    if budget <= 0:
        return [0] * len(sizes)
    take = [p * budget // total for p in pieces]
    left = budget - sum(s * t for s, t in zip(sizes, take))
    largest_first = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    for i in largest_first:  # down to what the program can fit, it may use every size
        more = min(pieces[i] - take[i], max(0, left - dp_words // 2) // sizes[i])
        take[i] += more
        left -= more * sizes[i]
    for i in largest_first:  # or up to it
        less = min(take[i], max(0, dp_words - left) // sizes[i])
        take[i] -= less
        left += less * sizes[i]
    fit = [i for i in range(len(sizes)) if pieces[i] > take[i]]
    if left <= dp_words:
        more = subset_sum([sizes[i] for i in fit], [pieces[i] - take[i] for i in fit], left)
    else:  # the small sizes are used up: the nearest that the large ones leave
        more = [0] * len(fit)
        for j, i in sorted(enumerate(fit), key=lambda x: -sizes[x[1]]):
            more[j] = min(pieces[i] - take[i], (left + sizes[i] // 2) // sizes[i])
            left = max(0, left - more[j] * sizes[i])
    for i, t in zip(fit, more):
        take[i] += t
    return take


def mix(docs: DataFrame, seed: int = 17, dp_words: int = DP_WORDS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row."""
    spark = docs.sparkSession
    # words are counted once; the table (a few numbers a document) is kept in the shared folder
    sized = count_words(docs).withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "source_key", "size")) \
        .withColumn("bucket", F.pmod("draw", F.lit(BUCKETS)).cast("int"))
    sized = checkpointed(sized)
    per_bucket = sized.groupBy("source_key", "size", "bucket").agg(F.count("*").alias("n"))
    hist = per_bucket.groupBy("source_key", "size").agg(F.sum("n").alias("n"))
    sums = hist.groupBy("source_key").agg(F.sum(F.col("n") * F.col("size")).alias("words")).collect()
    name = lambda key: None if key == "n" else key[1:]
    goal = targets([(name(r["source_key"]), int(r["words"])) for r in sums])
    # an Arrow table: rows of Python objects would start Python workers of another kind beside those of the tasks
    goals = spark.createDataFrame(pa.table({
        "source_key": pa.array([r["source_key"] for r in sums], pa.string()),
        "source_size": pa.array([int(r["words"]) for r in sums], pa.int64()),
        "target": pa.array([goal[name(r["source_key"])] for r in sums], pa.float64())}))

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        target = float(group["target"].iloc[0])
        words = group[group["size"] > 0]
        taken = dict(zip(words["size"], fit_source([int(x) for x in words["size"]], [int(x) for x in words["n"]],
                                                   target, dp_words)))
        share = [divmod(taken.get(s, 0), n) for s, n in zip(group["size"], group["n"])]
        return pd.DataFrame({"source_key": group["source_key"], "size": group["size"],
                             "source_size": group["source_size"], "target": group["target"],
                             "copies": [c for c, _ in share], "more": [m for _, m in share]})

    planned = hist.join(goals, "source_key").groupBy("source_key").applyInPandas(
        plan, "source_key string, size bigint, source_size bigint, target double, copies bigint, more bigint")
    # buckets of a size are taken in order; within the last one the draws decide
    before = W.partitionBy("source_key", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    dealt = per_bucket.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))) \
        .join(planned, ["source_key", "size"]) \
        .withColumn("quota", F.col("more") - F.col("before")).drop("n", "before", "more")
    rank = F.row_number().over(W.partitionBy("source_key", "size", "bucket").orderBy("draw", "doc_id"))
    out = sized.join(dealt, ["source_key", "size", "bucket"]).withColumn("rank", rank)
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("copies") + (F.col("rank") <= F.col("quota")).cast("bigint"))
    return out.select("doc_id", "source", "size", "source_size", "target", copies.cast("bigint").alias("copies"),
                      (copies * F.col("size")).cast("bigint").alias("taken"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
