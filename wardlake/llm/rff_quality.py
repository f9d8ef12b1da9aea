"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

A text becomes some twenty statistics (lengths, shares of kinds of characters,
repetition); the standardised statistics x become D random features
cos(W x + b), whose products approximate a Gaussian kernel.  Each part of the
labelled rows adds up its normal equations, the sums of the parts are added in two
rounds, and the driver solves one system of D + 1 unknowns.  A quarter of the
labelled rows (by hash of the id) is not fitted but used for calibration: raw scores
are counted in ``BINS`` bins, and the pool-adjacent-violators algorithm turns the
bins into a rising curve, between whose points a score is interpolated.

All labelled rows take part and every count covers all data; what reaches the
driver is bounded by D and BINS.  Texts are read once: the statistics are stored,
one narrow row per document, and serve training and scoring.  ``labels`` are joined
only to the rows that may be learned from; labels, lang, source and doc_id are no
statistics.

Defined results: null and empty texts have statistics of zero and get a score;
repeated rows are scored alike, and as often as they occur with a label they are
learned; of several label rows of a document any quality of 1 counts as 1, a null or
other quality is no label; rows without a doc_id have no label and are not held
out; with nothing to learn from every score is 0.5; an empty table gives no row;
other columns are not read.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, crc_bucket, documents, text_bytes, utf8

FEATURES = 160  # D
BINS = 2000
RIDGE = 1e-4
SEED = 13
#: Partial sums that are added by one task of the second round.
FAN_IN = 64
#: One row in so many (by hash of the id) calibrates.
CALIBRATE = 4

_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_SYMBOL, _MARK, _STOP = b"#$%&*|<>=+~^_\\{}[]@", b"!?", b".,;:"
_HIGH, _FOLLOWING = bytes(range(0x80, 0x100)), bytes(range(0x80, 0xC0))
_SPACE = b" \t\n\x0b\x0c\r"
STATISTICS = ("log_chars", "log_words", "word_length", "line_words", "upper", "lower", "high", "digit", "symbol", "mark", "stop",
              "space", "distinct", "top_word", "same_next", "distinct_pairs", "distinct_lines", "upper_words", "symbol_words",
              "ended_lines")


def statistics(text: bytes) -> tuple[float, ...]:
    """The statistics of a text, in the order of ``STATISTICS``."""
    size = len(text)

    def count(kind: bytes, of: bytes = text) -> int:
        return len(of) - len(of.translate(None, kind))

    words = text.split()
    n, chars = len(words), size - count(_FOLLOWING)
    if not n:
        return (math.log1p(chars),) + (0.0,) * (len(STATISTICS) - 1)
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    often = Counter(words)
    ends = bytes(w[-1] for w in words)
    starts = bytes(w[0] for w in words)
    last = bytes(w[-2] if len(w) > 1 else w[0] for w in words)  # the letter before a final mark
    return (math.log1p(chars), math.log1p(n), min(50.0, (chars - count(_SPACE)) / n), math.log1p(n / len(lines)),
            count(_UPPER) / chars, count(_LOWER) / chars, (chars - size + count(_HIGH)) / chars, count(_DIGIT) / chars,
            count(_SYMBOL) / chars, count(_MARK) / chars, count(_STOP) / chars, count(_SPACE) / chars,
            len(often) / n, max(often.values()) / n, sum(map(operator.eq, words, words[1:])) / n,
            len(set(zip(words, words[1:]))) / max(1, n - 1), len(set(lines)) / len(lines),
            (count(_UPPER, starts) + count(_UPPER, last)) / (2 * n), count(_SYMBOL, ends) / n,
            sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines))


def described(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every text."""
    def run(batches):
        for batch in batches:
            rows = np.array([statistics(t) for t in text_bytes(batch)]).reshape(-1, len(STATISTICS))
            yield pa.record_batch([batch.column(0)] + [pa.array(rows[:, k]) for k in range(len(STATISTICS))],
                                  names=["doc_id", *STATISTICS])

    kinds = ", ".join(f"{c} double" for c in STATISTICS)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8(F.col("text")).alias("text")).mapInArrow(
        run, f"doc_id bigint, {kinds}")


@dataclass
class Model:
    """Mean and spread of the statistics, the random features, their weights and the
    calibration curve."""
    mean: np.ndarray
    spread: np.ndarray
    turn: np.ndarray  # W
    phase: np.ndarray  # b
    weights: np.ndarray | None = None
    curve: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, batch) -> np.ndarray:
        x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in STATISTICS], axis=1)
        # far outliers would turn the cosines round and round
        x = np.clip((x - self.mean) / self.spread, -6.0, 6.0)
        z = np.cos(x @ self.turn + self.phase) * math.sqrt(2.0 / len(self.phase))
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def raw(self, batch) -> np.ndarray:
        return self.features(batch) @ self.weights

    def score(self, batch) -> np.ndarray:
        if self.weights is None:
            return np.full(batch.num_rows, 0.5)
        raw = self.raw(batch)
        return np.clip(raw if self.curve is None else np.interp(raw, *self.curve), 0.0, 1.0)


def bin_of(raw: np.ndarray, bins: int) -> np.ndarray:
    """Bins of equal width over [-1, 2); what lies outside goes to the ends."""
    return np.clip(np.floor((raw + 1.0) / 3.0 * bins), 0, bins - 1).astype(np.int32)


def rising(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the rising step function nearest to the means y of n
    rows at x, one point for each pool (its mean x)."""
    pools: list[list[float]] = []
    for a, b, c in zip(x.tolist(), y.tolist(), n.tolist()):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            top = pools.pop()
            pools[-1] = [s + t for s, t in zip(pools[-1], top)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _added(parts: DataFrame) -> DataFrame:
    """Sums of the arrays ``values`` per ``row``, at most FAN_IN groups of parts first."""
    def add(table: pa.Table) -> pa.Table:
        values = table.column("values").combine_chunks()
        total = values.flatten().to_numpy().reshape(table.num_rows, -1).sum(axis=0)
        return pa.table({"row": table.column("row").slice(0, 1), "part": table.column("part").slice(0, 1),
                         "values": pa.array([total], pa.list_(pa.float64()))})

    schema = "row int, part int, values array<double>"
    first = parts.withColumn("part", F.pmod("part", F.lit(FAN_IN))).groupBy("row", "part").applyInArrow(add, schema)
    return first.groupBy("row").applyInArrow(add, schema)


def normal_equations(rows: DataFrame, model: Model) -> np.ndarray:
    """[Z 1 y]'[Z 1 y] over all rows (columns: the statistics and quality)."""
    width = len(model.phase) + 2

    def run(batches):
        total, part = np.zeros((width, width)), 0
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows:
                z = np.column_stack([model.features(batch), batch.column("quality").to_numpy().astype(float)])
                total += z.T @ z
        if total.any():
            yield pa.record_batch([pa.array(range(width), pa.int32()), pa.array([part] * width, pa.int32()),
                                   pa.array(list(total), pa.list_(pa.float64()))], names=["row", "part", "values"])

    found = _added(rows.mapInArrow(run, "row int, part int, values array<double>")).collect()
    out = np.zeros((width, width))
    for r in found:
        out[r["row"]] = r["values"]
    return out


def fit(described_rows: DataFrame, labels: DataFrame, learn: Column | None = None, features: int = FEATURES,
        bins: int = BINS, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """Model from the rows of ``described`` that have a label (and meet ``learn``)."""
    marked = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max(F.col("quality").cast("int")).alias("quality"))
    if learn is not None:
        described_rows = described_rows.where(learn)
    # a table of its own: it is read for the moments, the equations and the calibration
    rows = checkpointed(described_rows.join(marked, "doc_id").withColumn(
        "fold", F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATE))).drop("doc_id"))
    moments = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in STATISTICS], *[F.stddev_pop(c).alias(f"s_{c}") for c in STATISTICS]).first()
    mean = np.array([moments[f"m_{c}"] or 0.0 for c in STATISTICS])
    spread = np.array([moments[f"s_{c}"] or 0.0 for c in STATISTICS])
    rng = np.random.default_rng(seed)
    # kernel width: the root of the number of statistics, the usual distance of two rows being sqrt(2) times that
    turn = rng.normal(size=(len(STATISTICS), features)) / math.sqrt(len(STATISTICS))
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0), turn, rng.uniform(0, 2 * math.pi, features))
    sums = normal_equations(rows.where("fold <> 0"), model)
    n = sums[-2, -2]
    if not n:  # few rows: all of them are fitted
        sums = normal_equations(rows, model)
        n = sums[-2, -2]
        if not n:
            return model
    penalty = np.append(np.full(features, ridge * n), 0.0)  # none on the intercept
    model.weights = np.linalg.solve(sums[:-1, :-1] + np.diag(penalty), sums[:-1, -1])

    def binned(batches):
        for batch in batches:
            if batch.num_rows:
                raw = model.raw(batch)
                yield pa.record_batch([pa.array(bin_of(raw, bins)), pa.array(raw), batch.column("quality")],
                                      names=["bin", "raw", "quality"])

    counted = rows.where("fold = 0").mapInArrow(binned, "bin int, raw double, quality int").groupBy("bin").agg(
        F.count("*").alias("n"), F.avg("raw").alias("x"), F.avg("quality").alias("y")).orderBy("bin").collect()
    if counted:
        model.curve = rising(*[np.array([float(r[c]) for r in counted]) for c in ("x", "y", "n")])
    return model


def scored(described_rows: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of ``described``."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([batch.column(0), pa.array(model.score(batch))], names=["doc_id", "score"])

    return described_rows.mapInArrow(run, "doc_id bigint, score double")


def op13_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpointed(described(documents(spark, sf_dir)))
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), 3) == 1, F.lit(False))
    model = fit(rows, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"), ~held_out)
    out = scored(rows, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
