"""Language-model scoring with a hidden Markov model.

Tokens are words (A-Z lower-cased) and one end token per text.  The HMM emits
symbols: every word of at least ``SYMBOL_RATE`` of the training tokens is its own
symbol, all other words fall into classes by their last two bytes, and the end is
a symbol.  A word's probability is P(symbol | state), times the word's add-half
share within its class where the symbol is a class, so the model is a proper
distribution over texts; one unseen word per class is allowed for.

Training is Baum-Welch.  Expected counts are formed per partition and summed by
Spark; the driver holds only the parameters (states x symbols, bounded because at
most ``1 / SYMBOL_RATE`` words are symbols).  The first ``warm_up`` passes separate the
states by expectation maximisation over the counts of neighbouring symbols (a, b) of
*all* training texts, a table of at most symbols x symbols rows; then ``passes`` full
passes run over every training text.  Nothing is learnt from a sample.  The scaled
forward recursion gives the exact likelihood of each whole text.

Counts of words below ``LOCAL_RATE`` (the vocabulary's unbounded part) come from a
shuffle join of (document, word) with the counts; a more frequent word -- at most
``1 / LOCAL_RATE`` of them -- is broadcast, so no join key is hot.

Defined results: null is empty text (only the end token); a null id is not held
out; repeated rows are scored alike; without training rows N and V are 0 and the
formulas hold as written; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove_path, scratch_path
from .common import checkpointed, crc_bucket, documents, text_bytes, utf8

STATES = 8
#: Share of the training tokens from which a word is a symbol of its own (at most 1 / share words).
SYMBOL_RATE = 1 / 4000
#: Share from which a word's count is broadcast.
LOCAL_RATE = 1 / 200_000
CLASSES = 64
#: Key of the end token: no word is empty.
END = b""
#: Tokens whose forward variables are held at once, and different words counted at once.
TOKENS_AT_ONCE, WORDS_AT_ONCE = 400_000, 1_000_000


def tokens(data: bytes) -> list[bytes]:
    return data.lower().split()


# ---- word counts --------------------------------------------------------------

def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over the texts, ends counted under END."""
    def count(batches):
        sums: Counter = Counter()

        def flushed():
            batch = pa.record_batch([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())],
                                    names=["word", "n"])
            sums.clear()
            return batch

        for batch in batches:
            for data in text_bytes(batch):
                sums.update(tokens(data))
                sums[END] += 1
                if len(sums) > WORDS_AT_ONCE:
                    yield flushed()
        yield flushed()

    return texts.select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


class _Classes(dict):
    """Class by the last two bytes, remembered."""

    def __missing__(self, ending: bytes) -> int:
        self[ending] = c = zlib.crc32(ending) % CLASSES
        return c


class Vocabulary:
    """Frequent words with their counts, symbols and class sums."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int,
                 class_total: np.ndarray, class_distinct: np.ndarray):
        self.total, self.distinct = total, distinct
        self.number = {w: i for i, w in enumerate(words)}
        own = (counts >= max(2, total * SYMBOL_RATE)) | np.array([w == END for w in words], bool)
        classes = np.array([class_of(w) for w in words], np.int64)
        self.own_words = int(own.sum())
        self.symbols = self.own_words + CLASSES
        self.symbol = np.where(own, np.cumsum(own) - 1, self.own_words + classes).astype(np.int32)
        self.base = np.log10(counts + 0.5)
        self.base_size = math.log10(total + 0.5 * (distinct + 1))
        # within its class, a word's share has the class's total below the line
        self.class_size = np.log10(class_total + 0.5 * (class_distinct + 1))
        self.within = np.where(own, 0.0, self.base - self.class_size[classes])
        self.ending = _Classes()
        self.unigram = np.zeros(self.symbols)
        np.add.at(self.unigram, self.symbol[own], counts[own])
        self.unigram[self.own_words:] = class_total
        self.unigram = (self.unigram + 0.5) / (self.unigram + 0.5).sum()
        self.end = self.number.get(END)

    def encoded(self, data: bytes):
        """(symbols, numbers of the frequent words, -1 elsewhere, other words)."""
        words = tokens(data)
        get = self.number.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        other = [words[i] for i in np.flatnonzero(ids < 0)]
        symbols = np.empty(len(words) + 1, np.int32)
        if len(self.symbol):
            symbols[:-1] = self.symbol[ids]
        ending = self.ending
        symbols[:-1][ids < 0] = [self.own_words + ending[w[-2:]] for w in other]
        symbols[-1] = self.symbol[self.end] if self.end is not None else self.own_words + class_of(END)
        return symbols, ids, other


def vocabulary(counts: DataFrame) -> tuple:
    """The arguments of ``Vocabulary``: at most 1 / LOCAL_RATE words, and sums."""
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    total, distinct = int(total or 0), int(distinct)
    local = counts.where((F.col("n") >= total * LOCAL_RATE) | (F.length("word") == 0)).toArrow()
    words, n = [bytes(w) for w in local["word"].to_pylist()], local["n"].to_numpy().astype(np.int64)
    order = sorted(range(len(words)), key=lambda i: words[i])
    words, n = [words[i] for i in order], n[order]
    classed = counts.where((F.col("n") < max(2, total * SYMBOL_RATE)) & (F.length("word") > 0)).groupBy(
        (F.crc32(F.substring("word", -2, 2)) % CLASSES).cast("int").alias("c")).agg(
        F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    class_total, class_distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in classed:
        class_total[r["c"]], class_distinct[r["c"]] = r["n"], r["v"]
    return words, n, total, distinct, class_total, class_distinct


# ---- the hidden Markov model ----------------------------------------------------

def groups(lengths: np.ndarray, at_once: int = TOKENS_AT_ONCE):
    """Index arrays of texts, longest first, so that texts of a group have similar lengths."""
    order = np.argsort(-lengths, kind="stable")
    first = 0
    total = 0
    for i, k in enumerate(order):
        if i > first and total + lengths[k] > at_once:
            yield order[first:i]
            first, total = i, 0
        total += lengths[k]
    if first < len(order):
        yield order[first:]


def forward(texts: list[np.ndarray], start, trans, emit, keep: bool = False):
    """Scaled forward recursion over texts sorted by falling length (each has a
    token).  Returns log10 likelihoods and, on request, (alphas, scales, actives)
    by position for ``backward``."""
    lengths = np.array([len(x) for x in texts])
    flat = np.concatenate(texts)
    offset = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    by_symbol = np.ascontiguousarray(emit.T)
    loglik = np.zeros(len(texts))
    alphas, scales, actives = [], [], []
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # texts longer than t
    alpha = None
    for t in range(lengths[0]):
        n = active[t]
        e = by_symbol[flat[offset[:n] + t]]
        alpha = e * start if t == 0 else (alpha[:n] @ trans) * e
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        loglik[:n] += np.log10(scale)
        if keep:
            alphas.append(alpha)
            scales.append(scale)
            actives.append(n)
    return loglik, (flat, offset, by_symbol, alphas, scales, actives)


def expected_counts(texts: list[np.ndarray], start, trans, emit):
    """Baum-Welch: expected starts, transitions and emissions, and the log10 likelihood."""
    loglik, (flat, offset, by_symbol, alphas, scales, actives) = forward(texts, start, trans, emit, keep=True)
    k, m = emit.shape
    moves, gammas, symbols = np.zeros((k, k)), [], []
    later = None
    for t in range(len(alphas) - 1, -1, -1):
        n = actives[t]
        beta = np.ones((n, k))
        if later is not None:
            moves += alphas[t][:len(later)].T @ later
            beta[:len(later)] = later @ trans.T
        gammas.append(alphas[t] * beta)
        seen = flat[offset[:n] + t]
        symbols.append(seen)
        if t:
            later = by_symbol[seen] * beta / scales[t][:, None]
    gamma, seen = np.concatenate(gammas), np.concatenate(symbols)
    emitted = np.stack([np.bincount(seen, weights=gamma[:, s], minlength=m) for s in range(k)])
    return gammas[-1].sum(0), moves * trans, emitted, float(loglik.sum())


def initial(vocab: Vocabulary, seed: int = 3):
    rng = np.random.default_rng(seed)
    emit = vocab.unigram * rng.exponential(1.0, (STATES, vocab.symbols)) ** 0.5
    trans = np.full((STATES, STATES), 0.1 / (STATES - 1))
    np.fill_diagonal(trans, 0.9)
    return np.full(STATES, 1 / STATES), trans, emit / emit.sum(1, keepdims=True)


def reestimated(sums, vocab: Vocabulary):
    starts, moves, emitted = sums
    start = starts + 0.1
    trans = moves + 0.1
    emit = emitted + 20.0 * vocab.unigram  # keeps every symbol possible in every state
    return start / start.sum(), trans / trans.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True)


def _text_counts(batch, model):
    """Sums of ``expected_counts`` over a batch of encoded texts (column seq)."""
    texts = [np.frombuffer(x, np.uint16).astype(np.int64) for x in batch.column(0).to_pylist()]
    for g in groups(np.array([len(x) for x in texts], np.int64)):
        yield expected_counts([texts[j] for j in g], *model)


def _pair_counts(batch, model):
    """Expected counts over neighbouring symbols a, b that occur n times (columns a, b,
    n): of the first state, of moves, of emissions, and the log10 likelihood."""
    start, trans, emit = model
    a, b, n = (batch.column(i).to_numpy() for i in range(3))
    if not len(a):
        return
    by_symbol = np.ascontiguousarray(emit.T)
    left, right = by_symbol[a] * start, by_symbol[b]
    ahead = left @ trans
    p = (ahead * right).sum(1)
    w = (n / p)[:, None]
    first, second = left * (right @ trans.T) * w, ahead * right * w
    emitted = np.stack([np.bincount(a, weights=first[:, s], minlength=emit.shape[1])
                        + np.bincount(b, weights=second[:, s], minlength=emit.shape[1]) for s in range(len(start))])
    yield first.sum(0), (left * w).T @ right * trans, emitted, float((n * np.log10(p)).sum())


def baum_welch_pass(rows: DataFrame, model, symbols: int, counts=_text_counts):
    """Expected counts summed over all partitions: (starts, moves, emissions), log10 likelihood."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        sums = [np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, symbols)), 0.0]
        for batch in batches:
            for found in counts(batch, shared.value):
                for i, x in enumerate(found):
                    sums[i] = sums[i] + x
        kind, state, symbol, value = [], [], [], []
        for i, x in enumerate(sums):
            x = np.atleast_2d(x)
            at = np.nonzero(x)
            kind.append(np.full(len(at[0]), i))
            state.append(at[0])
            symbol.append(at[1])
            value.append(x[at])
        yield pa.record_batch([pa.array(np.concatenate(c)) for c in (kind, state, symbol, value)],
                              names=["kind", "state", "symbol", "value"])

    found = rows.mapInArrow(run, "kind bigint, state bigint, symbol bigint, value double") \
        .groupBy("kind", "state", "symbol").agg(F.sum("value").alias("value")).toArrow()
    out = [np.zeros((1, STATES)), np.zeros((STATES, STATES)), np.zeros((STATES, symbols)), np.zeros((1, 1))]
    kinds, state, symbol, value = (found[c].to_numpy() for c in ("kind", "state", "symbol", "value"))
    for i, x in enumerate(out):
        mine = kinds == i
        x[state[mine], symbol[mine]] = value[mine]
    return (out[0][0], out[1], out[2]), float(out[3][0, 0])


def pairs(sequences: DataFrame, symbols: int) -> DataFrame:
    """(a, b, n): how often symbol b follows symbol a in a text, over all texts."""
    def run(batches):
        def flushed(codes):
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            return pa.record_batch([pa.array(code // symbols), pa.array(code % symbols), pa.array(n.astype(np.int64))],
                                   names=["a", "b", "n"])

        codes, held = [], 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                x = np.frombuffer(x, np.uint16).astype(np.int64)
                codes.append(x[:-1] * symbols + x[1:])
                held += len(x)
                if held > 4 * TOKENS_AT_ONCE:
                    yield flushed(codes)
                    codes, held = [], 0
        if codes:
            yield flushed(codes)

    return sequences.select("seq").mapInArrow(run, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def encode(texts: DataFrame, parts: tuple) -> DataFrame:
    """row and seq (symbols as unsigned 16-bit numbers) of each text."""
    shared = texts.sparkSession.sparkContext.broadcast(parts)

    def run(batches):
        vocab = Vocabulary(*shared.value)
        for batch in batches:
            seqs = [vocab.encoded(x)[0].astype(np.uint16).tobytes() for x in text_bytes(batch)]
            yield pa.record_batch([batch.column(0), pa.array(seqs, pa.binary())], names=["row", "seq"])

    return texts.select("row", "text").mapInArrow(run, "row bigint, seq binary")


def train(texts: DataFrame, parts: tuple, warm_up: int = 20, passes: int = 2):
    """HMM parameters from the training texts (columns row, text)."""
    spark = texts.sparkSession
    vocab = Vocabulary(*parts)
    path = scratch_path(spark, "hmm-sequences")
    encode(texts, parts).write.option("compression", "zstd").parquet(path)
    sequences = spark.read.parquet(path).select("seq")
    model = initial(vocab)
    neighbours = checkpointed(pairs(sequences, vocab.symbols))
    for _ in range(warm_up):
        model = reestimated(baum_welch_pass(neighbours, model, vocab.symbols, _pair_counts)[0], vocab)
    for _ in range(passes):
        model = reestimated(baum_welch_pass(sequences, model, vocab.symbols)[0], vocab)
    remove_path(spark, path)
    return model


# ---- scoring --------------------------------------------------------------------

HEADS = ("n_tokens", "known", "base", "score")


def head_and_tail(texts: DataFrame, parts: tuple, model) -> DataFrame:
    """Each text's score without the counts of its rare words, and these words."""
    shared = texts.sparkSession.sparkContext.broadcast((parts, model))

    def run(batches):
        args, (start, trans, emit) = shared.value
        vocab = Vocabulary(*args)
        for batch in batches:
            rows, seqs = [], []
            for data in text_bytes(batch):
                symbols, ids, other = vocab.encoded(data)
                ids = ids[ids >= 0] if vocab.end is None else np.append(ids[ids >= 0], vocab.end)
                left = Counter(other) if vocab.end is not None else Counter([*other, END])
                classes = np.array([vocab.ending[w[-2:]] for w in left.elements()], np.int64)
                rows.append((len(symbols), len(ids), float(vocab.base[ids].sum()) - len(symbols) * vocab.base_size,
                             float(vocab.within[ids].sum()) - float(vocab.class_size[classes].sum()), left))
                seqs.append(symbols)
            loglik = np.zeros(len(seqs))
            for g in groups(np.array([len(x) for x in seqs], np.int64)):
                loglik[g] = forward([seqs[j] for j in g], start, trans, emit)[0]
            yield pa.record_batch([
                *batch.columns[:-1], pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.float64()),
                pa.array([r[3] + x for r, x in zip(rows, loglik)], pa.float64()),
                pa.array([list(r[4]) for r in rows], pa.list_(pa.binary())),
                pa.array([list(r[4].values()) for r in rows], pa.list_(pa.int64()))],
                names=["doc_id", "held_out", *HEADS, "word", "times"])

    return texts.select("doc_id", "held_out", "text").mapInArrow(
        run, "doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, score double, "
             "word array<binary>, times array<bigint>")


def score(texts: DataFrame, counts: DataFrame, parts: tuple, model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score of every row."""
    rows = head_and_tail(texts, parts, model).withColumn("row", F.monotonically_increasing_id())
    head_type = "struct<doc_id:bigint,held_out:boolean,n_tokens:bigint,known:bigint,base:double,score:double>"
    head = F.struct("doc_id", "held_out", *HEADS)
    # a text sends its own figures under a key that holds a space, which no word does
    own = F.array(F.struct(F.concat(F.lit(b" "), F.col("row").cast("string").cast("binary")).alias("word"),
                           F.lit(0).cast("bigint").alias("times"), head.alias("head")))
    tail = F.transform(F.arrays_zip("word", "times"), lambda x: F.struct(
        x["word"].alias("word"), x["times"].alias("times"), F.lit(None).cast(head_type).alias("head")))
    sent = rows.select("row", F.explode(F.concat(own, tail)).alias("x")).select("row", "x.*")
    found = sent.join(counts, "word", "left")
    c = F.coalesce(F.col("n"), F.lit(0))
    # one row has the figures; the maximum of each number, as that of a struct would sort all rows
    sums = found.groupBy("row").agg(
        *[F.max(f"head.{x}").alias(x) for x in ("doc_id", "held_out", *HEADS)],
        F.sum(F.col("times") * F.log10(c + 0.5)).alias("rare"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    return sums.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.col("rare_known")).alias("n_known"),
                       (F.col("base") + F.col("rare")).alias("base_score"), (F.col("score") + F.col("rare")).alias("score"))


def op3_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                        F.coalesce(crc_bucket(F.col("doc_id"), 5) == 1, F.lit(False)).alias("held_out"),
                        F.monotonically_increasing_id().alias("row"), utf8(F.col("text")).alias("text"))
    train_texts = texts.where(~F.col("held_out"))
    path = scratch_path(spark, "hmm-counts")
    word_counts(train_texts).write.option("compression", "zstd").parquet(path)
    counts = spark.read.parquet(path)
    parts = vocabulary(counts)
    model = train(train_texts, parts)
    return score(texts, counts, parts, model).withColumn("train_tokens", F.lit(parts[2]).cast("bigint"))
