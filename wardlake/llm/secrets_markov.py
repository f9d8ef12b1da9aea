"""Secret scans: fixed patterns plus a character Markov model.

Two first-order character Markov models -- of random strings and of ordinary
identifiers -- are trained from labelled samples; a token is a secret when its
log-likelihood ratio reaches ``min_llr``.  Everything is DataFrame / SQL
functions: no Python on the executors, no shuffle on the scan itself.

Labelled samples: *random* are digests in the usual key alphabets (hex, base64,
upper-case base32) and the values that the fixed patterns found in the training
documents; *ordinary* are these documents' other tokens that have the form of a
name (letters and separators, a short number at the end).  The training
documents are those whose id hash falls under ``train_docs / number of rows``
(a bounded sample in expectation; this bounds only the fit, the scan covers
every text).  The model is a table of ``len(ALPHABET) ** 2`` ratios.

Defined results: null or empty text has no span; a null id gets its own row;
repeated rows are scanned each for itself; other columns of the input are not
read.  Positions are code points, end exclusive, whole match.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, empty_spans, matched_spans

#: Fixed base patterns, in their order among equal starts.  Length limits apply
#: to the leftmost match (of assign: to its second group).
ASSIGN = (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")
#: A run of access or hex characters that passes the length limit is found by the
#: same run with the limit inside: a shorter run can hold no longer one.
ACCESS_16 = r"AKIA[A-Z0-9]{12,}"
HEX_32 = r"[0-9a-f]{32,}"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
#: Tokens that the model judges: ends are not punctuation of the sentence.
MIN_TOKEN = 16
TOKEN = r"[A-Za-z0-9+/_=.-]{%d,}" % MIN_TOKEN


#: Form of an ordinary identifier among the training tokens.
ORDINARY = r"^[A-Za-z][A-Za-z_./-]*[0-9]{0,3}[.]?$"


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the fixed patterns, by kind; null text has none."""
    def gated(pattern, keep=None):
        return F.when(text.rlike(pattern), matched_spans(text, pattern, keep)).otherwise(empty_spans())

    return {"assign": gated(ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8),
            "access": gated(ACCESS_16), "hex": gated(HEX_32)}


def training_documents(docs: DataFrame, train_docs: int) -> DataFrame:
    """About ``train_docs`` rows, chosen by a hash of the id."""
    n = max(docs.count(), 1)
    limit = min(1.0, train_docs / n)
    return docs.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 30)) < int(limit * (1 << 30)))


def labelled_samples(docs: DataFrame) -> DataFrame:
    """(label, value): label 1 random, 0 ordinary, from the given documents."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = base_spans(text)
    hits = F.concat(spans["assign"], spans["access"], spans["hex"])
    value = F.regexp_extract(F.col("s.val"), r"([A-Za-z0-9+/_.=-]+)$", 1)
    rand = docs.select(F.explode(hits).alias("s")).select(F.lit(1).alias("label"), value.alias("value"))
    plain = F.regexp_replace(F.regexp_replace(text, ASSIGN, " "), ACCESS_16 + "|" + HEX_32, " ")
    words = docs.select(F.explode(F.regexp_extract_all(plain, F.lit(r"[A-Za-z0-9+/_=.-]{6,}"), F.lit(0))).alias("value")) \
        .where(F.col("value").rlike(ORDINARY))
    return rand.unionByName(words.select(F.lit(0).alias("label"), "value"))


def digest_samples(spark: SparkSession, n: int = 400) -> DataFrame:
    """Random strings in the usual key alphabets, labelled 1."""
    digest = F.sha2(F.concat(F.lit("random-"), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(digest))
    upper = F.upper(F.regexp_replace(b64, "[^A-Za-z0-9]", ""))
    return spark.range(n).select(F.explode(F.array(digest, b64, upper)).alias("value")).select(
        F.lit(1).alias("label"), "value")


def train(samples: DataFrame, alpha: float = 0.5, backoff: float = 20.0) -> list[float]:
    """log P(next | char, random) - log P(next | char, ordinary) for each pair of
    ALPHABET characters, row by row.  Pair counts back off to single characters
    (add-``alpha``) with the weight of ``backoff`` observations."""
    pos = F.sequence(F.lit(1), F.length("value") - 1)
    pairs = samples.where(F.length("value") >= 2).select(
        "label", F.explode(F.transform(pos, lambda i: F.substring(F.col("value"), i, F.lit(2)))).alias("pair"))
    counts = {(r["label"], r["pair"]): r["n"] for r in
              pairs.groupBy("label", "pair").agg(F.count("*").alias("n")).collect()}
    logs = []
    for label in (1, 0):
        c = [[counts.get((label, a + b), 0) for b in ALPHABET] for a in ALPHABET]
        single = [sum(row[j] for row in c) + alpha for j in range(len(ALPHABET))]
        total = sum(single)
        logs.append([math.log((n + backoff * single[j] / total) / (sum(row) + backoff))
                     for row in c for j, n in enumerate(row)])
    return [r - o for r, o in zip(*logs)]


def llr(token: Column, table: list[float]) -> Column:
    """Sum of the pair ratios over the token."""
    values = F.from_json(F.lit(json.dumps([round(x, 6) for x in table])), "array<double>")
    index = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = F.zip_with(index, F.slice(index, 2, F.length(token)), lambda a, b: (a - 1) * len(ALPHABET) + b)
    return F.aggregate(pairs, F.lit(0.0), lambda s, i: s + F.coalesce(F.element_at(values, i), F.lit(0.0)))


def scan(docs: DataFrame, table: list[float], min_llr: float = 12.0) -> DataFrame:
    """One row per input row: doc_id, spans = array<struct<kind, start, end>> in
    order of start, then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = base_spans(text)

    def tagged(spans: Column, rank: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"),
                                                     s["end"].alias("end"), F.lit(KINDS[rank]).alias("kind")))

    def random_like(token):
        # a number is no key, and neither is a run without any digit or capital inside
        return (F.length(token) >= MIN_TOKEN) & token.rlike("[A-Za-z]") & token.rlike("[0-9]|[a-z][A-Z]") \
            & (llr(token, table) >= min_llr)

    step = docs.select("doc_id", text.alias("text"),
                       *[tagged(base[k], i).alias(k) for i, k in enumerate(KINDS[:3])])
    fixed = F.concat("assign", "access", "hex")
    extra = F.when(F.col("text").rlike(TOKEN), tagged(matched_spans(F.col("text"), TOKEN, random_like), 3)) \
        .otherwise(tagged(empty_spans(), 3))
    step = step.select("doc_id", "assign", "access", "hex", fixed.alias("fixed"), extra.alias("found"))
    free = F.filter("found", lambda m: ~F.exists(
        F.col("fixed"), lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return step.select("doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]],
                       F.sort_array("fixed").alias("base"), F.sort_array(F.concat(F.col("fixed"), free)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str, train_docs: int = 5000, min_llr: float = 12.0) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    sample = labelled_samples(training_documents(docs, train_docs)).unionByName(digest_samples(spark))
    found = scan(docs, train(sample), min_llr)
    return found.select("doc_id", "n_assign", "n_access", "n_hex",
                        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
                        (F.size("spans") - F.size("base")).cast("bigint").alias("n_markov"))
