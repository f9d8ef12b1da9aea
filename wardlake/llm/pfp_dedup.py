"""Removal of repeated substrings by prefix-free parsing.

Every byte covered by a ``min_length``-byte string that also starts earlier (in
order of doc_id, then of position) is removed, exactly.

* *Parse.*  A rolling hash over ``TRIGGER`` bytes picks triggers: the smallest hash
  within each min_length-byte window (leftmost among equals).  A trigger and the
  run of windows that chose it make one phrase; neighbouring phrases overlap by
  min_length - 1 bytes, so every window lies whole in exactly one phrase and equal
  windows choose the same trigger at the same place.
* *Dictionary.*  Phrases are gathered by trigger hash.  Of equal phrases only the
  first in corpus order stays in the dictionary; all windows of the others are
  repeats.  A dictionary phrase is contested when another one agrees with it
  around the trigger (before or after it) far enough to share a window.
* *Suffixes.*  The suffixes of contested dictionary phrases, cut to min_length
  bytes, are grouped, and within a group ordered by corpus position: all but the
  first are repeats.  Because phrases overlap by min_length - 1 bytes, the order
  of the parse beyond min_length bytes is not needed: the dictionary's truncated
  suffixes and the first positions of its phrases give the corpus order.

Groups are formed by 64-bit hashes, not by sorted bytes, as only equality
matters; a task keeps the first of equal phrases or suffixes it reads itself, so
a passage copied into a third of all documents sends one row per task, not one
per copy.  Texts are shuffled compressed, by row number.

Defined results: null is empty text; texts under min_length bytes keep all; a null
id comes after all others; rows with the same id are ordered by their place in
the input; matches never cross rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import documents, mix64, prefix_hash, range_hash, signed, text_bytes, utf8, _powers

MIN_LENGTH = 100
TRIGGER = 24
#: Window starts handled at once within a text.
PIECE = 1 << 20
#: Phrases, or suffixes, that a task compares among themselves before it sends them.
AT_ONCE = 1_500_000
_LAST = (1 << 63) - 1
#: Bits of the trigger hash that form the group; the rest hold two 14-bit marks.
MARK = 14
PHRASE = "gram bigint, phrase bigint, doc bigint, row bigint, place bigint"


def phrases_of(data: np.ndarray, min_length: int = MIN_LENGTH):
    """(start, windows, offset of the trigger, gram, phrase hash) of a text's
    phrases; gram = trigger hash (36 bits), mark after (14), mark before (14)."""
    span = min_length - TRIGGER + 1  # trigger places in a window
    before, after = span // 2 + 1, min_length - span // 2
    for at in range(0, len(data) - min_length + 1, PIECE):
        d = data[at:at + PIECE + min_length - 1]
        p = prefix_hash(d)
        n = len(d) - TRIGGER + 1
        _, down = _powers(len(p))
        key = ((p[TRIGGER:] - p[:-TRIGGER]) * down[:n]) * np.uint64(0xD6E8FEB86659FD93)
        key = (key & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
        width = 1
        while width * 2 <= span:  # smallest key of each window: by doubling
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < span:
            key = np.minimum(key[:len(key) - (span - width)], key[span - width:])
        chosen = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        lo = np.concatenate(([0], np.flatnonzero(np.diff(chosen)) + 1))
        hi = np.concatenate((lo[1:] - 1, [len(chosen) - 1]))
        t = chosen[lo]
        windows, offset = hi - lo + 1, t - lo
        phrase = range_hash(p, lo, hi + min_length) ^ mix64(
            (windows * 1024 + offset).astype(np.uint64) + np.uint64(1))
        # marks: the bytes that all windows starting near the trigger, or far before it, share
        own = mix64(phrase)
        far, near = offset >= before, t - hi < before
        mark_far = np.where(far, range_hash(p, np.where(far, t - before, lo), t + TRIGGER), own)
        mark_near = np.where(near, range_hash(p, t, np.where(near, t + after, t + 1)), own >> np.uint64(20))
        low = np.uint64((1 << MARK) - 1)
        gram = (range_hash(p, t, t + TRIGGER) & ~np.uint64((1 << 2 * MARK) - 1)) \
            | ((mark_near & low) << np.uint64(MARK)) | (mark_far & low)
        yield lo + at, windows, offset, gram, phrase


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                       utf8(F.col("text")).alias("text"))


def _first_of(keys: list[np.ndarray], order: list[np.ndarray]) -> np.ndarray:
    """Which rows come first, by ``order``, among those with equal ``keys``."""
    by = np.lexsort([*reversed(order), *reversed(keys)])
    same = np.ones(len(by), bool)
    for k in keys:
        same[1:] &= k[by][1:] == k[by][:-1]
    same[:1] = False
    first = np.empty(len(by), bool)
    first[by] = ~same
    return first


def parse(texts: DataFrame, min_length: int) -> DataFrame:
    """The phrases that a task cannot settle alone, and -- with a gram of their own
    and phrase null -- those that repeat an earlier one of the same task."""
    def run(batches):
        held: list[tuple] = []
        count = 0

        def settled():
            doc, row, lo, windows, offset, gram, phrase = (np.concatenate(c) for c in zip(*held))
            first = _first_of([gram, phrase], [doc, row, lo])
            place = (lo << 16) | (windows << 8) | offset
            spread = signed(mix64(row.astype(np.uint64) + np.uint64(7)))
            return pa.record_batch([
                pa.array(np.where(first, signed(gram), spread)), pa.array(signed(phrase), mask=~first),
                pa.array(doc), pa.array(row), pa.array(place)], names=["gram", "phrase", "doc", "row", "place"])

        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, row, text in zip(ids, rows, text_bytes(batch)):
                for lo, windows, offset, gram, phrase in phrases_of(np.frombuffer(text, np.uint8), min_length):
                    n = len(lo)
                    held.append((np.full(n, _LAST if doc is None else doc, np.int64), np.full(n, row, np.int64),
                                 lo, windows, offset, gram, phrase))
                    count += n
                if count > AT_ONCE:
                    yield settled()
                    held, count = [], 0
        if held:
            yield settled()

    return texts.mapInArrow(run, PHRASE)


def judged_phrases(texts: DataFrame, min_length: int) -> DataFrame:
    """row, place, repeat: phrases that repeat an earlier one, and contested ones."""
    group = F.shiftrightunsigned("gram", 2 * MARK)
    low = F.lit((1 << MARK) - 1)
    rows = parse(texts, min_length).withColumn("key", group).repartition("key")
    order = W.partitionBy("key", "phrase").orderBy("doc", "row", "place")
    near = W.partitionBy("key", F.shiftrightunsigned("gram", MARK).bitwiseAND(low))
    far = W.partitionBy("key", F.col("gram").bitwiseAND(low))
    judged = rows.withColumn("repeat", F.col("phrase").isNull() | (F.row_number().over(order) > 1)) \
        .withColumn("contested", F.min("phrase").over(near) != F.max("phrase").over(near)) \
        .withColumn("contested", F.col("contested") | (F.min("phrase").over(far) != F.max("phrase").over(far)))
    return judged.where(F.col("repeat") | F.col("contested")).select("row", "place", "repeat")


def packed(texts: DataFrame) -> DataFrame:
    """doc_id, row and the compressed text."""
    def run(batches):
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1),
                                   pa.array([press(x) for x in text_bytes(batch)], pa.binary())],
                                  names=["doc_id", "row", "packed"])

    return texts.mapInArrow(run, "doc_id bigint, row bigint, packed binary")


def _suffixes(min_length: int):
    """mapInArrow function: (doc_id, row, packed, places) to truncated suffixes."""
    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        held: list[tuple] = []
        count = 0

        def settled():
            doc, row, start, key = (np.concatenate(c) for c in zip(*held))
            first = _first_of([key], [doc, row, start])
            spread = signed(mix64(row.astype(np.uint64) + np.uint64(11)))
            return pa.record_batch([pa.array(np.where(first, signed(key), spread)), pa.array(~first), pa.array(doc),
                                    pa.array(row), pa.array(start)], names=["suffix", "repeat", "doc", "row", "start"])

        for batch in batches:
            for doc, row, data, places in zip(*(c.to_pylist() for c in batch.columns)):
                p = prefix_hash(np.frombuffer(unpack(data), np.uint8))
                place = np.array(places, np.int64)
                n = (place >> 8) & 255
                start = np.repeat((place >> 16) - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                held.append((np.full(len(start), _LAST if doc is None else doc, np.int64),
                             np.full(len(start), row, np.int64), start, range_hash(p, start, start + min_length)))
                count += len(start)
                if count > AT_ONCE:
                    yield settled()
                    held, count = [], 0
        if held:
            yield settled()

    return run


def _removed(min_length: int):
    """mapInArrow function: (doc_id, row, packed, places) to spans and kept bytes."""
    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            sizes, spans, kept = [], [], []
            for _doc, _row, data, places in zip(*(c.to_pylist() for c in batch.columns)):
                text = unpack(data)
                sizes.append(len(text))
                if not places:
                    spans.append([])
                    kept.append(text)
                    continue
                place = np.array(places, np.int64)
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, place >> 16, 1)
                np.add.at(edge, (place >> 16) + ((place >> 8) & 255) - 1 + min_length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                spans.append([{"start": a, "end": b} for a, b in turn.reshape(-1, 2).tolist()])
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()),
                                   pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())],
                                  names=["doc_id", "row", "n_bytes", "spans", "kept"])

    return run


def dedup(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, row, n_bytes, spans (maximal removed byte ranges), kept (bytes) of
    every row.  ``min_length`` is from 32 to 255 bytes."""
    spark = docs.sparkSession
    texts = _numbered(docs)
    path = scratch_path(spark, "pfp-phrases")
    judged_phrases(texts, min_length).write.option("compression", "zstd").parquet(path)
    judged = spark.read.schema("row bigint, place bigint, repeat boolean").parquet(path)
    whole = packed(texts)
    contested = judged.where(~F.col("repeat")).groupBy("row").agg(F.collect_list("place").alias("places"))
    suffixes = whole.join(contested, "row").select("doc_id", "row", "packed", "places").mapInArrow(
        _suffixes(min_length), "suffix bigint, repeat boolean, doc bigint, row bigint, start bigint")
    order = W.partitionBy("suffix").orderBy("doc", "row", "start")
    later = suffixes.withColumn("later", F.col("repeat") | (F.row_number().over(order) > 1)).where("later")
    gone = judged.where("repeat").select("row", "place").unionByName(
        later.select("row", F.expr("shiftleft(start, 16) + 256").alias("place")))
    places = gone.groupBy("row").agg(F.collect_list("place").alias("places"))
    return whole.join(places, "row", "left").select("doc_id", "row", "packed", "places").mapInArrow(
        _removed(min_length),
        "doc_id bigint, row bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")


def op2_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return dedup(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", length.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))

