"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Odd base of the polynomial hash (64-bit golden ratio), fixed so that hashes of
#: different tasks agree.
HASH_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: ASCII white space: bytes.split() without arguments splits on exactly these.
WHITESPACE = b" \t\n\x0b\x0c\r"
#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a
#: space; bytes of other code points (0x80 and up) are word bytes.
NORMALISE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32
                  for b in range(256))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: rows are kept in the cluster's shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_bucket(id_col: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (null id: null)."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def null_safe_key(col: Column) -> Column:
    """A non-null text key: null and every string stay apart (joins and windows
    then treat null as one more value)."""
    return F.when(col.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), col.cast("string")))


# ---- positions of regex matches, in SQL functions only -----------------------

def matched_spans(text: Column, pattern: Column | str, keep=None, extra=None) -> Column:
    """array<struct<start bigint, end bigint, val string>> of the leftmost
    non-overlapping matches, in code points, end exclusive.

    ``split`` yields the text between matches and ``regexp_extract_all`` the
    matches; start positions are the running sum of both lengths.  ``keep`` (a
    predicate on the matched text) drops matches without copying the list, so a
    text with many rejected matches costs linear time."""
    pat = F.lit(pattern) if isinstance(pattern, str) else pattern
    parts = F.zip_with(F.split(text, pat, -1), F.regexp_extract_all(text, pat, F.lit(0)),
                       lambda g, m: F.struct(F.length(g).cast("bigint").alias("g"), m.alias("m")))
    spans_type, zero = "array<struct<start:bigint,end:bigint,val:string>>", F.lit(0).cast("bigint")

    def width(x):
        return x["g"] + F.coalesce(F.length(x["m"]), F.lit(0)).cast("bigint")

    def step(acc, x):
        m, start = x["m"], acc["pos"] + x["g"]
        ok = m.isNotNull() if keep is None else m.isNotNull() & keep(m)
        one = F.array(F.struct(start.alias("start"), (acc["pos"] + width(x)).alias("end"), m.alias("val")))
        return F.struct((acc["pos"] + width(x)).alias("pos"),
                        F.when(ok, F.concat(acc["kept"], one)).otherwise(acc["kept"]).alias("kept"))

    def block(p, pos):
        begin = F.struct(pos.alias("pos"), F.array().cast(spans_type).alias("kept"))
        return F.aggregate(p, begin, step, lambda acc: acc["kept"])

    # appending copies a list, so long lists are put together from blocks: with the
    # start of each block first
    def blocks(p):
        cuts = F.sequence(F.lit(1), F.size(p), F.lit(SPAN_BLOCK))
        sizes = F.transform(cuts, lambda i: F.aggregate(F.slice(p, i, F.lit(SPAN_BLOCK)), zero, lambda s, x: s + width(x)))
        begins = F.aggregate(sizes, F.array(zero), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return F.flatten(F.zip_with(cuts, F.slice(begins, F.lit(1), F.size(cuts)), lambda i, pos: block(
            F.slice(p, i, F.lit(SPAN_BLOCK)), pos)))

    return F.element_at(F.transform(F.array(parts), lambda p: F.when(
        F.size(p) <= SPAN_BLOCK, block(p, zero)).otherwise(blocks(p))), 1)


#: Matches that are put together at once.
SPAN_BLOCK = 256


def empty_spans() -> Column:
    return F.array().cast("array<struct<start:bigint,end:bigint,val:string>>")


# ---- vectorised hashing of byte ranges ---------------------------------------

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inv = pow(HASH_BASE, -1, 1 << 64)
        up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
        filled = 1
        while filled < size:
            m = min(filled, size - filled)
            up[filled:filled + m] = up[:m] * np.uint64(pow(HASH_BASE, filled, 1 << 64))
            down[filled:filled + m] = down[:m] * np.uint64(pow(inv, filled, 1 << 64))
            filled += m
        _POWERS["up"], _POWERS["down"] = up, down
    return _POWERS["up"], _POWERS["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: spreads the polynomial's high bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[j]-P[i] the (shifted) polynomial hash of values[i:j]; n+1 long."""
    up, _ = _powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:len(values)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each range [start, end): equal bytes, equal hash."""
    _, down = _powers(len(prefix))
    n = (end - start).astype(np.uint64)
    return mix64((prefix[end] - prefix[start]) * down[start] + n * np.uint64(0xC2B2AE3D27D4EB4F))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(WHITESPACE)] = True


def word_ranges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the maximal runs of non-white-space bytes."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.diff(np.concatenate(([True], _IS_SPACE[data], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ---- Arrow ---------------------------------------------------------------------

#: Bytes of rows that a task's Python takes up at once.
PIECE_BYTES = 2 << 20


def pieces(batches, size: int | None = None):
    """The batches' rows, in order, in batches of about ``size`` bytes.  Python objects
    and results are then held for a piece only, not for Spark's 10,000 rows."""
    size = size or PIECE_BYTES
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_bytes(batch, name: str = "text") -> list[bytes]:
    """The column's texts as bytes; null is empty.  The column is binary
    (``utf8(col)``), so no text is decoded."""
    return [b"" if x is None else x for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def utf8(col: Column) -> Column:
    return col.cast("string").cast("binary")


def grouped(batches, key: int = 0):
    """From batches sorted by a key column, one table per key; a group that is cut
    by a batch border is put together again."""
    rest = []
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        if rest and rest[-1].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip([0, *cuts[:-1]], cuts):
            yield pa.Table.from_batches([*rest, batch.slice(a, b - a)])
            rest = []
        last = cuts[-1] if len(cuts) else 0
        rest.append(batch.slice(last))
    if rest:
        yield pa.Table.from_batches(rest)
