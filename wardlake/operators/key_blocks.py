"""Blocks of key numbers for several writers at once.

A shared folder holds one file per reservation, named by its place in the sequence
(``slot=000000000007``).  Whoever creates a file first owns the place; creating a file
that exists fails, which the file system guarantees.  A block starts where the block
before ends, so numbers are dense and no number is in two blocks.  A slot names its
batch, so a batch that is written again finds the block it had.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import SparkSession

from ..streaming import batches

_SLOT = "slot="
#: Seconds to wait for a slot whose writer has created but not yet filled it.
PATIENCE = 60.0


def _create(spark: SparkSession, path: str, content: bytes) -> bool:
    """Create a file; False when it exists already."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        # Hadoop's local file system looks first and creates then; the kernel does both at once
        try:
            fd = os.open(url.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            return False
        with os.fdopen(fd, "wb") as f:
            f.write(content)
        return True
    fs, p = batches._fs(spark, path)
    try:
        out = fs.create(p, False)
    except Exception as e:  # noqa: BLE001 - py4j wraps the file system's error
        if "AlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(content))
    out.close()
    return True


def _slot(spark: SparkSession, path: str) -> dict:
    """Content of a slot; waits while it is being filled."""
    until = time.monotonic() + PATIENCE
    while True:
        content = batches.get(spark, path)
        if content.endswith(b"\n"):
            return json.loads(content)
        if time.monotonic() > until:
            raise RuntimeError(f"{path} was begun but never filled; if its writer is gone, remove it")
        time.sleep(0.05)


def reserve(spark: SparkSession, folder: str, batch_id: str, size: int, highest: Callable[[], int]) -> int:
    """First number of a block of ``size`` numbers for ``batch_id``.  ``highest`` tells
    the greatest number that is in use before the first reservation."""
    folder = folder.rstrip("/")
    fs, p = batches._fs(spark, folder)
    fs.mkdirs(p)
    next_start, place, seen = None, 0, 0
    while True:
        for path in batches.matching(spark, f"{folder}/{_SLOT}*")[seen:]:
            slot = _slot(spark, path)
            if slot["batch"] == batch_id:
                if slot["size"] != size:
                    raise ValueError(f"batch {batch_id} had {slot['size']} rows when its block was reserved, now {size}")
                return slot["start"]
            next_start, place, seen = slot["start"] + slot["size"], place + 1, seen + 1
        start = next_start if next_start is not None else int(highest()) + 1
        content = json.dumps({"batch": batch_id, "start": start, "size": size}) + "\n"
        if _create(spark, f"{folder}/{_SLOT}{place:012d}", content.encode()):
            return start
