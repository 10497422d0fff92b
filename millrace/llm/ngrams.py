"""Packing numbers, looking values up in numpy, and samples of trusted text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut
from .hashing import mix


def planes(values: np.ndarray) -> bytes:
    """Numbers as byte planes, which compress well when most high bytes are zero."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


class Lookup:
    """64-bit keys to rows of values: open addressing in arrays, read for many keys at once.

    Only keys and values are kept and sent; the table is laid out where it is first read.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.own, self.values = keys, values
        self.rows: np.ndarray | None = None

    def __reduce__(self):
        return Lookup, (self.own, self.values)

    def _lay_out(self) -> None:
        keys = self.own
        size = 1 << max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, rows = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), (mix(keys) & self.mask).astype(np.int64)
        while len(left):
            free = rows[slot] < 0
            rows[slot[free]] = left[free]  # of those that want one slot, the last stays
            lost = rows[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & int(self.mask)
        taken = rows >= 0
        self.keys[taken] = keys[rows[taken]]
        self.rows = rows

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's row, or -1."""
        if self.rows is None:
            self._lay_out()
        slot = (mix(keys) & self.mask).astype(np.int64)
        row = self.rows[slot]
        at = np.flatnonzero((row >= 0) & (self.keys[slot] != keys))
        while len(at):
            slot[at] = (slot[at] + 1) & int(self.mask)
            row[at] = self.rows[slot[at]]
            at = at[(row[at] >= 0) & (self.keys[slot[at]] != keys[at])]
        return row


def trusted_sample(
    docs: DataFrame, labels: DataFrame, max_docs: int, max_chars: int, doc_id: str = "doc_id", text: str = "text"
) -> list[int]:
    """Ids of trusted texts (quality 1, not toxic), in the order of a hash of the id, within both bounds.

    This is the one sample a model is fitted on; max_docs ids at most come to the driver.
    The size of an id is that of its different texts; an id that does not fit is passed
    over.  Trusted texts of which none fits are an error.
    """
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("_id"))
    first = good.where("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
    sizes = docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(text).alias("hash"), F.length(text).alias("size"))
    sizes = sizes.join(F.broadcast(first), "_id").distinct()
    rows = cut(sizes.groupBy("_id").agg(F.sum("size").alias("size"))).orderBy(F.xxhash64("_id"), "_id").collect()
    total, out = 0, []
    for row in rows:
        size = row["size"] or 0
        if total + size <= max_chars:
            total += size
            out.append(row["_id"])
    if rows and not out:
        raise ValueError(f"none of {len(rows)} trusted texts fits in {max_chars} characters")
    return out
