"""Words and rolling hashes of packed text columns, in numpy.

A text column of an Arrow batch is one byte buffer plus offsets.  The functions
here cut it into chunks of about a megabyte, find the words of every text of a
chunk at once and hash words and word n-grams with Rabin-Karp polynomials
modulo 2**64.  Texts are never cut: a chunk holds whole texts, and a text longer
than a megabyte is a chunk of its own.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
#: White space: the space and \x09-\x0D.  Everything else belongs to a word.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each number over all 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES), base & (2**64 - 1), np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(base, len(values)), out=out[1:])
    return out


def _between(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of the stretches [start, end)."""
    return (prefix[ends] - prefix[starts]) * _power(pow(base, -1, 1 << 64), len(prefix))[starts]


@dataclass
class Chunk:
    """Some whole texts: rows first..first+n of a batch, as bytes and offsets."""

    first: int
    buf: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """Sum of a value for each byte, by text."""
        total = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(marks, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of a string or binary column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield Chunk(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


@dataclass
class Words:
    """The words of a chunk: byte range and text number of each, and bytes' prefix hashes."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    counts: np.ndarray
    first: np.ndarray
    prefix: np.ndarray

    def hashes(self) -> np.ndarray:
        raw = _between(self.prefix, self.starts, self.ends, _BYTE_BASE)
        return mix(raw + (self.ends - self.starts).astype(np.uint64))

    def stretch_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of any byte ranges."""
        return mix(_between(self.prefix, starts, ends, _BYTE_BASE) + (ends - starts).astype(np.uint64))


def words(chunk: Chunk, table: np.ndarray = SPACE) -> Words:
    buf, offsets = chunk.buf, chunk.offsets
    gap = table[buf]
    left, right = np.ones(len(buf), bool), np.ones(len(buf), bool)
    left[1:], right[:-1] = gap[:-1], gap[1:]
    left[offsets[:-1][offsets[:-1] < len(buf)]] = True
    right[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(~gap & left)
    ends = np.flatnonzero(~gap & right) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    counts = np.bincount(doc, minlength=chunk.n)
    first = np.concatenate([[0], np.cumsum(counts)])
    return Words(starts, ends, doc, counts, first, _prefix(_BYTE_VALUE[buf], _BYTE_BASE))


def windows(word_hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all n-word windows that lie in one text, and their Rabin-Karp hashes."""
    if len(word_hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    prefix = _prefix(word_hashes, _WORD_BASE)
    return starts, mix(_between(prefix, starts, starts + n, _WORD_BASE) + np.uint64(n))


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of total words lie in a window of n words that begins at one of starts."""
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key: whether it occurs again anywhere, and whether it occurred before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order[1:]] = same
    again[order[1:]] = same
    again[order[:-1]] |= same
    return again, before
