"""SentencePiece BPE in numpy: vectorised merge rounds over flat symbol arrays, and decoding by gathers.

A text is cut before each space that follows a word; such units recur, so each is
encoded once for a run of texts.  Units are cut further, between characters that stand
side by side in no piece, into segments.  Round after round every segment finds the
best rank among its adjacent pairs, all pairs of that rank merge from left to right, and
the arrays are compacted, until no pair is left.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import schema_of
from .ngrams import Lookup

SPACE = "▁"
#: Symbols of a segment beyond which pairs are taken from a heap: rounds over it would be too many.
LONG = 256
#: Units (and their characters) that a task remembers before it starts anew, and bytes of text taken in one go.
MOST_UNITS, MOST_CHARS, STEP_BYTES = 300_000, 6_000_000, 4_000_000
UNIT = re.compile(r" (?<=[^\s▁] )")
_NONE = np.iinfo(np.int32).max


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, count numbers, one after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def units(text: str) -> list[str]:
    """The text cut at each space that follows something else than white space (or U+2581, which stands for it); those spaces are left out."""
    return UNIT.split(text)


class Pieces:
    """The vocabulary as tables: characters and pairs to symbols, their ranks, and the bytes of each id.

    A symbol is the id of a piece, or a number from n on for characters that only occur inside
    pieces.  Models that normalise texts, or that own pieces of a user or a space after a
    character, would be read wrongly and are refused.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n, self.end = model.vocab_size(), model.eos_id()
        names = [model.id_to_piece(i) for i in range(self.n)]
        special = [model.is_control(i) or model.is_unknown(i) for i in range(self.n)]
        byte = [model.is_byte(i) for i in range(self.n)]
        if model.normalize(" a  ﬁ ") != "▁▁a▁▁ﬁ▁" or any(model.is_unused(i) for i in range(self.n)) or sum(byte) != 256:
            raise ValueError(f"{path}: texts are normalised, pieces are unused or bytes are lacking")
        own = {p: i for i, p in reversed(list(enumerate(names))) if not special[i] and not byte[i]}
        if any(SPACE in p.lstrip(SPACE) for p in own):
            raise ValueError(f"{path}: a piece has a space behind other characters")
        self.byte_id = np.zeros(256, np.int64)
        for i in np.flatnonzero(byte):
            self.byte_id[int(names[i][3:-1], 16)] = i
        known = own | {c: self.n + k for k, c in enumerate(sorted({c for p in own for c in p} - own.keys()))}
        self.m = len(known) + self.n
        scores = np.full(self.m, np.inf)
        scores[list(own.values())] = [model.get_score(i) for i in own.values()]
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.char = np.full(0x110000, -1, np.int32)
        for c, s in known.items():
            if len(c) == 1:
                self.char[ord(c)] = s
        pairs = {(known[p[:k]], known[p[k:]]): i for p, i in own.items() for k in range(1, len(p)) if p[:k] in known and p[k:] in known}
        both = np.array(list(pairs), np.int64)
        self.made = np.array(list(pairs.values()), np.int64)
        self.pairs = Lookup(self._key(both[:, 0], both[:, 1]), self.made)
        beside = np.array(sorted({(known[a], known[b]) for p in own for a, b in zip(p, p[1:])}), np.int64)
        self.beside = Lookup(self._key(beside[:, 0], beside[:, 1]), np.zeros(0))
        #: Symbols that join a neighbour no later than they were made: equal ones must not merge at once.
        early = self.rank[self.made][:, None] <= self.rank[both]
        self.early = np.zeros(self.m, bool)
        self.early[both[early]] = True
        raw = [b"" if s else bytes([int(p[3:-1], 16)]) if b else p.replace(SPACE, " ").encode() for p, s, b in zip(names, special, byte)]
        raw[model.unk_id()] = model.decode([model.unk_id()]).encode()
        self.size = np.array([len(r) for r in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        #: Pieces that lose their space at the head of a text, and control ids, which say nothing.
        self.spaced = np.array([p.startswith(SPACE) and not s for p, s in zip(names, special)])
        self.control = np.array([model.is_control(i) for i in range(self.n)])

    def _key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.int64) * (self.m + 1) + b).astype(np.uint64)

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The symbol that each pair makes, or -1."""
        row = self.pairs.find(self._key(a, b))
        return np.where(row >= 0, self.made[row], -1)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has.  Spaces stand for themselves: nothing is put before a text."""
        points = np.frombuffer("".join(texts).replace(" ", SPACE).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        symbols = self.char[points]
        done = symbols.copy()  # at the first character of each symbol: the symbol; -2 inside one
        first = np.zeros(len(points) + 1, bool)
        first[0] = True
        first[np.cumsum(lengths)] = True
        if len(points):
            first[1:-1] |= (symbols[1:] < 0) | (symbols[:-1] < 0) | (self.beside.find(self._key(symbols[:-1], symbols[1:])) < 0)
        edges = np.flatnonzero(first)
        sizes = np.diff(edges)
        for k in np.flatnonzero(sizes > LONG):
            done[edges[k] : edges[k + 1]] = self._by_heap(symbols[edges[k] : edges[k + 1]])
        some = np.flatnonzero((sizes > 1) & (sizes <= LONG))
        at = ranges(edges[some], sizes[some])
        self._rounds(symbols[at].astype(np.int64), at, sizes[some], done)
        kept = np.flatnonzero(done != -2)
        ids = done[kept].astype(np.int64)
        plain = (ids >= 0) & (ids < self.n)
        raw = points[kept]
        n_bytes = np.where(plain, 1, 1 + (raw > 0x7F) + (raw > 0x7FF) + (raw > 0xFFFF))
        out = np.repeat(ids, n_bytes)
        odd = np.flatnonzero(~plain)
        if len(odd):  # characters without a piece: their bytes
            data = np.frombuffer("".join(map(chr, raw[odd])).encode(), np.uint8)
            out[ranges((np.cumsum(n_bytes) - n_bytes)[odd], n_bytes[odd])] = self.byte_id[data]
        until = np.concatenate([[0], np.cumsum(n_bytes)])[np.searchsorted(kept, np.concatenate([[0], np.cumsum(lengths)]))]
        return out, np.diff(until)

    def _rounds(self, sym: np.ndarray, at: np.ndarray, sizes: np.ndarray, done: np.ndarray) -> None:
        """Merge rounds over segments of the given sizes; what is settled goes to done at the place of its first character."""
        ends = np.cumsum(sizes)
        last = np.zeros(len(sym), bool)  # of its segment
        last[ends - 1] = True
        made, rank = np.full(len(sym), -1, np.int64), np.full(len(sym), _NONE, np.int32)
        fresh = np.flatnonzero(~last)
        while len(sym):
            made[fresh] = self._merged(sym[fresh], sym[fresh + 1])
            rank[fresh] = np.where(made[fresh] >= 0, self.rank[made[fresh]], _NONE)
            starts = np.flatnonzero(np.concatenate([[True], last[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            open_ = best < _NONE
            if not open_.all():  # compaction: segments without a pair leave
                stay = np.repeat(open_, sizes)
                done[at[~stay]] = sym[~stay]
                sym, at, last, made, rank = (x[stay] for x in (sym, at, last, made, rank))
                best, sizes = best[open_], sizes[open_]
                if not len(sym):
                    return
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            follows = np.diff(hit, prepend=-2) == 1  # shares a symbol with the hit before it
            head = np.flatnonzero(~follows)
            turn = np.arange(len(hit)) - np.repeat(head, np.diff(np.append(head, len(hit))))
            hit = hit[turn % 2 == 0]
            if (early := self.early[made[hit]]).any():  # of such only the first in its segment
                segment = np.searchsorted(np.cumsum(sizes), hit, side="right")
                hit = hit[~early | (np.diff(segment, prepend=-1) != 0)]
            sym[hit] = made[hit]
            last[hit] = last[hit + 1]
            done[at[hit + 1]] = -2
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            sym, at, last, made, rank = (x[stay] for x in (sym, at, last, made, rank))
            new = hit - np.arange(len(hit))
            touched = np.zeros(len(sym), bool)
            touched[new] = touched[new[new > 0] - 1] = True
            fresh = np.flatnonzero(touched)
            closed = last[fresh]
            made[fresh[closed]], rank[fresh[closed]] = -1, _NONE
            fresh = fresh[~closed]

    def _by_heap(self, symbols: np.ndarray) -> np.ndarray:
        """One long segment, the best pair after another."""
        sym = symbols.tolist()
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        found: dict[tuple[int, int], int] = {}

        def pair(a: int, b: int) -> int:
            if (a, b) not in found:
                found[a, b] = int(self._merged(np.array([a]), np.array([b]))[0])
            return found[a, b]

        queue = []

        def add(i: int, j: int) -> None:
            if i >= 0 and j < n and (p := pair(sym[i], sym[j])) >= 0:
                heapq.heappush(queue, (int(self.rank[p]), i, sym[i], sym[j], p))

        for i in range(n - 1):
            add(i, i + 1)
        while queue:
            _, i, a, b, p = heapq.heappop(queue)
            j = right[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = p, -2
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            add(left[i], i)
            add(i, right[i])
        return np.array(sym, np.int32)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts one after another, and how many each has; the space that encoding puts first is taken off."""
        sizes = self.size[ids]
        starts = self.start[ids]
        until = np.concatenate([[0], np.cumsum(counts)])
        says = np.concatenate([[0], np.cumsum(~self.control[ids])])
        # the first id of each text that is no control id
        lead = np.searchsorted(says, says[until[:-1]], side="right") - 1
        lead = lead[(lead < until[1:]) & (lead >= until[:-1])]
        lead = lead[self.spaced[ids[lead]]]
        starts[lead] += 1
        sizes[lead] -= 1
        total = np.concatenate([[0], np.cumsum(sizes)])
        return self.bytes[ranges(starts, sizes)], np.diff(total[until])


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _valid(data: bytes) -> str:
    """UTF-8 as text; each byte that belongs to no character becomes U+FFFD."""
    out = []
    while True:
        try:
            return "".join([*out, data.decode()])
        except UnicodeDecodeError as e:
            out += [data[: e.start].decode(), "�"]
            data = data[e.start + 1 :]


def decode(ids: list[list[int]], path: str) -> list[str]:
    """The text of each list of ids, as the library's decode() has it."""
    flat = np.array([i for one in ids for i in one], np.int64)
    data, sizes = pieces(path).decode(flat, np.array([len(one) for one in ids], np.int64))
    ends = np.cumsum(sizes)
    return [_valid(data[e - n : e].tobytes()) for e, n in zip(ends.tolist(), sizes.tolist())]


class Numbers(dict):
    """Numbers from 0 on for whatever is asked, in the order of the first asking."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n

    def of(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))


class Memory:
    """Units that were encoded before, with their ids in one growing array."""

    def __init__(self, path: str):
        self.of, self.path = pieces(path), path
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()
        self.chars = 0
        self.ids, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with a space put before each that is not empty, and how many each has."""
        if len(self.number) > MOST_UNITS or self.chars > MOST_CHARS:
            self.forget()
        cut = [units(t) if t else [] for t in texts]
        per_text = np.fromiter(map(len, cut), np.int64, len(cut))
        had = len(self.number)
        at = self.number.of(list(chain.from_iterable(cut)))
        if len(self.number) > had:
            new = list(islice(reversed(self.number), len(self.number) - had))[::-1]
            ids, counts = self.of.encode([" " + u for u in new])
            self.chars += sum(map(len, new))
            self.ids, self.counts = np.concatenate([self.ids, ids.astype(np.int32)]), np.concatenate([self.counts, counts])
            self.starts = np.cumsum(self.counts) - self.counts
        n = self.counts[at]
        total = np.concatenate([[0], np.cumsum(n)])
        out = self.ids[ranges(self.starts[at], n)] if len(at) else self.ids[:0]
        return out, np.diff(total[np.concatenate([[0], np.cumsum(per_text)])])


def steps(batch: pa.RecordBatch, text: str, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts make about size bytes, one row at least."""
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
    total = np.cumsum([x or 0 for x in pa.compute.binary_length(column).to_pylist()])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def encode_pieces(docs: DataFrame, model: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns keep of docs (default: all), ids (array of int, an end id last) and decoded (the text of these ids).

    model is the path of a SentencePiece BPE file with byte fallback, which every worker can read.
    Ids are those of the library without sampling; decoded differs from the text only where that
    holds U+2581, which stands for a space.

    Defined cases: null and empty texts have the end id only, and decode to the empty text; a text
    of any length is encoded whole; repeated rows stay; no rows give none; own columns with the
    names of results give way to these.
    """
    import pyarrow.compute  # noqa: F401

    extra = schema_of("ids array<int>, decoded string")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {f.name for f in extra}]
    df = docs.select(*dict.fromkeys([*kept, text]))
    schema = type(extra)([*(df.schema[c] for c in kept), *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, known = to_arrow_schema(schema), Memory(model)
        for whole in batches:
            for batch in steps(whole, text):
                texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
                ids, counts = known.encode(texts)
                ends = np.cumsum(counts + 1)
                closed = np.full(int(ends[-1]), known.of.end, np.int32)
                inner = np.ones(len(closed), bool)
                inner[ends - 1] = False
                closed[inner] = ids
                data, sizes = known.of.decode(closed, counts + 1)
                offsets = [np.concatenate([[0], x]).astype(np.int32) for x in (ends, np.cumsum(sizes))]
                columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                columns += [
                    pa.ListArray.from_arrays(pa.array(offsets[0]), pa.array(closed)),
                    pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets[1]), pa.py_buffer(np.ascontiguousarray(data))),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)

    return df.mapInArrow(run, schema)
