"""Alignment of two tokenizations of the same text, and how often each pair of tokens meets in a corpus.

The ends of both kinds of tokens, in bytes, cut a text into elementary intervals; each has one
token of either kind as its owner and is one overlap, and ends that both share close a group.
Neither tokenizer joins what stands on both sides of a space that follows a word, so this is done
once for every unit between such spaces that a block of texts holds.

Counts of pairs travel by block: a block sends its distinct pairs, with the number of its documents
that hold each, to buckets of the first id, of which there is a fixed number, as the two
vocabularies are fixed.  A bucket adds them up, finds the highest of each first id, and sends back
what the block has asked for.  Texts and tokens never travel, only numbers of units.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import n_buckets, schema_of, scratch, without
from .ngrams import planes
from .pieces import Numbers, Pieces, pieces, ranges, steps, units

#: Buckets of first ids; bytes of text and distinct units that make a block; counts that a bucket holds before it adds up.
BUCKETS, BLOCK_BYTES, BLOCK_UNITS, HELD_KEYS = 64, 5_000_000, 120_000, 3_000_000
#: Units that are joined to encode them, and units of documents whose pairs are laid out at a time.
STEP_TEXTS, STEP_UNITS, LONG_UNIT = 2_000, 100_000, 1_000
#: Fixed value: what a byte-level BPE cuts texts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RESULTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


class ByteTokens:
    """A byte-level BPE in a file of the tokenizers library: ids of units, and the bytes of each id.

    Units are encoded joined, many at a time, by tiktoken, which is given the file's own tokens as
    ranks; that needs ids in the order of the merges.  Its pattern matcher has a limit, so units
    beyond LONG_UNIT characters go to the tokenizers library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        file = json.loads(self.model.to_str())
        vocabulary, merges = file["model"]["vocab"], ["".join(m) for m in file["model"]["merges"]]
        byte_of = self._bytes()
        ids = [vocabulary[m] for m in merges]
        merged = set(ids)
        before, plain = file["pre_tokenizer"] or {}, file["normalizer"] is None
        if not plain or before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or ids != sorted(ids):
            raise ValueError(f"{path}: no plain byte-level BPE")
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if i in merged or len(t) == 1}
        self.fast = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        listed = {i: r for r, i in ranks.items()}
        raw = [listed.get(i, b"") for i in range(max(vocabulary.values()) + 1)]
        self.size = np.array([len(r) for r in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    @staticmethod
    def _bytes() -> dict[str, int]:
        """Byte-level characters: printable Latin-1 stands for itself, the other bytes in order for U+0100 and on."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = sorted(set(range(256)) - set(plain))
        return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}

    def encode(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, each with its space, one after another, and how many each has."""
        out, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        long = np.flatnonzero(np.fromiter(map(len, found), np.int64, len(found)) > LONG_UNIT).tolist()
        at = 0
        for stop in [*long, len(found)]:
            for low in range(at, stop, STEP_TEXTS):
                part = found[low : min(low + STEP_TEXTS, stop)]
                ids = self.fast.encode_ordinary("".join(part))
                out.append(np.fromiter(ids, np.int64, len(ids)))
                ends, until = np.cumsum(self.size[out[-1]]), np.cumsum(np.fromiter((len(u.encode()) for u in part), np.int64, len(part)))
                counts.append(np.diff(np.searchsorted(ends, until), prepend=-1))
            if stop < len(found):
                ids = self.model.encode(found[stop], add_special_tokens=False).ids
                out.append(np.array(ids, np.int64))
                counts.append(np.array([len(ids)]))
            at = stop + 1
        return np.concatenate(out), np.concatenate(counts)


@lru_cache(maxsize=2)
def byte_tokens(path: str) -> ByteTokens:
    return ByteTokens(path)


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elementary intervals of two rising arrays of ends that stop at the same place: the owner on each side, and whether it closes a group."""
    ends = _distinct(np.concatenate([ends_a, ends_b]))  # union1d
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return a, b, (ends_a[a] == ends) & (ends_b[b] == ends)


def _per(counts: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Sums of marks over stretches of the given lengths."""
    total = np.concatenate([[0], np.cumsum(marks)])
    until = np.concatenate([[0], np.cumsum(counts)])
    return total[until[1:]] - total[until[:-1]]


@dataclass
class Aligned:
    """Tokens, groups and links of some units, one after another."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    link_a: np.ndarray  # places in a and b
    link_b: np.ndarray
    closes: np.ndarray
    broken: np.ndarray  # units whose bytes one side does not give back

    def group_texts(self) -> list[bytes]:
        """The groups of each unit, as a1,a2|b1; with a semicolon behind each."""
        group = np.cumsum(self.closes) - self.closes
        group_a, group_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        group_a[self.link_a], group_b[self.link_b] = group, group
        n = int(self.closes.sum())
        in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        to_a, to_b = np.cumsum(in_a), np.cumsum(in_b)
        ids, mark = np.zeros(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        ids[np.arange(len(self.a)) + (to_b - in_b)[group_a]] = self.a
        ids[np.arange(len(self.b)) + to_a[group_b]] = self.b
        mark[to_a + to_b - in_b - 1] = ord("|")
        mark[to_a + to_b - 1] = ord(";")
        texts = [str(i).encode() for i in range(int(ids.max(initial=0)) + 1)]
        size = np.array([len(t) for t in texts], np.int64)
        start, n_ids = np.cumsum(size) - size, size[ids]
        at = np.cumsum(n_ids + 1)
        out = np.empty(int(at[-1]) if len(at) else 0, np.uint8)
        inner = np.ones(len(out), bool)
        inner[at - 1] = False
        out[at - 1] = mark
        out[inner] = np.frombuffer(b"".join(texts), np.uint8)[ranges(start[ids], n_ids)]
        data, until = out.tobytes(), np.concatenate([[0], at])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])].tolist()
        return [data[i:j] for i, j in zip(until[:-1], until[1:])]


def align_units(texts: list[str], one: ByteTokens, two: Pieces) -> Aligned:
    """Both tokenizations of each text with a space before it; a text that the bytes of one side do not make has none."""
    texts = [" " + t for t in texts]
    (a, n_a), (b, n_b) = one.encode(texts), two.encode(texts)
    raw = [t.encode() for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    whole = np.frombuffer(b"".join(raw), np.uint8)
    good = np.ones(len(texts), bool)
    for side, ids, n in ((one, a, n_a), (two, b, n_b)):
        good &= _per(n, side.size[ids]) == size
    for side, ids, n in ((one, a, n_a), (two, b, n_b)):  # of equal length: byte by byte
        own = ids[np.repeat(good, n)]
        same = side.bytes[ranges(side.start[own], side.size[own])] == whole[np.repeat(good, size)]
        good[np.flatnonzero(good)] = _per(size[good], same) == size[good]
    a, b, n_a, n_b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)], n_a * good, n_b * good
    link_a, link_b, closes = intervals(np.cumsum(one.size[a]), np.cumsum(two.size[b]))
    n_links = _per(n_a, np.bincount(link_a, minlength=len(a)))
    return Aligned(a, b, n_a, n_b, _per(n_links, closes), n_links, link_a, link_b, closes, ~good)


def _keys(found: Aligned, n_second: int) -> np.ndarray:
    """Pairs of ids of all links as numbers."""
    return found.a[found.link_a] * n_second + found.b[found.link_b]


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values, kind="stable")
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _in_buckets(keys: np.ndarray, n_second: int) -> np.ndarray:
    """The order in which a block lists its pairs: by bucket, then as numbers."""
    return np.lexsort((keys, keys // n_second % BUCKETS))


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on in as many bytes as the largest needs, as byte planes."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if numbers.max(initial=0) <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + planes(numbers.astype(kind))


def _unpack(data: bytes) -> np.ndarray:
    width = data[0]
    rows = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    return np.ascontiguousarray(rows.T).view(f"u{width}").ravel().astype(np.int64)


def _rising(numbers: np.ndarray) -> bytes:
    return _pack(np.diff(numbers, prepend=0))


def _risen(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data))


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


BLOCK = "block long, bucket int, docs binary, numbers binary, links binary, places binary, keys binary, counts binary"


def _measure(first: str, second: str, text: str, kept: list[str]):
    """Blocks of texts: one row with the documents' own results, and one for each bucket with pairs and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = byte_tokens(first), pieces(second)
        rows: list[pa.Table] = []
        numbers: list[np.ndarray] = []
        known, size = Numbers(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            names = list(known)
            found = align_units(names, one, two)
            per_unit = np.concatenate(numbers)
            table = pa.concat_tables(rows)
            n_units = table["n_units"].to_numpy()
            doc = np.repeat(np.arange(len(n_units)), n_units)
            good = _per(n_units, found.broken[per_unit]) == 0
            made = {c: _per(n_units, getattr(found, c)[per_unit]) * good for c in RESULTS[:4]}
            texts, until, digests = found.group_texts(), np.concatenate([[0], np.cumsum(n_units)]), []
            for i, ok in enumerate((good & (n_units > 0)).tolist()):
                joined = b"".join(map(texts.__getitem__, per_unit[until[i] : until[i + 1]].tolist())) if ok else b""
                digests.append(hashlib.sha256(joined[:-1]).hexdigest() if ok else "")
            pairs = _keys(found, two.n)
            keys = _distinct(pairs)
            keys = keys[_in_buckets(keys, two.n)]
            order = np.argsort(keys)
            place = order[np.searchsorted(keys, pairs, sorter=order)]
            counts = np.zeros(len(keys), np.int64)
            starts = np.cumsum(found.n_links) - found.n_links
            cuts = np.flatnonzero(np.diff(np.cumsum(n_units) // STEP_UNITS, prepend=-1))
            for low, high in zip(cuts, [*cuts[1:], len(n_units)]):  # documents hold a pair once, however often it occurs
                part = slice(until[low], until[high])
                own = _distinct(doc[part][good[doc[part]]] * len(names) + per_unit[part][good[doc[part]]])
                n = found.n_links[own % len(names)]
                own = np.repeat(own // len(names), n) * len(keys) + place[ranges(starts[own % len(names)], n)]
                counts += np.bincount(_distinct(own) % max(1, len(keys)), minlength=len(keys))
            often = np.argsort(-np.bincount(per_unit, minlength=len(names)), kind="stable")  # frequent units get small numbers
            new = np.empty(len(names), np.int64)
            new[often] = np.arange(len(names))
            for c, v in made.items():
                table = table.append_column(c, pa.array(v))
            table = table.append_column("good", pa.array(good)).append_column("groups_sha256", pa.array(digests, pa.string()))
            n_links = found.n_links[often]
            block = int.from_bytes(os.urandom(8), "big", signed=True)
            edges = np.searchsorted(keys // two.n % BUCKETS, np.arange(BUCKETS + 1))
            asked = [k for k in range(BUCKETS) if edges[k] < edges[k + 1]]
            none = [None] * len(asked)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block] * (1 + len(asked)), pa.int64()),
                    pa.array([None, *asked], pa.int32()),
                    pa.array([_ipc(table), *none], pa.binary()),
                    pa.array([_pack(new[per_unit]), *none], pa.binary()),
                    pa.array([_pack(n_links), *none], pa.binary()),
                    pa.array([_pack(place[ranges(starts[often], n_links)]), *none], pa.binary()),
                    pa.array([None, *(_rising(keys[edges[k] : edges[k + 1]]) for k in asked)], pa.binary()),
                    pa.array([None, *(_pack(counts[edges[k] : edges[k + 1]]) for k in asked)], pa.binary()),
                ],
                names=["block", "bucket", "docs", "numbers", "links", "places", "keys", "counts"],
            )
            rows.clear()
            numbers.clear()
            known.clear()

        for whole in batches:
            for batch in steps(whole, text):
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                cut = [units(t) if t else [] for t in texts]
                n_units = [len(c) for c in cut]
                numbers.append(known.of(list(chain.from_iterable(cut))))
                table = pa.table([batch.column(batch.schema.get_field_index(c)) for c in kept], names=[f"k{i}" for i in range(len(kept))])
                rows.append(table.append_column("n_units", pa.array(n_units, pa.int64())) if kept else pa.table({"n_units": pa.array(n_units, pa.int64())}))
                size += sum(len(t) for t in texts if t)
                if size >= BLOCK_BYTES or len(known) >= BLOCK_UNITS:
                    yield from flush()
                    size = 0
        if rows:
            yield from flush()

    return run


def _sums(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(all_keys, kind="stable")
    all_keys = all_keys[order]
    first = np.flatnonzero(np.concatenate([[True], all_keys[1:] != all_keys[:-1]]))
    return all_keys[first], np.add.reduceat(all_counts[order], first)


def _add_up(n_second: int | None):
    """Counts of a bucket's pairs, one bucket after another; with n_second, also which are the highest of their first id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        now = None

        def settle() -> pa.RecordBatch:
            k, n = _sums(keys, counts)
            keys.clear()
            counts.clear()
            out = {"bucket": pa.array([now], pa.int32()), "keys": pa.array([_rising(k)], pa.binary()), "counts": pa.array([_pack(n)], pa.binary())}
            if n_second:
                first = np.flatnonzero(np.diff(k // n_second, prepend=-1))
                highest = np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(k))))
                out["best"] = pa.array([np.packbits(n == highest).tobytes()], pa.binary())
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            for bucket, k, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "counts"))):
                if bucket != now and keys:
                    yield settle()
                now = bucket
                keys.append(_risen(k))
                counts.append(_unpack(n))
                if len(keys) > 1 and sum(map(len, keys)) > HELD_KEYS:
                    keys[:], counts[:] = ([x] for x in _sums(keys, counts))
        if keys:
            yield settle()

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's table, then one block's question after another: counts and best marks in the order of its keys."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["best"] is not None:
                keys, counts = _risen(row["keys"]), _unpack(row["counts"])
                best = np.unpackbits(np.frombuffer(row["best"], np.uint8), count=len(keys))
                continue
            at = np.searchsorted(keys, _risen(row["keys"]))
            out.append({"block": row["block"], "answer": {"bucket": row["bucket"], "counts": _pack(counts[at]), "best": np.packbits(best[at]).tobytes()}})
        if out:
            kind = pa.struct([("bucket", pa.int32()), ("counts", pa.binary()), ("best", pa.binary())])
            yield pa.RecordBatch.from_pylist(out, pa.schema([("block", pa.int64()), ("answer", kind)]))


def align_tokenizers(docs: DataFrame, first: str, second: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns keep of docs (default: all), n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    first is the path of a byte-level BPE of the tokenizers library, which gets each text with a space
    before it; second that of a SentencePiece BPE, which puts this space itself.  A link is a pair of token
    occurrences whose bytes overlap; a group lies between ends that both share.  The count of a
    pair of ids is the number of documents that hold it linked: n_best is the number of links
    whose count is the highest of their first id, count_sum the sum over all links.  groups_sha256
    is the digest of the groups as a1,a2|b1;a3|b2.  aligned_tokens() has the ids and groups themselves.

    Defined cases: null and empty texts, and those whose bytes one side does not give back (as with U+2581),
    have no tokens: zeros, and an empty groups_sha256; texts of any length count whole; repeated rows
    are documents of their own; no rows give none; own columns with the names of results give way to these.
    """
    spark, parts = docs.sparkSession, n_buckets(docs)
    kept = [c for c in without(docs, RESULTS).columns if keep is None or c in keep]
    path = scratch(spark, "alignment")
    rows = docs.select(*dict.fromkeys([*kept, text])).mapInArrow(_measure(first, second, text, kept), schema_of(BLOCK))
    rows.write.option("compression", "zstd").parquet(path)
    asked = spark.read.parquet(path).where("bucket is not null").select("block", "bucket", "keys", "counts")
    n_second = pieces(second).n
    salts = -(-parts // BUCKETS)
    salted = asked.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    some = salted.repartition(parts, "bucket", "salt").sortWithinPartitions("bucket", "salt").select("bucket", "keys", "counts")
    totals = some.mapInArrow(_add_up(None), schema_of("bucket int, keys binary, counts binary"))
    totals = totals.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket")
    totals = totals.mapInArrow(_add_up(n_second), schema_of("bucket int, keys binary, counts binary, best binary"))
    tables = totals.select("*", F.lit(None).cast("long").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    both = tables.unionByName(salted.drop("counts"), allowMissingColumns=True)
    both = both.repartition(parts, "bucket", "salt").sortWithinPartitions("bucket", "salt", F.col("block").asc_nulls_first())
    answers = both.select("block", "bucket", "keys", "counts", "best").mapInArrow(_answer, schema_of("block long, answer struct<bucket:int,counts:binary,best:binary>"))
    answers = answers.groupBy("block").agg(F.array_sort(F.collect_list("answer")).alias("answers"))  # BUCKETS at most
    blocks = spark.read.parquet(path).where("bucket is null").select("block", "docs", "numbers", "links", "places")
    out = schema_of("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    for c in reversed(kept):
        out = type(out)([docs.schema[c], *out])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("docs", "numbers", "links", "places", "answers")}
                table = pa.ipc.open_stream(row["docs"]).read_all()
                answers = row["answers"] or []
                parts = [_unpack(a["counts"]) for a in answers]
                counts = np.concatenate([np.zeros(0, np.int64), *parts])
                best = np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(np.frombuffer(a["best"], np.uint8), count=len(n)) for a, n in zip(answers, parts))])
                at, n_links, place = (_unpack(row[c]) for c in ("numbers", "links", "places"))
                n_units, good = table["n_units"].to_numpy(), table["good"].to_numpy()
                sums = [_per(n_units, _per(n_links, v[place].astype(np.int64))[at]) * good for v in (best, counts)]
                columns = [table[f"k{k}"] for k in range(len(kept))] + [table[c] for c in RESULTS[:4]] + [pa.array(s) for s in sums] + [table["groups_sha256"]]
                yield from pa.table([c.cast(f.type) for c, f in zip(columns, target)], schema=target).combine_chunks().to_batches()

    return blocks.join(answers, "block", "left").mapInArrow(finish, out)


def aligned_tokens(docs: DataFrame, first: str, second: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns keep of docs (default: all) and groups: the ids of both tokenizations, group by group, as a and b.

    Texts and defined cases as in align_tokenizers(); texts without tokens have no groups.
    """
    extra = schema_of("groups array<struct<a:array<int>,b:array<int>>>")
    kept = [c for c in without(docs, ["groups"]).columns if keep is None or c in keep]
    out = type(extra)([*(docs.schema[c] for c in kept), *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, one, two = to_arrow_schema(out), byte_tokens(first), pieces(second)
        side = lambda s: [int(i) for i in s.split(b",")]
        for whole in batches:
            for batch in steps(whole, text):
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                cut = [units(t) if t else [] for t in texts]
                found = align_units(list(chain.from_iterable(cut)), one, two)
                made, broken, ends = found.group_texts(), found.broken.tolist(), np.cumsum([len(c) for c in cut]).tolist()
                groups = [
                    [dict(zip("ab", map(side, g.split(b"|")))) for u in made[e - len(c) : e] for g in u[:-1].split(b";")] if not any(broken[e - len(c) : e]) else []
                    for c, e in zip(cut, ends)
                ]
                columns = [batch.column(batch.schema.get_field_index(c)) for c in kept] + [pa.array(groups, target.field("groups").type)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target)], schema=target)

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(run, out)


def group_products(aligned: DataFrame) -> DataFrame:
    """Every pair of an a and a b of one group, with the number of groups that hold it: rows of aligned_tokens() expanded."""
    groups = aligned.select(F.explode("groups").alias("g"))
    pairs = groups.select("g.b", F.explode(F.array_distinct("g.a")).alias("a")).select("a", F.explode(F.array_distinct("b")).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n_groups"))
