"""Removal of repeated token windows (exact substring dedup)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import fresh, n_buckets, schema_of, without
from .hashing import chunks, windows, words

#: Windows that a task holds before it sends them on.
FLUSH_WINDOWS = 1_500_000
LAST = np.iinfo(np.int64).max
#: kind 0: windows still to be compared (n: hashes); kind 1: found repeats (n: lengths).
PIECE = "kind byte, bucket int, n binary, ids binary, starts binary"


def n_hash_buckets(parts: int) -> int:
    """A power of two, 256 or more: the bucket is the hash's first bits, so its first byte need not be sent."""
    return 1 << max(8, (4 * parts - 1).bit_length())


def _seven_bytes(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _whole(data: bytes, bucket: int, n_buckets: int) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(-1, 7)
    out = np.full((len(rows), 8), bucket >> (n_buckets.bit_length() - 9), np.uint8)
    out[:, :7] = rows
    return out.view(np.uint64).ravel()


def _planes(values: np.ndarray) -> bytes:
    """Numbers as byte planes: planes of zeros cost nothing once the shuffle compresses them."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unplanes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _pieces(kind: int, bucket: np.ndarray, n: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket; inside, rows stay in their order, and ids are kept as differences."""
    order = np.argsort(bucket, kind="stable")
    bucket, n, ids, starts = bucket[order], n[order], ids[order], starts[order]
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    rows = list(zip(at, [*at[1:], len(bucket)], strict=True))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(at), kind, np.int8)),
            pa.array(bucket[at].astype(np.int32)),
            pa.array([_seven_bytes(n[a:b]) if kind == 0 else _planes(n[a:b]) for a, b in rows], pa.binary()),
            pa.array([_planes(np.diff(ids[a:b], prepend=np.int64(0))) for a, b in rows], pa.binary()),
            pa.array([_planes(starts[a:b].astype(np.uint32)) for a, b in rows], pa.binary()),
        ],
        names=["kind", "bucket", "n", "ids", "starts"],
    )


def _later(hashes: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows: which start after an equal one, and which are first or tie with the first."""
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    many = np.zeros(len(order), bool)
    many[1:] |= same
    many[:-1] |= same
    at = order[many]
    at = at[np.lexsort((starts[at], ids[at], hashes[at]))]
    lead = np.flatnonzero(np.diff(hashes[at].astype(np.uint64), prepend=~hashes[at[:1]] if len(at) else 0) != 0)
    lead = np.repeat(lead, np.diff(np.append(lead, len(at))))
    tie = (ids[at] == ids[at][lead]) & (starts[at] == starts[at][lead])
    later = np.zeros(len(hashes), bool)
    later[at[~tie]] = True
    return later, ~later


def _intervals(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of words, sorted by id and start and merged where they touch or overlap."""
    order = np.lexsort((starts, ids))
    ids, starts, ends = ids[order], starts[order].astype(np.int64), (starts + lengths)[order].astype(np.int64)
    new = np.ones(len(ids), bool)
    if len(ids) > 1:
        doc = np.cumsum(np.diff(ids, prepend=ids[0]) != 0)
        span = int(ends.max()) + 2
        reach = np.maximum.accumulate(doc * span + ends)
        new[1:] = (doc * span + starts)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return ids[at], starts[at], np.maximum.reduceat(ends, at) if len(at) else ends


def _windows_of(n_words: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            hashes, ids, starts = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if np.any(ids[1:] < ids[:-1]):
                order = np.argsort(ids, kind="stable")
                hashes, ids, starts = hashes[order], ids[order], starts[order]
            later, first = _later(hashes, ids, starts)
            if later.any():
                a, b, c = _intervals(ids[later], starts[later], np.int64(n_words))
                yield _pieces(1, (a.view(np.uint64) % np.uint64(n_buckets)).astype(np.int64), (c - b).astype(np.uint32), a, b)
            hashes = hashes[first]
            yield _pieces(0, (hashes >> np.uint64(65 - n_buckets.bit_length())).astype(np.int64), hashes, ids[first], starts[first])

        size = 0
        for batch in batches:
            ids_of = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
            for chunk in chunks(batch.column(1)):
                w = words(chunk)
                at, hashes = windows(w.hashes(), w.doc, n_words)
                held.append((hashes, ids_of[chunk.first + w.doc[at]], (at - w.first[w.doc[at]]).astype(np.uint32)))
                size += len(at)
                if size >= FLUSH_WINDOWS:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    return run


def _compare(n_words: int, n_buckets: int):
    """Windows of one bucket after another; found repeats go on, packed by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        size, now = 0, -1

        def settle() -> None:
            hashes, ids, starts = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            later, _ = _later(hashes, ids, starts)
            found.append((ids[later], starts[later]))

        def send() -> Iterator[pa.RecordBatch]:
            ids, starts = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            if len(ids):
                a, b, c = _intervals(ids, starts, np.int64(n_words))
                yield _pieces(1, (a.view(np.uint64) % np.uint64(n_buckets)).astype(np.int64), (c - b).astype(np.uint32), a, b)

        for batch in batches:
            kinds, buckets = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            passed = pa.array(kinds == 1)
            if passed.true_count:
                yield batch.filter(passed)
            for i in np.flatnonzero(kinds == 0):
                if buckets[i] != now and held:
                    size += sum(len(x[0]) for x in held)
                    settle()
                    if size >= FLUSH_WINDOWS:
                        yield from send()
                        size = 0
                now = buckets[i]
                hashes = _whole(batch.column(2)[i].as_py(), int(now), n_buckets)
                ids = np.cumsum(_unplanes(batch.column(3)[i].as_py(), np.int64))
                held.append((hashes, ids, _unplanes(batch.column(4)[i].as_py(), np.uint32)))
        if held:
            settle()
        if found:
            yield from send()

    return run


def _per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces, by bucket, as a row for each document: its maximal removal intervals."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    now = -1

    def settle() -> pa.RecordBatch:
        ids, starts, ends = _intervals(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        at = np.flatnonzero(np.diff(ids, prepend=ids[0]) != 0)
        at = np.concatenate([[0], at])
        rows = pa.ListArray.from_arrays(
            pa.array(np.append(at, len(ids)).astype(np.int32)), pa.StructArray.from_arrays(
                [pa.array(starts), pa.array(ends)], names=["start", "end"]
            )
        )
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), rows], names=["order_id", "removed"])

    for batch in batches:
        buckets = batch.column(1).to_numpy()
        for i in range(batch.num_rows):
            if buckets[i] != now and held:
                yield settle()
            now = buckets[i]
            ids = np.cumsum(_unplanes(batch.column(3)[i].as_py(), np.int64))
            lengths = _unplanes(batch.column(2)[i].as_py(), np.uint32)
            held.append((ids, _unplanes(batch.column(4)[i].as_py(), np.uint32), lengths))
    if held:
        yield settle()


def repeated_intervals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_words: int = 20) -> DataFrame:
    """Documents with repeated windows: order_id (null id: the largest long), removed (word intervals).

    Every window of n_words words is hashed (64-bit Rabin-Karp over word hashes).
    A task first settles repeats among its own windows, so a window that any number
    of documents share leaves it once; the rest goes, packed, to the bucket of its
    hash, where equal windows meet and all but the first become removal intervals.
    """
    parts = n_buckets(docs)
    buckets = n_hash_buckets(parts)
    pieces = docs.select(F.col(doc_id).cast("long"), text).mapInArrow(_windows_of(n_words, buckets), schema_of(PIECE))
    pieces = pieces.repartition(parts, "bucket").sortWithinPartitions("bucket")
    pieces = pieces.mapInArrow(_compare(n_words, buckets), schema_of(PIECE))
    pieces = pieces.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return pieces.mapInArrow(_per_document, schema_of("order_id long, removed array<struct<start:long,end:long>>"))


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_words: int = 20, keep: list[str] | None = None
) -> DataFrame:
    """Columns keep of docs (default: all), n_words, n_removed, kept_text and kept_sha256.

    A word goes if a window of n_words words covers it whose words also start earlier:
    in a document of smaller id, or earlier in the same one.  Windows are judged on the
    input.  kept_text is the remaining words joined by one space.

    Defined cases: null and empty texts have no words (kept_text is empty); null ids
    come after all others and count as one document; rows that repeat an id count as
    one document too, of which words at the same positions go; of windows that tie on
    id and start none goes because of the other; own columns with the names of results
    give way to these.  Hashes have 64 bits: among n windows about n*n/2**65 pairs
    of different windows are taken as equal (0.0005 for 130 million windows).
    """
    found = repeated_intervals(docs, doc_id, text, n_words)
    rest = without(docs, ["n_words", "n_removed", "kept_text", "kept_sha256"])
    own, gone = fresh(docs, "order_id"), fresh(docs, "removed")
    found = found.select(F.col("order_id").alias(own), F.col("removed").alias(gone))
    names = [c for c in rest.columns if keep is None or c in keep]
    wide = rest.select(*dict.fromkeys([*names, text]), F.coalesce(F.col(doc_id).cast("long"), F.lit(int(LAST))).alias(own))
    joined = wide.join(found, own, "left").drop(own)
    ddl = "n_words long, n_removed long, kept_text string, kept_sha256 string"
    schema = schema_of(ddl)
    for c in reversed(names):
        schema.fields.insert(0, rest.schema[c])
        schema.names.insert(0, c)
    has_text = keep is None or "kept_text" in keep
    if not has_text:
        schema = type(schema)([f for f in schema if f.name != "kept_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            made: dict[str, list] = {"n_words": [], "n_removed": [], "kept_text": [], "kept_sha256": []}
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
            removed = batch.column(batch.schema.get_field_index(gone))
            for raw, spans in zip(texts, removed, strict=True):
                all_words = (raw.as_py() or b"").split()
                kept = all_words
                if spans.is_valid:
                    kept, at = [], 0
                    for span in spans.as_py():
                        kept += all_words[at : span["start"]]
                        at = max(at, span["end"])
                    kept += all_words[at:]
                joined_words = b" ".join(kept)
                made["n_words"].append(len(all_words))
                made["n_removed"].append(len(all_words) - len(kept))
                made["kept_sha256"].append(hashlib.sha256(joined_words).hexdigest())
                if has_text:
                    made["kept_text"].append(joined_words.decode())
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            columns += [pa.array(made[f.name], f.type) for f in out if f.name in made and f.name not in names]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return joined.mapInArrow(run, schema)


