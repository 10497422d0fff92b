"""Cross-entropy difference between matched target and background bigram models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import SALTS, fresh, n_buckets, schema_of, scratch, without
from .hashing import chunks, mix, words

DISCOUNT = 0.75
#: Words of a block of texts (of one text at least), whose n-grams are added up before they are sent.
BLOCK_WORDS = 500_000
#: The pairs that begin with one word go to so many parts of a hundred of all buckets, so that none is alone with a frequent word.
SPREAD_PERCENT = 6
#: Words are told apart by 56 bits of their hashes; pairs by their first words, 40 bits of theirs and their buckets.
WORD_BITS, PAIR_BITS = np.uint64((1 << 56) - 1), np.uint64((1 << 40) - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: What goes to a bucket of words or pairs, and what goes to a block of texts.
_ASKED = "bucket int, kind int, block long, a binary, b binary, c binary, d binary"
_TOLD = "block long, kind int, bucket int, a binary, b binary, c binary, d binary, size long, n long, t long"


def _packed(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes, as many as the largest needs."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    own = np.ascontiguousarray(values, np.uint64).view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(own.T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    own = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((own.shape[1], 8), np.uint8)
    out[:, : data[0]] = own.T
    return out.view(np.uint64).ravel()


def _steps(values: np.ndarray) -> bytes:
    """Rising numbers."""
    return _packed(np.diff(values, prepend=np.uint64(0)))


def _unsteps(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data), dtype=np.uint64)


def _several(*values: np.ndarray) -> bytes:
    return _packed(np.concatenate([v.astype(np.uint64) for v in values]))


def _unseveral(data: bytes, n: int) -> np.ndarray:
    return _unpacked(data).astype(np.int64).reshape(n, -1)


def _batch(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows of the first columns of ddl; the rest is null."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = [pa.array([r[i] if i < len(r) else None for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)]
    return pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])


def _opened(a: bytes, b: bytes, c: bytes, bits: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: its different word keys, rising, each word's number among them, the lengths of its texts, and which of these the target has."""
    ranked = _unpacked(a)
    order = np.argsort(ranked)
    number = np.zeros(len(ranked), np.int64)
    number[order] = np.arange(len(ranked))
    lens = _unpacked(c).astype(np.int64)
    return ranked[order], number[_unpacked(b).astype(np.int64)], lens >> bits, lens & ((1 << bits) - 1)


def _encode(text: str, kept: list[str], target: str, bits: int = 1):
    """Texts as blocks: word keys, the most frequent first, each word's number among them, lengths, and the other columns as they are.

    The last bits of a length tell whether the text counts for the target (or its part of it).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            held: list[tuple[np.ndarray, np.ndarray]] = []
            start = size = 0

            def block(end: int) -> pa.RecordBatch:
                nonlocal serial, start, size
                hashes, lens = (np.concatenate(x) for x in zip(*held, strict=True))
                keys, numbers, n = np.unique(hashes & WORD_BITS, return_inverse=True, return_counts=True)
                order = np.argsort(-n, kind="stable")
                rank = np.zeros(len(keys), np.uint64)
                rank[order] = np.arange(len(keys))
                rest = batch.slice(start, end - start).select(kept)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema) as out:
                    out.write_batch(rest)
                wanted = batch.column(batch.schema.get_field_index(target)).slice(start, end - start).to_numpy(zero_copy_only=False)
                made = ((part << 32) | serial, 0, 0, _packed(keys[order]), _packed(rank[numbers]), _packed((lens << bits | wanted).astype(np.uint64)), sink.getvalue().to_pybytes(), len(hashes))
                held.clear()
                serial, start, size = serial + 1, end, 0
                return _batch(_TOLD, [made])

            for chunk in chunks(batch.column(batch.schema.get_field_index(text))):
                w = words(chunk)
                held.append((w.hashes(), w.counts))
                size += len(w.doc)
                if size >= BLOCK_WORDS:
                    yield block(chunk.first + chunk.n)
            if held:
                yield block(batch.num_rows)

    return run


def _dealt(keys: np.ndarray, n: int, pairs: np.ndarray | None = None) -> list[np.ndarray]:
    """Which keys, or pairs that begin with them, go to each of n buckets, in their order."""
    bucket = mix(keys) % np.uint64(n)
    if pairs is not None:
        bucket = (bucket + pairs % np.uint64(max(1, n * SPREAD_PERCENT // 100))) % np.uint64(n)
    bucket = bucket.astype(np.int64)
    return np.split(np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket, minlength=n))[:-1])


def _pairs(keys: np.ndarray, numbers: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: keys of its different pairs, numbers of their first words, each occurrence's pair, and its second word's place."""
    doc = np.repeat(np.arange(len(lens)), lens)
    at = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    code, pair = np.unique((numbers[at - 1].astype(np.uint64) << np.uint64(32)) | numbers[at].astype(np.uint64), return_inverse=True)
    first, second = (code >> np.uint64(32)).astype(np.int64), (code & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return mix(mix(keys[first]) * _SPREAD + keys[second]), first, pair, at


def _ask(parts: int, of_pairs: bool):
    """A block's words or pairs with their counts in all its texts and in those of the target, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, a, b, c = (batch.column(k)[i].as_py() for k in range(4))
                keys, numbers, lens, target = _opened(a, b, c)
                wanted, rows = np.repeat(target, lens), []
                if of_pairs:
                    pairs, first, pair, at = _pairs(keys, numbers, lens)
                    n, t = (np.bincount(pair, w, minlength=len(pairs)) for w in (None, wanted[at]))
                    for k, own in enumerate(_dealt(keys[first], parts, pairs)):
                        heads, runs = np.unique(first[own], return_counts=True)
                        if len(own):  # first words rise in a bucket
                            rows.append((k, 0, block, _packed(pairs[own] & PAIR_BITS), _several(n[own], t[own]), _steps(keys[heads]), _several(runs)))
                else:
                    n, t = (np.bincount(numbers, w, minlength=len(keys)) for w in (None, wanted))
                    rows = [(k, 0, block, _steps(keys[own]), _several(n[own], t[own])) for k, own in enumerate(_dealt(keys, parts)) if len(own)]
                yield _batch(_ASKED, rows)

    return run


def _by_key(batches: Iterator[pa.RecordBatch], at: int, settle: Callable[[list[tuple]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """settle() for the rows of each value of the column at; rows are sorted by it."""
    held: list[tuple] = []
    for batch in batches:
        for i in range(batch.num_rows):
            row = tuple(batch.column(k)[i].as_py() for k in range(batch.num_columns))
            if held and held[-1][at] != row[at]:
                yield from settle(held)
                held = []
            held.append(row)
    if held:
        yield from settle(held)


def _count(pieces: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different keys, each key's number among them, and how often each is in the corpus and in the target."""
    keys, number = np.unique(np.concatenate(pieces), return_inverse=True)
    both = (np.bincount(number, n, minlength=len(keys)).astype(np.int64) for n in np.concatenate(counts, axis=1))
    return keys, number, *both


def _settle_pairs(parts: int):
    """Answers to blocks (counts of their pairs), and to the buckets of words: counts and numbers of pairs that follow each."""

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        heads = [np.repeat(_unsteps(r[5]), _unpacked(r[6]).astype(np.int64)) for r in rows]
        pieces = [mix(h * _SPREAD + _unpacked(r[3])) for h, r in zip(heads, rows, strict=True)]
        heads = np.concatenate(heads)
        keys, number, n, t = _count(pieces, [_unseveral(r[4], 2) for r in rows])
        one = np.zeros(len(keys), np.uint64)
        one[number] = heads
        heads, head = np.unique(one, return_inverse=True)
        sums = [np.bincount(head, x, minlength=len(heads)) for x in (n, n > 0, t, t > 0)]
        told, at = [], 0
        for r, piece in zip(rows, pieces, strict=True):
            mine = number[at : at + len(piece)]
            at += len(piece)
            told.append((r[2], 2, r[0], _several(n[mine], t[mine])))
        told += [(None, 3, k, _steps(heads[own]), _several(*(s[own] for s in sums))) for k, own in enumerate(_dealt(heads, parts)) if len(own)]
        yield _batch(_TOLD, told)

    return lambda batches: _by_key(batches, 0, settle)


def _settle_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers to blocks: of each of their words both counts, and counts and numbers of the pairs it begins; and totals."""

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        asked = [r for r in rows if r[1] == 0]
        pieces = [_unsteps(r[3]) for r in asked]
        keys, number, n, t = _count(pieces, [_unseveral(r[4], 2) for r in asked])
        sums = np.zeros((4, len(keys)), np.int64)
        for r in rows:
            if r[1] == 3:  # a key is in it once
                sums[:, np.searchsorted(keys, _unsteps(r[3]))] += _unseveral(r[4], 4)
        told, at = [(None, 4, rows[0][0], None, None, None, None, len(keys), int(n.sum()), int(t.sum()))], 0
        for r, piece in zip(asked, pieces, strict=True):
            mine = number[at : at + len(piece)]
            at += len(piece)
            told.append((r[2], 1, r[0], _several(n[mine], t[mine], *sums[:, mine])))
        yield _batch(_TOLD, told)

    return _by_key(batches, 0, settle)


def _score(parts: int, size: int, totals: tuple[int, int], schema):
    """Losses of a block's texts from the answers of all buckets."""

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        _, _, _, a, b, c, rest = rows[0][:7]
        keys, numbers, lens, _ = _opened(a, b, c)
        pairs, first, pair, at = _pairs(keys, numbers, lens)
        word, two = np.zeros((6, len(keys)), np.int64), np.zeros((2, len(pairs)), np.int64)
        for kind, table, own in ((1, word, _dealt(keys, parts)), (2, two, _dealt(keys[first], parts, pairs))):
            answers = {r[2]: r[3] for r in rows if r[1] == kind}
            for k, mine in enumerate(own):
                if len(mine):
                    table[:, mine] = _unseveral(answers[k], len(table))
        doc = np.repeat(np.arange(len(lens)), lens)
        means = []
        for k in range(2):
            count, follow = word[k], np.maximum(word[k], 1)
            back = np.maximum(1 - (word[2 + 2 * k] - DISCOUNT * word[3 + 2 * k]) / follow, 1e-9)
            p = ((count + 0.5) / (totals[k] + 0.5 * (size + 1)))[numbers]
            share = np.maximum(two[k] - DISCOUNT, 0) / follow[first]
            p[at] = share[pair] + back[numbers[at - 1]] * p[at]
            sums = np.bincount(doc, -np.log(p), minlength=len(lens))
            means.append(np.divide(sums, lens, out=np.zeros(len(lens)), where=lens > 0))
        none = lens == 0
        with pa.ipc.open_stream(rest) as stream:
            kept = stream.read_next_batch()
        columns = [*kept.columns, pa.array(lens), pa.array(means[1], mask=none), pa.array(means[0], mask=none), pa.array(means[1] - means[0], mask=none)]
        yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, out, strict=True)], schema=out)

    return lambda batches: _by_key(batches, 0, settle)


def _with_target(rows: DataFrame, labels: DataFrame, key: str, text: str, flag: str) -> DataFrame:
    """rows with the flag whether a text is trusted, by its id in key (long), which goes; of a trusted id's equal texts one has it.

    Rows without id are dealt over tasks, as no label meets them.
    """
    salt = fresh(rows, "_salt")
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias(key)).where(F.col(key).isNotNull()).distinct()
    again = rows.groupBy(key, F.xxhash64(text).alias(flag)).count().where("count > 1").join(good.hint("merge"), key)
    several = not again.isEmpty()
    good = good.select(key, F.lit(0).alias(salt), F.lit(True).alias(flag)).hint("shuffle_hash")
    dealt = rows.withColumn(salt, F.when(F.col(key).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int"))
    marked = dealt.join(good, [key, salt], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    if several:
        first = F.row_number().over(Window.partitionBy(key, salt, flag, text).orderBy(F.lit(1))) == 1
        marked = marked.where(flag).withColumn(flag, first).unionByName(marked.where(~F.col(flag)))
    return marked.drop(key, salt)


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns keep of docs (default: all), n_words, target_loss, background_loss and difference (nats a word).

    The target model is fitted on all trusted labelled texts (quality 1, not toxic), the
    background model on every text of docs; both share one vocabulary and smoothing.
    difference is target_loss - background_loss, lower for texts nearer to the target.

    Every word and pair of the corpus counts in both models.  The counts stay in buckets
    by word and by pair: blocks of texts send each of their different words and pairs
    once, with both counts, a bucket adds up all that it is sent and answers every block with what it asked.

    Defined cases: null, empty and wordless texts have n_words 0 and null losses; with no
    trusted text the target model is uniform; ids may be null or repeat (different texts with a
    trusted id all count for the target, each once); no rows give no rows; own columns with the
    names of results give way to these.
    """
    spark, parts = docs.sparkSession, n_buckets(docs)
    buckets = 2 * parts
    extra = schema_of("n_words long, target_loss double, background_loss double, difference double")
    rest = without(docs, extra.names)
    kept = [c for c in (rest.columns if keep is None else keep) if c in rest.columns]
    key, flag = fresh(docs, "_id"), fresh(docs, "_target")
    rows = docs.select(*dict.fromkeys([*kept, text]), F.col(doc_id).cast("long").alias(key))
    marked = _with_target(rows, labels, key, text, flag)

    told = schema_of(_TOLD)
    path = {k: scratch(spark, f"losses-{k}") for k in ("blocks", "pairs", "words")}
    marked.mapInArrow(_encode(text, kept, flag), told).write.parquet(path["blocks"])
    blocks = spark.read.parquet(path["blocks"])
    asked = lambda of_pairs: blocks.select("block", "a", "b", "c").mapInArrow(_ask(buckets, of_pairs), schema_of(_ASKED))
    dealt = lambda frame: frame.repartition(parts, "bucket").sortWithinPartitions("bucket")
    dealt(asked(True)).mapInArrow(_settle_pairs(buckets), told).write.parquet(path["pairs"])
    pairs = spark.read.parquet(path["pairs"])
    follow = pairs.where("kind = 3").select("bucket", "kind", "block", "a", "b", "c", "d")
    dealt(asked(False).union(follow)).mapInArrow(_settle_words, told).write.parquet(path["words"])
    answers = spark.read.parquet(path["words"])
    sums = answers.where("kind = 4").selectExpr("coalesce(sum(size), 0) as size", "coalesce(sum(n), 0) as n", "coalesce(sum(t), 0) as t").first()

    schema = type(told)([*(rest.schema[c] for c in kept), *extra])
    whole = blocks.union(pairs.where("kind = 2")).union(answers.where("kind = 1"))
    whole = whole.repartition(parts, "block").sortWithinPartitions("block", "kind")
    return whole.mapInArrow(_score(buckets, sums["size"], (sums["n"], sums["t"]), schema), schema)
