"""Best-fit packing into sequences of several permitted lengths."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import cut, n_buckets, schema_of

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: A sequence costs its capacity, this much whatever its length, and for attention capacity**2 / ATTENTION_LENGTH.
SEQUENCE_COST, ATTENTION_LENGTH = 16, 65_536
#: Tokens that one task packs at a time; pieces of a shard share bins with each other only.
SHARD_TOKENS = 8_000_000
PACKED = "doc_id long, segment int, start long, n_tokens long, bin_id long, bin_offset long, bin_used long, bin_capacity long"
WORD = r"[^\x20\x09-\x0D]+"


def sequence_cost(capacity: int) -> float:
    return capacity + SEQUENCE_COST + capacity * capacity / ATTENTION_LENGTH


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = sequence_cost):
    """Bin, offset in it, and each bin's use and capacity, for lengths that do not rise.

    A length goes to the open bin that it leaves the least room in.  If none has room, a
    bin opens whose capacity costs least for each token that it can hope to hold: the
    length itself and as much of the rest as is short enough for the room left.  In the
    end each bin shrinks to the least permitted capacity that holds its contents.
    """
    sizes = np.array(sorted(capacities))
    costs = np.array([cost(c) for c in sizes.tolist()])
    top = int(sizes[-1])
    rest = np.bincount(lengths, minlength=top + 1) * np.arange(top + 1)
    rooms: list[list[int]] = [[] for _ in range(top + 1)]
    mask = 0  # bit r: a bin with room r is open
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []
    for i, n in enumerate(lengths.tolist()):
        rest[n] -= n
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
            room -= n
        else:
            fit = sizes[sizes >= n]
            hope = np.array([min(c - n, rest[: c - n + 1].sum()) for c in fit.tolist()])
            room = int(fit[np.argmin(costs[sizes >= n] / (n + hope))]) - n
            b = len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if room:
            rooms[room].append(b)
            mask |= 1 << room
    use = np.array(used, np.int64)
    return bins, offsets, use, sizes[np.searchsorted(sizes, use)]


def _pack_shards(capacities: tuple[int, ...], cost):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            held.clear()
            bins, offsets, use, cap = pack(rows["n_tokens"].to_numpy(), capacities, cost)
            ids = (rows["shard"][0].as_py() << 32) + bins
            made = {"bin_id": ids, "bin_offset": offsets, "bin_used": use[bins], "bin_capacity": cap[bins]}
            rows = rows.drop(["shard"])
            for name, values in made.items():
                rows = rows.append_column(name, pa.array(values.astype(np.int64)))
            return rows.combine_chunks().to_batches()[0]

        for batch in batches:
            shard = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if held and held[-1].column(0)[0].as_py() != shard[a]:
                    yield settle()
                held.append(batch.slice(a, b - a))
        if held:
            yield settle()

    return run


def best_fit_packing(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    n_tokens: Column | None = None,
    capacities: tuple[int, ...] = CAPACITIES,
    cost: Callable[[int], float] = sequence_cost,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """A row for each piece of a document: where it starts, its length, its bin and place there.

    n_tokens counts the tokens of a row (default: its words).  Documents longer than the
    largest capacity are cut into pieces of that size and a rest.  Rows are dealt
    by hash of id and place, so that rows of one id spread, into shards of about shard_tokens tokens, each packed alone, so the loss
    against one packing of everything is a few part-filled bins a shard.

    Defined cases: null, empty and wordless texts are one piece of no tokens with null
    bin columns; repeated rows are packed each; null ids are ids like others; ties in length go by
    id; a text of any length is cut, never dropped; no rows give no rows; columns other than the two
    named are not looked at, whatever their names.
    """
    if n_tokens is None:
        n_tokens = F.regexp_count(F.col(text), F.lit(WORD))
    sized = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(n_tokens, F.lit(0)).cast("long").alias("n")))
    total = sized.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    top = max(capacities)
    pieces = sized.where("n > 0").select(
        F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(shards)).alias("shard"), "doc_id", "n",  # rows are fixed by now
        F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / top).cast("int"))).alias("segment"),
    )
    start = F.col("segment").cast("long") * top
    pieces = pieces.select("shard", "doc_id", "segment", start.alias("start"), F.least(F.lit(top), F.col("n") - start).alias("n_tokens"))
    parts = min(shards, n_buckets(docs))
    packed = (
        pieces.repartition(parts, "shard")
        .sortWithinPartitions("shard", F.desc("n_tokens"), "doc_id", "segment")
        .mapInArrow(_pack_shards(tuple(capacities), cost), schema_of(PACKED))
    )
    empty = sized.where("n = 0").selectExpr(
        "doc_id", "0 as segment", "0L as start", "0L as n_tokens", *(f"cast(null as long) as {c}" for c in ("bin_id", "bin_offset", "bin_used", "bin_capacity"))
    )
    return packed.unionByName(empty)
