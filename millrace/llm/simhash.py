"""SimHash fingerprints and their near-duplicates through BK-trees."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .frames import cut, n_buckets, schema_of, spread_join, with_text_columns
from .hashing import Chunk, chunks, mix, windows, words

SEED = 42
#: Query-node pairs that a task looks at in one go, and those whose fingerprints it lays side by side (wide ones take 64 bytes each).
STEP_PAIRS, STEP_SIDES = 200_000, 20_000
#: Bytes of text that near_copies() takes in one go: a byte takes up to a hundred in arrays.
STEP_BYTES = 1 << 18
#: Bits of wide fingerprints, and by how many standard deviations their distance may lie above its mean for texts at the limit.
WIDE_BITS, SLACK = 512, 3.5
#: MinHash values of a text: BANDS keys of BAND_ROWS values each; texts that share a key meet in one shard.
BANDS, BAND_ROWS = 20, 6
#: Shingles whose bits are added up at a time: their counts fit in 16 bits.
STEP_SHINGLES = 60_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: The bits of a byte as eight numbers of 16 bits.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.uint16).view(np.uint64)


def fingerprint(raw: bytes | None, n_words: int = 3) -> int:
    """Bit i is 1 if over half of the shingles' XXH64 have it; no words: zero."""
    words = (raw or b"").lower().split()
    if not words:
        return 0
    if len(words) <= n_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(n_words)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], ">u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def with_fingerprints(
    docs: DataFrame, text: str = "text", n_words: int = 3, keep: list[str] | None = None, name: str = "fp"
) -> DataFrame:
    """Columns keep of docs (default: all) and the fingerprint as a signed long."""

    def run(column: pa.Array) -> dict[str, object]:
        values = [fingerprint(x.as_py(), n_words) for x in column.cast(pa.large_binary())]
        return {name: np.array(values, np.uint64).view(np.int64)}

    return with_text_columns(docs, text, f"{name} long", run, keep)


def shingle_hashes(chunk: Chunk, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all shingles of a chunk, sorted by text; a text of fewer words is one shingle, one without words has none."""
    w = words(Chunk(chunk.first, _LOWER[chunk.buf], chunk.offsets))
    hashes = w.hashes()
    starts, keys = windows(hashes, w.doc, n_words)
    parts = [(w.doc[starts], keys)]
    for n in np.unique(w.counts[(w.counts > 0) & (w.counts < n_words)]).tolist():
        starts, keys = windows(hashes, w.doc, n)
        whole = w.counts[w.doc[starts]] == n
        parts.append((w.doc[starts][whole], keys[whole]))
    doc, keys = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(doc, kind="stable")
    return doc[order], keys[order]


def wide_fingerprints(column: pa.Array, n_words: int, bits: int) -> np.ndarray:
    """A row of bits for each text, as 64-bit numbers: 1 where over half of its shingles' hashes have it; no words: zero."""
    out = [wide_bits(*shingle_hashes(chunk, n_words), chunk.n, bits) for chunk in chunks(column)]
    return np.concatenate(out) if out else np.zeros((0, bits // 64), np.uint64)


def wide_bits(doc: np.ndarray, keys: np.ndarray, n: int, bits: int) -> np.ndarray:
    total = np.bincount(doc, minlength=n)
    made = np.zeros((n, bits // 64), np.uint64)
    for k in range(bits // 64):
        spread = mix(keys + np.uint64((k + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        counts = np.zeros((n, 64), np.int64)
        for at in range(0, len(keys), STEP_SHINGLES):
            own = doc[at : at + STEP_SHINGLES]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            lanes = _LANES[spread[at : at + STEP_SHINGLES].view(np.uint8).reshape(-1, 8)].reshape(len(own), -1)
            counts[own[first]] += np.add.reduceat(lanes, first, axis=0).view(np.uint16)
        made[:, k] = np.packbits(2 * counts > total[:, None], axis=1).view(np.uint64).ravel()
    return made


def minhash_bands(doc: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """BANDS keys for each text: hashes of BAND_ROWS minima in a row, of one permutation in bins.

    An empty bin takes the minimum of another of its text's, chosen by the number of the bin and of the
    attempt alone, so that two texts agree in a bin as often as in their shingles.
    """
    bins = BANDS * BAND_ROWS
    low = np.full(n * bins, ~np.uint64(0), np.uint64)
    values = mix(keys ^ np.uint64(0x2545F4914F6CDD1D))
    np.minimum.at(low, doc * bins + (values % np.uint64(bins)).astype(np.int64), values)
    low = low.reshape(n, bins)
    full = low != ~np.uint64(0)
    some, out, empty, attempt = full.any(axis=1), low.copy(), ~full, 0
    empty[~some] = False
    while empty.any():
        attempt += 1
        other = (mix(np.arange(bins, dtype=np.uint64) * np.uint64(1_000_003) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        take = empty & full[:, other]
        out[take] = low[:, other][take]
        empty &= ~take
    rows = out.reshape(n, BANDS, BAND_ROWS)
    made = np.zeros((n, BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND_ROWS):
        made = mix(made * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return made


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of 64-bit numbers."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64) if a.ndim > 1 else np.bitwise_count(a ^ b).astype(np.int64)


def _distances(fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of the pairs of places a and b, without a copy of the fingerprints of all pairs."""
    out = np.zeros(len(a), np.int64)
    for at in range(0, len(a), STEP_SIDES):
        out[at : at + STEP_SIDES] = _distance(fps[a[at : at + STEP_SIDES]], fps[b[at : at + STEP_SIDES]])
    return out


def _trees(fps: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BK-trees of many shards at once, level by level: children sorted by parent and distance.

    root: the item at the root of each item's tree.  Returns the children and their keys,
    parent * span + distance; a parent has one child at most at each distance.
    """
    span = _span(fps)
    at = root.copy()
    pending = np.flatnonzero(root != np.arange(len(fps)))
    children, keys = [], []
    while len(pending):
        key = at[pending] * span + _distances(fps, pending, at[pending])
        key, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        child = pending[first]
        children.append(child)
        keys.append(key)
        at[pending] = child[inverse]
        pending = np.delete(pending, first)
    if not children:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    child, key = np.concatenate(children), np.concatenate(keys)
    order = np.argsort(key)
    return child[order], key[order]


def _span(fps: np.ndarray) -> int:
    return 64 * (fps.shape[1] if fps.ndim > 1 else 1) + 1


def _near(fps: np.ndarray, root: np.ndarray, query: np.ndarray, trees, radius: int, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, item) within the radius, from each query's own tree, following only edges in reach.

    covered items are no queries, so pairs with them are found from the other side; other pairs once.
    """
    (child, keys), span = trees, _span(fps)
    node = root[query]
    found = []
    while len(query):
        d = _distances(fps, query, node)
        hit = (d <= radius) & ((node < query) | covered[node])
        found.append((query[hit], node[hit]))
        low = np.searchsorted(keys, node * span + np.maximum(d - radius, 0))
        high = np.searchsorted(keys, node * span + np.minimum(d + radius, span - 1), side="right")
        n = high - low
        query = np.repeat(query, n)
        node = child[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give all that the pairs connect one label, the smallest."""
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        least = np.minimum(la, lb)
        np.minimum.at(label, la, least)
        np.minimum.at(label, lb, least)
        while (label[label] != label).any():
            label[:] = label[label]


def _middles(fps: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The item at the root of each shard's tree: the first, or in large shards the one nearest to what most bits say."""
    roots = start.copy()
    for i in np.flatnonzero(sizes > 32):
        own = fps[start[i] : start[i] + sizes[i]]
        bits = np.unpackbits(np.ascontiguousarray(own).view(np.uint8).reshape(len(own), -1), axis=1)
        most = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(own)).view(np.uint64)
        roots[i] = start[i] + int(np.argmin(_distance(own, most if own.ndim > 1 else most[0])))
    return roots


def shard_links(shard: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of links between places (item, smallest item connected with it in its shard); rows are sorted by shard.

    What lies within the radius of its tree's root is linked by that, and only the rest searches the
    tree; so a shard of many near copies of one text costs little more than one look at each.
    """
    none = np.zeros(0, np.int64)
    start = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else none
    sizes = np.diff(np.append(start, len(shard)))
    many = np.flatnonzero(np.repeat(sizes > 1, sizes))
    fps, sizes = fps[many], sizes[sizes > 1]
    if not len(many):
        return none, none
    begin = np.cumsum(sizes) - sizes
    root = np.repeat(_middles(fps, begin, sizes), sizes)
    trees = _trees(fps, root)
    covered = _distance(fps, fps[root]) <= radius
    label = np.arange(len(fps))
    _join(label, np.flatnonzero(covered), root[covered])
    left = np.flatnonzero(~covered)
    work = np.cumsum(np.repeat(sizes, sizes)[left]) // STEP_PAIRS
    for query in np.split(left, np.flatnonzero(np.diff(work)) + 1):
        if len(query):
            _join(label, *_near(fps, root, query, trees, radius, covered))
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return many[linked], many[label[linked]]


def _search(radius: int):
    """Links between the nodes of a shard; rows are (part, key, node, fingerprint), sorted by part and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            tag, node, fps = (np.concatenate(x) for x in zip(*rows, strict=True))
            a, b = shard_links(tag, fps, radius)
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            part, key, node = (batch.column(i).to_numpy() for i in range(3))
            tag = key.view(np.uint64) * np.uint64(2 * 31 + 1) + part.astype(np.uint64)  # equal runs are one shard
            column = batch.column(3)
            fps = column.to_numpy().view(np.uint64) if pa.types.is_integer(column.type) else np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(tag), -1)
            held.append((tag, node, fps))
            last = np.flatnonzero(tag != tag[-1]) if len(tag) else []
            if len(last):  # all but the last shard, which may go on
                cut_at = last[-1] + 1
                yield links([*held[:-1], (tag[:cut_at], node[:cut_at], fps[:cut_at])])
                held = [(tag[cut_at:], node[cut_at:], fps[cut_at:])]
        if held and sum(len(h[0]) for h in held):
            yield links(held)

    return run


def _by_shard(work):
    """For mapInArrow: work(columns of whole shards) gives batches; rows are sorted by shard, the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column("shard").to_numpy()
            held.append(batch)
            if shard[0] != shard[-1]:  # all but the last shard, which may go on
                cut_at = int(np.flatnonzero(shard != shard[-1])[-1]) + 1
                yield from work(pa.Table.from_batches([*held[:-1], batch.slice(0, cut_at)]))
                held = [batch.slice(cut_at)]
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def _edges(shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    return start, np.diff(np.append(start, len(shard)))


def _wide(rows: pa.Table, column: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows[column].to_pylist()), np.uint64).reshape(-1, width)


def _stars(radius: int, width: int):
    """(a, b, far): each node of a shard with the node in its middle, if that is within the radius."""

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        node, fps = rows["node"].to_numpy(), _wide(rows, "fp", width)
        start, sizes = _edges(rows["shard"].to_numpy())
        root = np.repeat(_middles(fps, start, sizes), sizes)
        far = _distance(fps, fps[root])
        near = (far <= radius) & (node != node[root])
        yield pa.RecordBatch.from_arrays([pa.array(node[near]), pa.array(node[root][near]), pa.array(far[near])], names=["a", "b", "far"])

    return _by_shard(work)


def _rest(radius: int, width: int, similarity: float):
    """(a, b): links between nodes of a shard that are labelled apart, a spanning set of them.

    A BK-tree finds the nodes within the radius.  A pair is looked at in the first of the bands that it shares, and
    only while its labels are apart; what it takes is compared here, set against set, so that pairs are never rows.
    """

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        start, sizes = _edges(rows["shard"].to_numpy())
        for low, n in zip(start.tolist(), sizes.tolist()):
            own = rows.slice(low, n)
            node, label, fps, bands = own["node"].to_numpy(), own["label"].to_numpy(), _wide(own, "fp", width), _wide(own, "bands", BANDS)
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in own["shingles"]]
            part, names = int(own["part"][0].as_py()), {}
            group = np.array([names.setdefault(x, len(names)) for x in label.tolist()])
            least = list(range(len(names)))

            def find(x: int) -> int:
                while least[x] != x:
                    least[x] = x = least[least[x]]
                return x

            root = np.repeat(_middles(fps, np.zeros(1, np.int64), np.array([n])), n)
            trees, none, found = _trees(fps, root), np.zeros(n, bool), []
            for query in np.array_split(np.arange(n), n * n // STEP_PAIRS + 1):
                a, b = _near(fps, root, query, trees, radius, none)
                apart = (group[a] != group[b]) & ((bands[a] == bands[b]).argmax(axis=1) == part)
                for i, j in zip(a[apart].tolist(), b[apart].tolist()):
                    if (x := find(group[i])) != (y := find(group[j])) and _jaccard(sets[i], sets[j], similarity):
                        least[max(x, y)] = min(x, y)
                        found.append((int(node[i]), int(node[j])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    return _by_shard(work)


def _jaccard(one: np.ndarray, two: np.ndarray, least: float) -> bool:
    """Whether two sorted sets of hashes have a Jaccard similarity of at least so much."""
    small, large = (one, two) if len(one) < len(two) else (two, one)
    if len(small) < least * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return both >= least * (len(small) + len(large) - both)


def fingerprint_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) within radius bits, and no others.

    Fingerprints at most radius bits apart agree on all but radius of radius + 4 blocks
    of bits, so each goes to a shard for every choice of 4 blocks, together with all that
    have the same bits there.  A shard is a BK-tree in the task that holds it; its own
    fingerprints are the queries.  Links inside a shard leave it as a spanning set.
    """
    n = radius + 4
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(n)]
    masks = [sum(c) for c in combinations(blocks, 4)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    dealt = fps.select(
        "fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))).alias("part", "key")
    )
    parts = n_buckets(fps)
    dealt = dealt.repartition(parts, "part", "key").sortWithinPartitions("part", "key", "fp")
    return dealt.select("part", "key", F.col("fp").alias("node"), "fp").mapInArrow(_search(radius), schema_of("a long, b long"))


def wide_radius(similarity: float, bits: int = WIDE_BITS) -> int:
    """Differing bits within which nearly all texts of a Jaccard similarity lie: bits differ as the angle between shingles does, one by one."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + SLACK * math.sqrt(bits * share * (1 - share)))


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least so much.  sets: node, shingles (sorted hashes as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("shingles"), batch.column("others"), strict=True)
            keep = [_jaccard(*(np.frombuffer(x.as_buffer(), np.uint64) for x in pair), similarity) for pair in both]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_b = spread_join(pairs, sets.select(F.col("node").alias("b"), F.col("shingles").alias("others")), "b")
    both = with_b.join(sets.withColumnRenamed("node", "a"), "a")
    return both.select("a", "b", "shingles", "others").mapInArrow(run, schema_of("a long, b long"))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_words: int = 5, similarity: float = 0.8, bits: int = WIDE_BITS) -> DataFrame:
    """A row for each document: its id, fingerprint (of its shingles), component_id and root.

    Shingles of n_words words (A-Z in lower case).  Equal sets are one node.  Nodes meet in shards by MinHash
    keys of 64 bits, which texts of a similarity of 0.8 share with a probability of over 0.99 and others hardly ever, so
    shards grow with the copies and not with the corpus.  A node first meets the middle of its shards that is nearest by
    wide fingerprint.  In shards that this leaves apart a BK-tree finds all pairs within wide_radius(similarity).
    Every such pair is a link only if the Jaccard similarity of its sets of shingle hashes is at least similarity.

    Defined cases: as near_duplicates(); texts with fewer than n_words words are one shingle, those without
    words are copies of each other; a text of any length counts whole; other columns are not looked at.
    Sets are told apart by 64 bits of a hash: of n different ones about n*n/2**65 pairs are taken as equal.
    """

    def run(column: pa.Array) -> dict[str, object]:
        nodes, fps, bands = [np.zeros(0, np.uint64)], [], []
        for chunk in chunks(column, STEP_BYTES):
            doc, keys = shingle_hashes(chunk, n_words)
            order = np.lexsort((keys, doc))
            doc, keys = doc[order], keys[order]
            once = np.concatenate([[True], (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])]) if len(doc) else np.zeros(0, bool)
            doc, keys = doc[once], keys[once]
            total = np.zeros(chunk.n, np.uint64)
            np.add.at(total, doc, mix(keys))
            nodes.append(mix(total + np.bincount(doc, minlength=chunk.n).astype(np.uint64)))
            fps += [r.tobytes() for r in wide_bits(doc, keys, chunk.n, bits)]
            bands += [r.tobytes() for r in minhash_bands(doc, keys, chunk.n)]
        return {"node": np.concatenate(nodes).view(np.int64), "fp": pa.array(fps, pa.binary()), "bands": pa.array(bands, pa.binary())}

    def shingles(column: pa.Array) -> dict[str, object]:
        out = []
        for chunk in chunks(column, STEP_BYTES):
            doc, keys = shingle_hashes(chunk, n_words)
            ends = np.searchsorted(doc, np.arange(1, chunk.n + 1))
            out += [np.unique(own).tobytes() for own in np.split(keys, ends[:-1])]
        return {"shingles": pa.array(out, pa.binary())}

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("said"))
    fps = cut(with_text_columns(own, "text", "node long, fp binary, bands binary", run, ["doc_id", "said"]))
    nodes = cut(fps.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("said").alias("said"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    fps = fps.select("doc_id", "node")
    parts, width, radius = n_buckets(docs), bits // 64, wide_radius(similarity, bits)
    key = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(F.substring("bands", i * 8 + 1, F.lit(8))))
    dealt = nodes.select("node", F.posexplode(key).alias("part", "shard"))
    several = dealt.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1").select("shard")
    shared = cut(spread_join(dealt, several, "shard"))
    by_shard = lambda rows: rows.repartition(parts, "shard").sortWithinPartitions("shard", "node")

    def sets_of(some: DataFrame) -> DataFrame:
        needed = some.join(nodes.select("node", "said"), "node")
        said = own.select("said", "text").join(needed.select("said").distinct(), "said").groupBy("said").agg(F.first("text").alias("text"))
        return cut(with_text_columns(said.join(needed, "said"), "text", "shingles binary", shingles, ["node"]))

    stars = by_shard(shared.join(nodes.select("node", "fp"), "node").select("shard", "node", "fp")).mapInArrow(_stars(radius, width), schema_of("a long, b long, far long"))
    stars = cut(stars.groupBy("a").agg(F.min_by("b", F.struct("far", "b")).alias("b")))
    first = cut(alike(stars, sets_of(stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct()), similarity))
    roots = components(first)
    known = cut(nodes.join(roots, "node", "left").select("node", "fp", "bands", F.coalesce("root", "node").alias("label")))
    rows = shared.join(known.select("node", "label"), "node")
    apart = rows.groupBy("shard").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("shard")
    rows = cut(rows.join(apart, "shard", "left_semi"))
    sets = sets_of(rows.select("node").distinct())
    rows = by_shard(rows.join(known.drop("label"), "node").join(sets, "node").select("shard", "part", "node", "label", "fp", "bands", "shingles"))
    second = cut(rows.mapInArrow(_rest(radius, width, similarity), schema_of("a long, b long")))
    if not second.isEmpty():
        roots = components(first.union(second))
    named = cut(nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(spread_join(named.select("node", "root"), least, "root"))
    return spread_join(fps, named, "node").select(F.col("doc_id").alias(doc_id), F.col("node").alias("fingerprint"), "component_id", "root")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_words: int = 3, radius: int = 2
) -> DataFrame:
    """A row for each document: its id, fingerprint (16 hex digits), component_id and root.

    component_id is the smallest id of a document that is reachable over links of
    radius bits or fewer, the document itself included; root is the smallest
    fingerprint of the component, as a signed long.  Equal fingerprints are one node,
    so copies of any number cost one, and only distinct ones are searched and linked.

    Defined cases: null, empty and wordless texts have fingerprint zero and are linked
    like any other; null ids are kept in the result but never the smallest (a component
    of null ids only has a null component_id); repeated rows stay; no rows give none.
    """
    fps = cut(with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", n_words, ["doc_id"]))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(fingerprint_links(nodes, radius))
    nodes = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    nodes = cut(nodes)
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = spread_join(nodes.select("fp", "root"), least, "root")
    return spread_join(fps, named, "fp").select(
        F.col("doc_id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root"
    )


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near_copies(): the one with the smallest id.

    Defined cases: a row without id stays only if no row of its group has one; of several rows with the
    id that stays, and of several such rows without id, one stays; null, empty and wordless texts are
    copies of each other; texts of any length count whole; no rows give no rows; all columns are kept.
    """
    found = cut(near_copies(docs, doc_id, text, n_words, similarity))
    stay = found.where(F.col(doc_id) == F.col("component_id"))
    kept = docs.join(stay.select(doc_id).distinct(), doc_id, "left_semi")
    if not stay.groupBy(doc_id).count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([doc_id])
    nameless = found.where(F.col("component_id").isNull()).select("root").distinct()
    if not nameless.isEmpty():
        rows = docs.where(F.col(doc_id).isNull())
        own = near_copies(rows.select(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_at"), F.col(text)).distinct(), "_at", text, n_words, similarity).select("_at", F.col("fingerprint").alias("_node"))
        own = own.join(found.where(F.col(doc_id).isNull()).select(F.col("fingerprint").alias("_node"), F.col("root").alias("_root")).distinct(), "_node")
        rows = rows.withColumn("_at", F.xxhash64(F.coalesce(F.col(text), F.lit("")))).join(own.select("_at", "_root"), "_at").join(nameless.withColumnRenamed("root", "_root"), "_root")
        kept = kept.unionByName(rows.dropDuplicates(["_root"]).select(docs.columns))
    return kept.select(docs.columns)
