"""A Merkle manifest of a table: a tree of SHA-256 digests for each source, and one over the sources.

Leaves are numbered within their source, in the order of their ids, by sorted ranges and the
counts of each, so that a source of any size is spread.  Aligned blocks of fanout ** LEVELS leaves are
matrices of hex digests in the task that holds them, hashed row after row and level after level;
their roots are the leaves of the next table, until every source has one node.  The roots of
the sources go through the same.  On the way down each block gets what stands beside it further
up once, and its leaves add their own siblings by index arithmetic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import n_buckets, schema_of, scratch, without

#: Levels that a block holds; it has fanout ** LEVELS leaves.
LEVELS = 2
HEX = 64
RESULTS = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def field(value: Column) -> Column:
    """A value as its length in bytes, a colon and itself; null as a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def _digest(data: bytes | np.ndarray) -> str:
    return hashlib.sha256(data).hexdigest()


def matrix(digests: list[str]) -> np.ndarray:
    return np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, HEX)


def levels(leaves: np.ndarray, total: int, fanout: int, most: int = LEVELS) -> list[np.ndarray]:
    """Digest matrices of a block, the leaves first: levels go on while the whole tree (of total leaves) has several nodes."""
    out = [leaves]
    while total > 1 and len(out) <= most:
        nodes = out[-1]
        full = len(nodes) // fanout
        runs = nodes[: full * fanout].reshape(full, fanout * HEX)
        made = [_digest(run) for run in runs]
        if full * fanout < len(nodes):
            made.append(_digest(np.ascontiguousarray(nodes[full * fanout :])))
        out.append(matrix(made))
        total = -(-total // fanout)
    return out


def siblings(tree: list[np.ndarray], at: int, fanout: int) -> bytes:
    """What stands beside leaf at and the nodes above it, level by level; the last level has no runs."""
    out = []
    for nodes in tree[:-1]:
        low = at // fanout * fanout
        out += [nodes[low:at].tobytes(), nodes[at + 1 : low + fanout].tobytes()]
        at //= fanout
    return b"".join(out)


def fold(digest: str, beside: str, places: list[int], sizes: list[int]) -> str:
    """The root that a leaf and its siblings give; places and sizes are those of each run on the way."""
    at = 0
    for place, size in zip(places, sizes):
        left, right = at + place * HEX, at + (size - 1) * HEX
        digest = _digest((beside[at:left] + digest + beside[left:right]).encode())
        at = right
    return digest


def way(at: int, total: int, fanout: int) -> tuple[list[int], list[int]]:
    """The place in its run and the size of the run, for leaf at of total and all nodes above it."""
    places, sizes = [], []
    while total > 1:
        places.append(at % fanout)
        sizes.append(min(fanout, total - at // fanout * fanout))
        at, total = at // fanout, -(-total // fanout)
    return places, sizes


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df (with a column tree), pos (the number of each row within its tree, in the given order, nulls first) and total.

    Sorted ranges are written, the rows of each tree in each range counted, and the counts of
    ranges added up; no tree is gathered in one task.
    """
    by = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    path = scratch(df.sparkSession, "merkle-order")
    rows = df.repartitionByRange(n_buckets(df), *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    rows.write.parquet(path)
    rows = df.sparkSession.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    over = Window.partitionBy("tree")
    counts = rows.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    counts = counts.withColumns({"_before": F.sum("_n").over(over.orderBy("_part")) - F.col("_n"), "total": F.sum("_n").over(over)})
    return rows.join(counts, ["tree", "_part"]).select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos"), "total")


def _dealt(df: DataFrame, fanout: int, *order: str) -> DataFrame:
    """Blocks as neighbours in a partition, their rows in order; block is the first column."""
    df = df.select(F.expr(f"pos div {fanout**LEVELS}").alias("block"), *df.columns)
    return df.repartition(n_buckets(df), "tree", "block").sortWithinPartitions("tree", "block", *order)


def _by_block(work, schema):
    """For mapInArrow: work(rows of one block as dicts) gives rows; a block has fanout ** LEVELS leaves at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, held, now = to_arrow_schema(schema), [], None
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                key = (row["tree"], row["block"])
                if key != now and held:
                    made += work(held)
                    held = []
                now = key
                held.append(row)
            if made:
                yield pa.RecordBatch.from_pylist(made, out)
        if held:
            yield pa.RecordBatch.from_pylist(work(held), out)

    return run


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def climb(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """Tables (tree, pos, total, digest): the given nodes, the roots of their blocks, and so on to one node a tree."""

    def up(rows: list[dict]) -> list[dict]:
        total = rows[0]["total"]
        top = levels(matrix([r["digest"] for r in rows]), total, fanout)[-1]
        return [{"tree": rows[0]["tree"], "pos": rows[0]["block"], "total": -(-total // fanout**LEVELS), "digest": top.tobytes().decode()}]

    schema = schema_of("tree string, pos long, total long, digest string")
    tables = [nodes.select("tree", "pos", "total", "digest")]
    while not tables[-1].where("total > 1").isEmpty():
        tables.append(_stored(_dealt(tables[-1], fanout, "pos").mapInArrow(_by_block(up, schema), schema), "merkle-level"))
    return tables


def _met(nodes: DataFrame, above: DataFrame, fanout: int) -> DataFrame:
    """Blocks of nodes, each with the row of above that stands for the block first (its nodes have a null pos)."""
    dealt = nodes.select(F.expr(f"pos div {fanout**LEVELS}").alias("block"), *nodes.columns)
    both = above.withColumnsRenamed({"pos": "block"}).unionByName(dealt, allowMissingColumns=True)
    return both.repartition(n_buckets(nodes), "tree", "block").sortWithinPartitions("tree", "block", F.col("pos").asc_nulls_first())


def descend(tables: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """above (tree, beside and what else goes with a tree) as a row for each block of the lowest table: tree, pos, beside, ...

    beside has the siblings from the node that stands for the block up to the top, as hex digits.
    """
    above = above.withColumn("pos", F.lit(0).cast("long"))
    for nodes in reversed(tables[1:]):

        def down(rows: list[dict]) -> list[dict]:
            head, own = rows[0], rows[1:]
            tree = levels(matrix([r["digest"] for r in own]), own[0]["total"], fanout)
            carried = {k: v for k, v in head.items() if k not in ("block", "pos", "total", "digest", "beside")}
            return [carried | {"pos": r["pos"], "beside": siblings(tree, i, fanout).decode() + head["beside"]} for i, r in enumerate(own)]

        above = _met(nodes, above, fanout).mapInArrow(_by_block(down, above.schema), above.schema)
    return above


def manifest(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", fields: list[str] | None = None, tampered: dict[str, Column] | None = None,
    keep: list[str] | None = None, fanout: int = 16,
) -> DataFrame:
    """Columns keep of docs (default: all), leaf, subroot, root, proof_sha256, folded_root and verified.

    A leaf is the digest of the fields (default: all columns), each as its length in bytes, a
    colon and its value, or a dash where null.  Leaves of a source ascend by id; runs of fanout
    nodes become the digest of their hex digits until one node is left, the subroot.  Subroots in the
    order of their sources (null first, by UTF-8 bytes) give the root in the same way.
    proof_sha256 is the digest of all siblings on the way from leaf to root.  folded_root is
    what these siblings make of the leaf, computed anew from the fields with the columns of tampered
    in the place of those of the table; verified tells whether it is the root.

    Defined cases: a null id comes before all others; rows that repeat an id are ordered by
    their leaf; a null source is a source; a lone leaf is its subroot, a lone subroot the root, and
    its proof is the digest of nothing; texts of any length count whole; no rows give none; own
    columns with the names of results are fields like any other, and give way to these in the result.
    """
    fields = docs.columns if fields is None else fields
    kept = [c for c in without(docs, RESULTS).columns if keep is None or c in keep]
    names = [f"_k{i}" for i in range(len(kept))]
    changed = [(tampered or {}).get(c, F.col(c)) for c in fields]
    plain = docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("")).alias("tree"), F.col(doc_id).alias("_id"),
        leaf(*map(F.col, fields)).alias("digest"), (leaf(*changed) if tampered else F.lit(None).cast("string")).alias("_own"),
        *(F.col(c).alias(n) for c, n in zip(kept, names)),
    )
    plain = plain.withColumn("_own", F.coalesce("_own", "digest"))
    leaves = _stored(numbered(_stored(plain, "merkle-leaves"), "_id", "digest"), "merkle-leaves")
    tables = climb(leaves, fanout)
    subroots = numbered(tables[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), "of")
    subroots = _stored(subroots, "merkle-sources")
    tops = climb(subroots, fanout)
    root = tops[-1].select("tree", F.lit("").alias("beside"), F.col("digest").alias("root"))
    schema = schema_of("tree string, beside string, subroot string, root string, nth long, sources long")

    def source_rows(rows: list[dict]) -> list[dict]:
        head, own = rows[0], rows[1:]
        tree = levels(matrix([r["digest"] for r in own]), own[0]["total"], fanout)
        return [
            {"tree": r["of"], "beside": siblings(tree, i, fanout).decode() + head["beside"], "subroot": r["digest"],
             "root": head["root"], "nth": r["pos"], "sources": r["total"]}
            for i, r in enumerate(own)
        ]

    of_source = _met(subroots, descend(tops, root, fanout), fanout).mapInArrow(_by_block(source_rows, schema), schema)
    above = descend(tables, _stored(of_source, "merkle-sources"), fanout)
    out = schema_of("leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    for c, n in reversed(list(zip(kept, names))):
        kind = docs.schema[c]
        out = type(out)([type(kind)(n, kind.dataType), *out])

    def finish(rows: list[dict]) -> list[dict]:
        head, own = rows[0], rows[1:]
        tree = levels(matrix([r["digest"] for r in own]), own[0]["total"], fanout)
        top, made = way(head["nth"], head["sources"], fanout), []
        for i, r in enumerate(own):
            beside = siblings(tree, i, fanout).decode() + head["beside"]
            places, sizes = (a + b for a, b in zip(way(r["pos"], r["total"], fanout), top))
            folded = fold(r["_own"], beside, places, sizes)
            made.append({n: r[n] for n in names} | {"leaf": r["digest"], "subroot": head["subroot"], "root": head["root"],
                         "proof_sha256": _digest(beside.encode()), "folded_root": folded, "verified": folded == head["root"]})
        return made

    done = _met(leaves.drop("_id"), above, fanout).mapInArrow(_by_block(finish, out), out)
    return done.withColumnsRenamed(dict(zip(names, kept)))
