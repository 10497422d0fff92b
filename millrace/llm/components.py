"""Connected components of a link table, by contraction to smaller neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link; root is the smallest node that all of a component agree on.

    Each round points every node at its smallest neighbour (or itself), follows that
    pointer once more, and replaces the ends of links by what they point at; links
    inside a group vanish.  A component at least halves each round.  Rounds are cut
    from their lineage in the shared folder.  Links with a null end are none; no links
    give no rows.
    """
    links = cut(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    pointers: DataFrame | None = None
    while not links.isEmpty():
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p"))
        onward = step.select(F.col("u").alias("p"), F.col("p").alias("q"))
        step = cut(step.join(onward, "p", "left").select("u", F.coalesce("q", "p").alias("p")))
        onward = step.select(F.col("u").alias("p"), F.col("p").alias("q"))
        if pointers is None:
            pointers = step
        else:
            pointers = cut(pointers.join(onward, "p", "left").select("u", F.coalesce("q", "p").alias("p")))
        ends = {c: step.select(F.col("u").alias(c), F.col("p").alias(f"{c}p")) for c in "uv"}
        moved = links.join(ends["u"], "u").join(ends["v"], "v")
        links = cut(
            moved.select(F.greatest("up", "vp").alias("u"), F.least("up", "vp").alias("v")).where("u != v").distinct()
        )
    if pointers is None:
        pointers = links.select("u", F.col("v").alias("p"))
    return pointers.select(F.col("u").alias("node"), F.col("p").alias("root"))
