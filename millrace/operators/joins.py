"""Joins beyond the built-in ones: completed lists, cascades, semi-lookups and walks up a hierarchy."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def completed(master: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """The master list, and derived entries whose key it lacks (other columns null)."""
    extra = derived.select(key).distinct().join(master.select(key), key, "left_anti")
    return master.unionByName(extra, allowMissingColumns=True)


def first_hit(strategies: list[DataFrame], key: str) -> DataFrame:
    """For each key the rows of the first strategy that has any; the priority is kept."""
    tagged = [s.withColumn("priority", F.lit(i)) for i, s in enumerate(strategies)]
    every = reduce(DataFrame.unionByName, tagged)
    best = every.groupBy(key).agg(F.min("priority").alias("priority"))
    return every.join(best, [key, "priority"])


def matches_any(people: DataFrame, probes: DataFrame, columns: list[str], key: str) -> DataFrame:
    """People that share a lower-cased value of any column with a probe.

    One hash semi-join for each column; an OR of them would be a nested loop.
    """
    found = []
    for c in columns:
        values = probes.select(F.lower(c).alias(c)).where(F.col(c).isNotNull()).distinct()
        found.append(people.withColumn("_probe", F.lower(c)).join(values.withColumnRenamed(c, "_probe"), "_probe", "left_semi").select(people.columns))
    return reduce(DataFrame.unionByName, found).dropDuplicates([key])


def within_hops(links: DataFrame, seeds: DataFrame, hops: int, source: str = "parent", target: str = "child") -> DataFrame:
    """(node, hops): nodes reached from the seeds (column node), with the least number of links, up to a few."""
    reached = seeds.select("node", F.lit(0).alias("hops"))
    front = reached.select("node")
    steps = links.select(F.col(source).alias("node"), F.col(target).alias("_next"))
    for hop in range(1, hops + 1):
        front = front.join(steps, "node").select(F.col("_next").alias("node")).distinct()
        reached = reached.unionByName(front.withColumn("hops", F.lit(hop)))
    return reached.groupBy("node").agg(F.min("hops").alias("hops"))


def ancestors(parents: DataFrame, depth: int, node: str = "node", parent: str = "parent") -> DataFrame:
    """(node, ancestor, distance) up a parent table, to a depth; a node is not its own ancestor."""
    up = parents.where(F.col(parent).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("ancestor"))
    level, out = up.withColumn("distance", F.lit(1)), up.withColumn("distance", F.lit(1))
    for distance in range(2, depth + 1):
        step = up.select(F.col("node").alias("_at"), F.col("ancestor").alias("_next"))
        level = level.join(step, level.ancestor == step._at).select("node", F.col("_next").alias("ancestor"), F.lit(distance).alias("distance"))
        out = out.unionByName(level)
    return out


def settled(df: DataFrame) -> DataFrame:
    """The same rows without lineage, in the folder that the session names for checkpoints (tests: one under the warehouse)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared")
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As settled(), as packed columns of which each reader takes its own."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    path = f"{folder.rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def below(parents: DataFrame, roots: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """(node, root): each root and all that lies below it, at any depth.  Whoever was reached before is not gone through again, so cycles end.

    A round follows one level of the tree for all roots at once.
    """
    down = parents.where(F.col(parent).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("_above"))
    front = settled(parents.select(F.col(node).alias("node")).join(roots.select(F.col("root").alias("node")), "node", "left_semi").distinct().withColumn("root", F.col("node")))
    reached = front
    while not front.isEmpty():
        step = front.select(F.col("node").alias("_above"), "root").join(down, "_above").select("node", "root").distinct()
        front = settled(step.join(reached, ["node", "root"], "left_anti"))
        reached = reached.unionByName(front)
    return reached


def ancestry(parents: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """(node, ancestor, distance) for all ancestors, however deep, by the shortest way; a node is not its own ancestor, also where parents go round.

    Each round joins the pairs known with those of twice the last step, so a chain of n levels takes log2(n) rounds.
    A round that finds no new pair ends it: whoever lies beyond would have come after one of its own, and on a
    circle all are known by then.  Null and repeated links say nothing.
    """
    links = parents.select(F.col(node).alias("node"), F.col(parent).alias("ancestor")).dropna().distinct()
    jump = settled(links.where("node <> ancestor"))
    reached, step = jump.withColumn("distance", F.lit(1)), 1
    while True:
        on = jump.select("node", F.col("ancestor").alias("_via"))
        further = on.join(reached.select(F.col("node").alias("_via"), "ancestor", (F.col("distance") + step).alias("distance")), "_via")
        found = further.where("node <> ancestor").groupBy("node", "ancestor").agg(F.min("distance").alias("distance"))
        new = settled(found.join(reached, ["node", "ancestor"], "left_anti").select("node", "ancestor", "distance"))
        if new.isEmpty():
            return reached
        reached = reached.unionByName(new)
        jump = settled(on.join(jump.select(F.col("node").alias("_via"), "ancestor"), "_via").select("node", "ancestor").distinct())
        step *= 2
