"""What hand-written loops over ordered rows do, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key; an aggregate with map-side combine, not a sort."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return best.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in others))



def series_change(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """df with change: value less the last known value before it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("change", F.col(value) - F.last(value, ignorenulls=True).over(w))


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column) -> DataFrame:
    """df with island: rows between two breaks of a key share a number."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("island", F.sum(F.when(breaks, 1).otherwise(0)).over(w))


def failure_runs(df: DataFrame, key: str, ts: str, failed: Column, least: str = "24 hours") -> DataFrame:
    """The open run of failures after each key's last success: its length, first and last, and dead if it lasted least."""
    marked = df.withColumn("_ok", ~failed)
    last_ok = marked.groupBy(key).agg(F.max(F.when(F.col("_ok"), F.col(ts))).alias("_success"))
    runs = marked.join(last_ok, key).where(~F.col("_ok") & (F.col("_success").isNull() | (F.col(ts) > F.col("_success"))))
    return runs.groupBy(key).agg(
        F.count(F.lit(1)).alias("failures"), F.min(ts).alias("first_failure"), F.max(ts).alias("last_failure"),
    ).withColumn("dead", F.col("last_failure") - F.col("first_failure") >= F.expr(f"interval {least}"))


def serial_columns(df: DataFrame, groups: list[str], order: str, columns: list[str]) -> DataFrame:
    """(column, serial): whether a column counts 1, 2, 3 ... in each group."""
    w = Window.partitionBy(*groups).orderBy(order)
    place = F.row_number().over(w)
    marked = df.select(*((F.col(c) == place).alias(c) for c in columns))
    cells = marked.agg(*(F.bool_and(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in columns))
    return cells.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("serial")) for c in columns))))


def admitted(df: DataFrame, keys: list[str], order: list[str], units: str, cap: float) -> DataFrame:
    """Rows while the running sum of units stays within a cap, for each key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(units).over(w)).where(F.col("running") <= cap)


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key with their rank; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sequence_faults(df: DataFrame, key: str, order: str, sequence: str, kind: str, start: str, end: str) -> DataFrame:
    """For each key: rows whose sequence is not its place, whether it begins with start and ends with end."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    marked = df.withColumn("_gap", F.col(sequence) != place)
    return marked.groupBy(key).agg(
        F.count_if("_gap").alias("gaps"), (F.min_by(kind, order) == start).alias("starts_well"), (F.max_by(kind, order) == end).alias("ends_well"),
    )


def decayed(df: DataFrame, key: str, order: str, value: str, keep: float = 0.7, cap: float = 5.0) -> DataFrame:
    """For each key, the fold score = keep * score + (1 - keep) * min(value, cap) over its rows in order.

    A sum of powers says the same as the fold, so it aggregates without collecting a key's rows.
    """
    w = Window.partitionBy(key).orderBy(F.desc(order))
    weight = F.pow(F.lit(keep), F.row_number().over(w) - 1) * (1 - keep)
    return df.withColumn("_part", weight * F.least(F.col(value), F.lit(cap))).groupBy(key).agg(F.round(F.sum("_part"), 6).alias("priority"))
