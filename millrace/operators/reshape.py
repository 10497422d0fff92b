"""Wide tables to long ones and back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mark(cell: Column) -> Column:
    """A number from a cell; '45+2' (grace marks) is 47."""
    base, grace = (F.regexp_extract(cell, r"^\s*(\d+(?:\.\d+)?)\s*(?:\+\s*(\d+(?:\.\d+)?))?\s*$", i).try_cast("double") for i in (1, 2))
    return base + F.coalesce(grace, F.lit(0.0))


def is_blank(cell: Column) -> Column:
    return cell.isNull() | F.trim(cell).isin("", "-", "–", "—", "NaN", "nan")


def unpivot_marks(wide: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """(ids, column, marks, status) for each cell that is not blank; a cell that is no number is a status."""
    long = wide.unpivot(ids, columns, "course", "cell").where(~is_blank(F.col("cell")))
    long = long.select(*ids, "course", "cell", mark(F.col("cell")).alias("marks"))  # once, so that generated code has no shared parts
    return long.select(*ids, "course", "marks", F.when(F.col("marks").isNull(), F.upper(F.trim("cell"))).alias("status"))


def grid(df: DataFrame, row: str, column: str, columns: list[str], value: Column) -> DataFrame:
    """A row for each row value and a column for each named value (naming them saves a pass)."""
    return df.groupBy(row).pivot(column, columns).agg(value)


def merged_sheets(sheets: list[DataFrame], names: list[str], row_number: str = "row_number") -> DataFrame:
    """Union of sheets, with the sheet's name, and row numbers that run on; spelling is the first sheet's."""
    first = {c.lower().strip(): c for c in sheets[0].columns}
    same = [s.toDF(*(first.get(c.lower().strip(), c) for c in s.columns)).withColumn("Sheet", F.lit(n)) for s, n in zip(sheets, names, strict=True)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), same)
    sizes = every.groupBy("Sheet").agg(F.max(row_number).alias("_n"))
    place = F.array_position(F.array(*map(F.lit, names)), F.col("Sheet"))
    before = Window.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)  # a row for each sheet
    offset = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("Sheet", "_offset")
    return every.join(F.broadcast(offset), "Sheet").withColumn(row_number, F.col(row_number) + F.col("_offset")).drop("_offset")


def usable(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many cells of each column hold a value."""
    return df.agg(*(F.count(F.when(F.trim(F.col(c).cast("string")) != "", 1)).alias(c) for c in columns))
