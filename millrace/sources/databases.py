"""Tables of a database that is there already, read through JDBC."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,62}(\.[A-Za-z_][A-Za-z0-9_]{0,62})?\Z")


def fetch_table(spark: SparkSession, url: str, table: str, limit: int | None = None, key: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """The rows of one table, read only; with a numeric key by so many connections at once, over ranges of its values.

    A name that is not a plain identifier is refused.
    """
    if not _NAME.match(table):
        raise ValueError(f"not a table name: {table!r}")
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key:
        if not _NAME.match(key):
            raise ValueError(f"not a column name: {key!r}")
        low, high = reader.load().agg(F.min(key), F.max(key)).first()
        if low is not None:
            reader = reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    rows = reader.load()
    return rows if limit is None else rows.limit(limit)


def list_tables(spark: SparkSession, url: str, query: str = "select table_name from information_schema.tables", **options: str) -> DataFrame:
    """Names of tables and views, each once, sorted; query is the database's own way to list them."""
    names = spark.read.format("jdbc").options(url=url, query=query, **options).load()
    return names.select(F.col(names.columns[0]).alias("table_name")).distinct().orderBy("table_name")
