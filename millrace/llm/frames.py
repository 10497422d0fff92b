"""Small DataFrame helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the session has no such setting (tests), one under the warehouse is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows with no lineage, kept where any executor can read them again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def n_buckets(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df less the columns that an operator's own results replace (names are case-insensitive)."""
    clash = {n.lower() for n in names}
    return df.select([df[c] for c in df.columns if c.lower() not in clash])


def fresh(df: DataFrame, name: str) -> str:
    """name, or with as many underscores before it as make it no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Keys that may be dealt to several tasks in spread_join(), at most, and to how many.
HOT_KEYS, SALTS = 500, 64


def spread_join(rows: DataFrame, single: DataFrame, key: str) -> DataFrame:
    """The inner join of rows with single, which has one row for each key; rows of a key may be any share of all.

    Keys that hold more than one of HOT_KEYS equal parts of the rows are fewer than HOT_KEYS, so they can be broadcast;
    their rows go to SALTS tasks, with a copy of the single row each.  rows should be a stored table.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    most = rows.count() // HOT_KEYS + 1
    hot = F.broadcast(cut(counts.where(F.col("_n") > max(most, 1000)).select(key, F.lit(True).alias("_hot"))))
    salt = F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    dealt = rows.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(single.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot"), [key, "_salt"]).drop("_salt")


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def with_text_columns(
    df: DataFrame, text: str, ddl: str, measure: Callable[[pa.Array], dict[str, object]], keep: list[str] | None = None
) -> DataFrame:
    """Columns keep of df (default: all) and those that measure() makes from the texts of a batch.

    measure gets the Arrow column of texts and returns a value for each column of ddl.
    An own column of the same name gives way to the result's.
    """
    extra = schema_of(ddl)
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in {f.name.lower() for f in extra}]
    df = df.select(*dict.fromkeys([*kept, text]))
    schema = T.StructType([*(df.schema[c] for c in kept), *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            made = measure(batch.column(batch.schema.get_field_index(text)))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            columns += [
                v if isinstance(v, pa.Array) else pa.array(v, out.field(f.name).type)
                for f, v in ((f, made[f.name]) for f in extra)
            ]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)
