"""The corpus pipeline: five stages over documents, each written and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  The
first four return the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.contamination import decontaminate
from millrace.llm.frames import scratch
from millrace.llm.packing import best_fit_packing
from millrace.llm.pii import redact
from millrace.llm.quality import quality_rules
from millrace.llm.simhash import keep_one_of_each


def _apart(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage over docs with all columns but id and text under names that no result has; the columns of docs come back as they were."""
    names = {c: c if c in ("doc_id", "text") else f"_own_{i}" for i, c in enumerate(docs.columns)}
    done = stage(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())))
    return done.select(*(F.col(n).alias(c) for c, n in names.items()))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Defined cases: null, empty and short texts go, as the rules have it; rows that repeat stay or go together;
    own columns of any name are kept unchanged; no rows give none.
    """
    return _apart(docs, lambda rows: quality_rules(rows).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Defined cases: texts without words (null, empty) are copies of each other; of rows with the smallest id, and of those
    without id where no row has one, one stays; own columns of any name are kept unchanged; no rows give none.
    """
    return _apart(docs, keep_one_of_each)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark.

    Defined cases: null and empty texts stay; an empty benchmark contaminates nothing; rows that repeat stay or go
    together; own columns of any name are kept unchanged; no rows give none.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _apart(docs, lambda rows: decontaminate(rows, benchmark).where("not contaminated"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars counts the new text.

    Defined cases: null and empty texts stay as they are; n_chars, where there is such a column, is null for a null text; rows that
    repeat stay; other own columns of any name are kept unchanged; no rows give none.
    """
    clean = _apart(docs, redact)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast("long"))
    return clean.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences.

    Defined cases: as best_fit_packing(), whose columns are the result; others are left behind.
    """
    return best_fit_packing(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]

#: Rolling-hash coverage is exact and could be SQL, but fingerprints and trees cannot.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the whole of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
