"""Sinks: report cells that no spreadsheet takes for a formula, and CSV and TSV writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a spreadsheet starts a formula by.
TRIGGER = r"^[=+\-@\t\r]"
NUMBER = r"^[+-]?\d+(?:\.\d+)?$"


def cell(column: Column, kind: T.DataType) -> Column:
    """A value as report text: null is empty, booleans are Yes and No, fractions have two places at most."""
    if isinstance(kind, T.BooleanType):
        return F.when(column.isNull(), "").when(column, "Yes").otherwise("No")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(column.isNull(), "").otherwise(F.regexp_replace(F.format_string("%.2f", column), r"\.?0+$", ""))
    return F.coalesce(column.cast("string"), F.lit(""))


def safe_cell(column: Column, kind: T.DataType) -> Column:
    """The same, with a quote before texts that would start a formula; numbers keep their sign."""
    text = cell(column, kind)
    if isinstance(kind, T.NumericType):
        return text
    return F.when(text.rlike(TRIGGER) & ~text.rlike(NUMBER), F.concat(F.lit("'"), text)).otherwise(text)


def safe_rows(df: DataFrame) -> DataFrame:
    return df.select(*(safe_cell(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))


def write_csv(df: DataFrame, path: str) -> None:
    safe_rows(df).write.csv(path, header=True, mode="overwrite", emptyValue="", lineSep="\n")


def scrubbed(df: DataFrame) -> DataFrame:
    """Texts with tabs and line breaks as one space, for tab-separated files."""
    texts = {f.name: F.regexp_replace(f.name, r"[\t\r\n]+", " ") for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.withColumns(texts)


def write_tsv(df: DataFrame, path: str) -> None:
    scrubbed(df).write.csv(path, sep="\t", header=True, mode="overwrite", emptyValue="")


def write_report(df: DataFrame, path: str, kind: str) -> None:
    """A report as csv, tsv, json, xlsx or docx, a folder of files each; other kinds are refused."""
    from .office import write_office

    office = {k: lambda rows, to, k=k: write_office(rows, to, k) for k in ("xlsx", "docx")}
    writers = {"csv": write_csv, "tsv": write_tsv, "json": lambda rows, to: rows.write.json(to, mode="overwrite"), **office}
    if kind not in writers:
        raise ValueError(f"no report of kind {kind!r}")
    writers[kind](df, path)
