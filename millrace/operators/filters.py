"""Filters and projections by a small closed vocabulary."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SAFE = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
TRUE_WORDS = ("yes", "true", "1", "t", "y")


class UnknownColumn(ValueError):
    """A filter or order names no column of the table."""


def checked(df: DataFrame, name: str) -> Column:
    if not _SAFE.match(name) or name not in df.columns:
        raise UnknownColumn(name)
    return df[name]


def literal(kind: T.DataType, value: object) -> Column:
    """A filter's value as the column's type; booleans read yes, true, 1, t and y."""
    if isinstance(kind, T.BooleanType) and not isinstance(value, bool):
        return F.lit(str(value).strip().lower() in TRUE_WORDS)
    return F.lit(value).cast(kind)


def predicate(df: DataFrame, key: str, value: object) -> Column | None:
    """One filter: name, name__contains, name__in, name__gte, __lte, __gt or __lt.

    Text equality ignores case; contains is a case-blind LIKE whose % and _ keep their
    meaning; an empty list matches nothing; None and '' mean no filter at all.
    """
    name, _, how = key.partition("__")
    column, kind = checked(df, name), df.schema[name].dataType
    if value is None or value == "":
        return None
    if how == "":
        return F.lower(column) == str(value).lower() if isinstance(kind, T.StringType) else column == literal(kind, value)
    if how == "contains":
        return F.lower(column.cast("string")).like(f"%{str(value).lower()}%")
    if how == "in":
        return column.isin(list(value)) if list(value) else F.lit(False)
    operations = {"gte": column.__ge__, "lte": column.__le__, "gt": column.__gt__, "lt": column.__lt__}
    if how not in operations:
        raise UnknownColumn(key)
    return operations[how](literal(kind, value))


def where(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """Rows that pass all filters; each reaches the scan as a predicate of its own."""
    for key, value in filters.items():
        if (p := predicate(df, key, value)) is not None:
            df = df.where(p)
    return df


def for_tenant(df: DataFrame, tenant: str, column: str = "institution_id") -> DataFrame:
    """One tenant's rows: the leading partition filter of every tenant query."""
    if not tenant:
        raise ValueError("a tenant is required")
    return df.where(checked(df, column) == tenant)


def ordered(df: DataFrame, order_by: str, tiebreak: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Ordered by a column ('-name' falls), nulls last, then by the tiebreak; optionally a page of it."""
    column = checked(df, order_by.lstrip("-"))
    out = df.orderBy(column.desc_nulls_last() if order_by.startswith("-") else column.asc_nulls_last(), checked(df, tiebreak))
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def minimized(df: DataFrame, requested: list[str], allowed: list[str]) -> DataFrame:
    """The requested columns that are allowed, in the order asked for; others vanish silently."""
    return df.select([c for c in dict.fromkeys(requested) if c in allowed and c in df.columns])


def window_status(when: Column, now: Column, days: int) -> Column:
    """'old' before the window, 'unknown' without a time or over a day ahead, else 'known'."""
    return (
        F.when(when.isNull() | (when > now + F.expr("interval 1 day")), "unknown")
        .when(when < now - F.make_dt_interval(F.lit(days)), "old")
        .otherwise("known")
    )


def redacted(values: Column, fragments: list[str], mark: str = "[redacted]") -> Column:
    """A map with the values of all keys that contain one of the fragments replaced."""
    pattern = "(?i)" + "|".join(re.escape(f) for f in fragments)
    return F.transform_values(values, lambda k, v: F.when(k.rlike(pattern), F.lit(mark)).otherwise(v))


def without_keys(values: Column, keys: list[str]) -> Column:
    """A map less some keys."""
    return F.map_filter(values, lambda k, _: ~k.isin(keys))


def visible(df: DataFrame, column: str, classes: list[str]) -> DataFrame:
    """Rows whose class a reader may see; no classes, no rows."""
    return df.where(df[column].isin(classes) if classes else F.lit(False))


def page_size(limit: int | None, most: int = 500, default: int = 100) -> int:
    """How many rows a reader gets: what was asked for, from 1 to most; default where nothing was."""
    return default if limit is None else max(1, min(int(limit), most))


def scoped(view: DataFrame, scope: Mapping[str, object], order: list[str], limit: int | None = None, most: int = 1000) -> DataFrame:
    """The rows of a reporting view that lie in a reader's scope, in order; no more than the cap, which is the feature of such a view."""
    return where(view, scope).orderBy(*order).limit(page_size(limit, most, most))
