"""Rows of a query against rows of its SQL in DuckDB."""

import datetime
import decimal
import glob
import os

import duckdb


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, (float, int)):
        return round(float(value), 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (datetime.date, datetime.timedelta)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr), sorted(names)


def oracle(sql, sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return rows(names, got.fetchall())


def compare(df, sql, sf_dir):
    """Nothing if they agree, else what differs."""
    want, names = oracle(sql, sf_dir)
    got, own = rows(df.columns, [tuple(r) for r in df.collect()])
    if own != names:
        return f"columns {own} against {names}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}: {[r for r in got if r not in want][:2]} {[r for r in want if r not in got][:2]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} rows differ, such as {bad[0]}" if bad else None
