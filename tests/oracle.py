"""Compares a query with its SQL on the same tables."""

import datetime
import math
from pathlib import Path

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v)


def differences(spark, sf_dir, query, sql, con=None):
    """(number of rows, rows only in Spark's result, rows only in DuckDB's, column names if they differ)."""
    df = query(spark, sf_dir)
    got = sorted(tuple(_cell(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cur = (con or connection(sf_dir)).execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    want = sorted(tuple(_cell(r[k]) for k in order) for r in cur.fetchall())
    columns = None if sorted(df.columns) == sorted(names) else (sorted(df.columns), sorted(names))
    ours, theirs = set(got), set(want)
    return len(got), sorted(ours - theirs)[:3], sorted(theirs - ours)[:3], columns, len(want)
