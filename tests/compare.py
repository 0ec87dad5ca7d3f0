"""Holds a query's rows against those of its SQL in DuckDB on the same tables."""

from __future__ import annotations

import datetime
import os
from collections import Counter

import duckdb


def plain(x):
    if isinstance(x, float):
        return None if x != x else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def tables(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            path = f"{folder}/{f}"
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def difference(spark, query, sql, folder):
    """What is wrong, or ''."""
    got = query(spark, folder)
    con = tables(folder)
    want = con.sql(sql)
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    names = sorted(got.columns)
    mine = Counter(tuple(plain(r[c]) if not hasattr(r[c], "asDict") else plain(r[c].asDict(True)) for c in names) for r in got.collect())
    at = [want.columns.index(c) for c in names]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    if mine != theirs:
        return f"{sum(mine.values())} rows and {sum(theirs.values())}; only here {list((mine - theirs).items())[:3]}; only there {list((theirs - mine).items())[:3]}"
    return ""
