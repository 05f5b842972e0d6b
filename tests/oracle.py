"""Runs a registered query on Spark and its SQL on DuckDB and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> "duckdb.DuckDBPyConnection":
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{os.path.join(sf_dir, t + '.parquet')}')")
    return con


def _value(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "to_eng_string"):
        return round(float(v), 9) if v % 1 else int(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_value(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_value(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr), [columns[i] for i in order]


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    mine, names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    theirs, other = rows_of([d[0] for d in res.description], res.fetchall())
    if names != other:
        return f"columns {names} != {other}"
    if len(mine) != len(theirs):
        only = [r for r in mine if r not in set(theirs)][:2]
        miss = [r for r in theirs if r not in set(mine)][:2]
        return f"rows {len(mine)} != {len(theirs)}; only spark {only}; only sql {miss}"
    if mine != theirs:
        bad = [(a, b) for a, b in zip(mine, theirs) if a != b][:2]
        return f"values differ: {bad}"
    return None
