"""Compares a query's rows with those of its SQL."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def differences(frame, con, sql: str) -> list:
    """Rows on one side only, a few of each; or unlike column names."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    if sorted(names) != sorted(frame.columns):
        return [("columns", sorted(frame.columns), sorted(names))]
    order = sorted(names)
    there = Counter(tuple(_plain(dict(zip(names, r, strict=True))[c]) for c in order) for r in cursor.fetchall())
    here = Counter(tuple(_plain(r[c]) for c in order) for r in frame.select(*(f"`{c}`" for c in order)).collect())
    return [*list((here - there).items())[:3], *(("sql", x) for x in list((there - here).items())[:3])]
