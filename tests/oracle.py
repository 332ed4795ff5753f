"""Comparison of a query with its SQL, run by DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest


def connection(data):
    con = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if f.is_dir() else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v) if v is not None and not isinstance(v, (int, str, bool)) else v


def compare(df, con, sql):
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    rows = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in want.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert len(got) == len(rows)
    for a, b in zip(got, rows, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, (int, float)) and x == pytest.approx(y, rel=1e-6, abs=1e-6)), (a, b)
