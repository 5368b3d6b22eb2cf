"""Compare a query with its SQL in DuckDB, as sets of rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, decimal.Decimal):
        return round(float(x), 5)
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, int):
        return float(x)
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return str(x)


def same(df, con, sql: str) -> None:
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=str)
    assert len(got) == len(want)
    assert got == want
