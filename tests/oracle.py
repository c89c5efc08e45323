"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v) -> str:
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def same(df, sql: str, sf_dir: str) -> None:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    r = c.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(r.columns)
    order = [r.columns.index(n) for n in names]
    want = sorted(tuple(plain(row[k]) for k in order) for row in r.fetchall())
    got = sorted(tuple(plain(row[n]) for n in names) for row in df.collect())
    assert got == want
