"""Comparison of a Spark frame with DuckDB's answer to its SQL twin."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def connect(sf=SF):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def same(df, sql, con):
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([plain(dict(zip(names, r, strict=True))[n]) for n in sorted(names)]) for r in found.fetchall())
    got = sorted(repr([plain(r[n]) for n in sorted(names)]) for r in df.collect())
    assert got == want
