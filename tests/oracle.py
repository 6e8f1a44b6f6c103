"""Compares a query with its SQL on the same tables."""

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def check(spark, query, sql, sf_dir):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df, rel = query(spark, sf_dir), con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [list(rel.columns).index(c) for c in columns]
    got = sorted(repr(tuple(norm(r[c]) for c in columns)) for r in df.collect())
    want = sorted(repr(tuple(norm(r[i]) for i in at)) for r in rel.fetchall())
    assert got == want
