"""Compares queries with their SQL twins in DuckDB."""

import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def connect(sf_dir=DATA):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def assert_same(spark, query, sql, sf_dir=DATA, con=None):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = (con or connect(sf_dir)).execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(names) == cols
    a = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    b = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=repr)
    assert a == b
