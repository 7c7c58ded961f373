"""Comparison of a query with its SQL, as sets of rows by sorted column names."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return repr(v)
    return str(v)


def rows(df):
    names = sorted(df.columns)
    whole = {c for c in names if pd.api.types.is_float_dtype(df[c]) and df[c].dropna().mod(1).eq(0).all()}
    out = [tuple(_plain(int(v)) if c in whole and v == v and v is not None else _plain(v) for c, v in zip(names, r)) for r in df[names].itertuples(index=False)]
    return names, sorted(out)


def assert_same(spark, sf_dir, name, query, sql):
    a, b = rows(query(spark, sf_dir).toPandas()), rows(connect(sf_dir).execute(sql).fetchdf())
    assert a[0] == b[0], name
    assert len(a[1]) == len(b[1]), name
    different = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    assert not different, (name, different[:2])
