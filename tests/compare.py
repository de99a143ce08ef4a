"""Compares a query's rows with its SQL's rows in DuckDB."""

import decimal
import glob
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def same(df, con, sql):
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(sql)
    names = list(rel.columns)
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    assert got == want
