"""A query's rows against those of its SQL."""

import glob
import math
import os

import duckdb


def connection(folder):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else "0" if v == 0 else f"{v:.9g}"
    return str(v)


def same(df, con, sql):
    cols = sorted(df.columns)
    got = sorted(tuple(_cell(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(sql)
    names = list(rel.columns)
    assert sorted(names) == cols
    want = sorted(tuple(_cell(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert got == want
