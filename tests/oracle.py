"""Compares a query with its SQL on one directory of tables."""

import os

import duckdb
import pandas as pd


def connection(path):
    c = duckdb.connect()
    c.sql("SET timezone='UTC'")
    for f in os.listdir(path):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}/{f}'")
    return c


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        values = df[c]
        if values.map(lambda v: v is None or v is pd.NA or (isinstance(v, (int, float)) and not isinstance(v, bool))).all() or str(values.dtype)[:1] in "iIfFuU":
            df[c] = pd.to_numeric(values.where(values.notna(), None)).astype(float)
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple("null" if v is None or v is pd.NaT or v is pd.NA or v != v else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r))
    return sorted(out)


def same(spark, name, query, sql, path):
    got, want = query(spark, path).toPandas(), connection(path).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns), name
    assert rows(got) == rows(want), name
