"""Holds a query's rows against its SQL."""

import numbers

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, numbers.Real) and not isinstance(v, (bool, np.bool_)):
        return str(round(float(v), 6))  # pandas gives whole numbers beside nulls as floats
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(_cell(v) for v in r) for r in df.astype(object).itertuples(index=False))


def check(spark, sf_dir, query, sql):
    got, want = query(spark, sf_dir).toPandas(), connection(sf_dir).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
