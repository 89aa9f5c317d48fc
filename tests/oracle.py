"""Runs a query's SQL in DuckDB and compares it with Spark's rows, columns by name, rows in any order."""

import os

import duckdb
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return con


def _text(v):
    if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
        return "~"
    return repr(round(float(v), 9)) if isinstance(v, float) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    whole = [df[c].dropna() for c in df.columns]
    cols = [df[c].map(lambda v, i=i: _text(int(v) if isinstance(v, float) and v == v and (whole[i] % 1 == 0).all() else v)) for i, c in enumerate(df.columns)]
    return list(df.columns), sorted(zip(*cols))
