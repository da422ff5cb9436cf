"""Order-free comparison of a Spark result with another engine's."""

import glob

import duckdb
import numpy as np
import pandas as pd


def engine(folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {p.rsplit('/', 1)[1][:-8]} as select * from read_parquet('{p}')")
    return con


def _cell(v):
    if isinstance(v, (list, np.ndarray)):
        return str([_cell(x) for x in v])
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and v != v):
        return "-"
    if isinstance(v, (float, np.floating)):
        return f"{round(float(v), 5):g}"
    return f"{int(v)}" if isinstance(v, np.integer) else str(v)


def canonical(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(_cell, row)) for row in df.itertuples(index=False))


def same(spark_df, other):
    got = spark_df.toPandas()
    assert sorted(got.columns) == sorted(other.columns)
    a, b = canonical(got), canonical(other)
    assert len(a) == len(b)
    assert a == b
