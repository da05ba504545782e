"""A query's rows against its SQL on another engine."""

import glob
import os

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        source = p if os.path.isfile(p) else f"{p}/*.parquet"
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{source}'")
    return c


def _cell(v) -> str:
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, float):
        return f"{v:.9g}"
    if hasattr(v, "__len__") and not isinstance(v, (str, dict, bytes)):
        return str(list(v))
    return str(v)


def rows(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].map(_cell)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def same(spark_df, sql: str, folder: str) -> None:
    a, b = rows(spark_df.toPandas()), rows(connect(folder).execute(sql).df())
    assert list(a.columns) == list(b.columns)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
