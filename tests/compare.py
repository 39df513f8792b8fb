"""A query's rows against those of its SQL, without regard to order."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def one(x):
        if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
            return "NULL"
        return repr(float(x)) if isinstance(x, float) else str(x)

    return sorted(tuple(one(x) for x in row) for row in df.itertuples(index=False))


def sql_rows(folder: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con.execute(sql).df()


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
