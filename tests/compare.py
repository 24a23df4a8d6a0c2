"""Rows of Spark and of DuckDB, made comparable."""

import os

import duckdb
import pandas as pd


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or pd.api.types.is_scalar(v) and pd.isna(v):
            return "~"
        if isinstance(v, float):
            return f"{v + 0.0 if v else 0.0:.9g}"
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        return str(v.tolist() if hasattr(v, "tolist") else v)

    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


def tables(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con
