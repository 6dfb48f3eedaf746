"""Compares a query with its SQL on the same tables in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings universe fiscal_year_ends prices fundamentals panel loads mix_targets".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)

    def cell(x: object) -> str:
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return "~"
        if isinstance(x, (pd.Timestamp,)):
            return str(x)
        if hasattr(x, "isoformat"):
            return str(pd.Timestamp(x))
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        try:
            f = float(x)
            return f"{f + 0.0:.6g}" if f else "0"
        except (TypeError, ValueError):
            return str(x)

    return sorted(tuple(cell(v) for v in r) for r in df[cols].itertuples(index=False, name=None))


def difference(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} / {sorted(sql_df.columns)}"
    a, b = rows(spark_df), rows(sql_df)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}; only one side: {sorted(set(a) ^ set(b))[:4]}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} rows differ: {bad[:2]}" if bad else ""
