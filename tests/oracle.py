"""Compare queries with their SQL on DuckDB."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def canon(frame):
    cols = sorted(frame.columns)
    rows = [tuple(None if pd.isna(v) else (float(v) if isinstance(v, float) else (int(v) if type(v).__name__.startswith(("int", "uint")) else str(v))) for v in r) for r in frame[cols].astype(object).itertuples(index=False)]
    return cols, sorted(rows, key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def same(spark, con, fn, sql: str, sf_dir: str) -> str:
    """Empty if the rows are the same, else what differs."""
    got, want = canon(fn(spark, sf_dir).toPandas()), canon(con.sql(sql).df())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} and {len(want[1])} rows"
    odd = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    return f"{len(odd)} rows differ, such as {odd[0]}" if odd else ""
