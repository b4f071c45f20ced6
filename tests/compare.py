"""Rows of a Spark query against those of its SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd


def shown(value) -> str:
    if value is None or value is pd.NA or value is pd.NaT or value != value:
        return "~"
    if isinstance(value, (str, bool)) or type(value).__name__ == "bool_":
        return str(value)
    return repr(float(value))


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    columns = sorted(df.columns)
    return sorted(zip(*[[shown(v) for v in df[c].astype(object)] for c in columns])) if len(df) else []


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
