"""Compares a query with DuckDB's result for its SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).iterdir()):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{source}'")
    return con


def _cell(value) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return str(value)


def sorted_rows(frame) -> list[tuple[str, ...]]:
    columns = sorted(frame.columns)
    return sorted(tuple(map(_cell, row)) for row in frame[columns].itertuples(index=False))


def assert_same(found, expected) -> None:
    assert sorted(found.columns) == sorted(expected.columns)
    assert sorted_rows(found) == sorted_rows(expected)
