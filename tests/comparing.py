"""Hold a query's rows against SQL run by DuckDB on the same files."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

DATA = Path("/root/testdata")


def tables(sf: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for p in (DATA / sf).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return connection


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(x: object) -> object:
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        if hasattr(x, "item"):
            x = x.item()
        return round(x, 6) if isinstance(x, float) else x

    named = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in named.astype(object).where(named.notna(), None).values.tolist()), key=str)
