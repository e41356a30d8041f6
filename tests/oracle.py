"""Running a query's SQL in DuckDB over the supplied tables and comparing the rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

from campovia.session import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    """DuckDB with a view for each table of a folder."""
    con = duckdb.connect()
    for name in TABLES:
        path = Path(folder, f"{name}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path / '*.parquet' if path.is_dir() else path}')")
    return con


def _cell(value) -> str:
    if isinstance(value, (list, np.ndarray)):
        return str([_cell(v) for v in value])
    if pd.isna(value):
        return "NULL"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (int, float, np.number)):
        return repr(round(float(value), 9) + 0.0)
    return str(value).removesuffix(" 00:00:00")  # dates come as timestamps from one side


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    """A frame's rows as comparable text, in order."""
    columns = sorted(frame.columns)
    return sorted(tuple(_cell(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))
