"""Rows of a Spark query and of its SQL in DuckDB, in one comparable form."""

import math
from pathlib import Path

import duckdb
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or (not isinstance(v, (list, dict)) and pd.api.types.is_scalar(v) and pd.isna(v)):
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(v, 6) + 0.0 if isinstance(v, float) else str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(map(_plain, r)) for r in df[cols].itertuples(index=False)), key=str)
