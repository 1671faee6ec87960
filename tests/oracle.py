"""Runs registered queries beside their SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

from mergelake.plans.registry import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).tz_localize(None).isoformat()
    if isinstance(v, (bool, str, bytes)):
        return v
    if hasattr(v, "__iter__"):
        return tuple(_plain(x) for x in v)
    v = float(v)
    return int(v) if v.is_integer() else v


def rows(frame: pd.DataFrame) -> list[tuple]:
    """Values by column name, sorted."""
    cols = sorted(frame.columns)
    return sorted((tuple(_plain(v) for v in r) for r in frame[cols].itertuples(index=False)), key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))
