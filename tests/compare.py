"""Runs a query on Spark and its SQL on DuckDB and compares the rows."""

import math

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return repr(v)
    if hasattr(v, "item"):
        v = v.item()
        return repr(v) if isinstance(v, float) else str(v)
    return str(v)


def rows(frame: pd.DataFrame):
    cols = sorted(frame.columns)
    data = zip(*[frame[c].tolist() for c in cols])
    return cols, sorted(tuple(_cell(v) for v in row) for row in data) if cols else []


def differences(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame, limit: int = 4) -> str:
    """Empty text when both frames hold the same rows."""
    cols_a, a = _sorted(spark_frame)
    cols_b, b = _sorted(sql_frame)
    if cols_a != cols_b:
        return f"columns {cols_a} != {cols_b}"
    if a == b:
        return ""
    only_a = [x for x in a if x not in set(b)][:limit]
    only_b = [x for x in b if x not in set(a)][:limit]
    return f"rows {len(a)} vs {len(b)}; cols {cols_a}\n spark only: {only_a}\n sql only:   {only_b}"


def _sorted(frame):
    cols = sorted(frame.columns)
    data = list(zip(*[[_cell(v) for v in frame[c].tolist()] for c in cols]))
    return cols, sorted(data, key=lambda r: tuple(("" if v is None else v, v is None) for v in r))
