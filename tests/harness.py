"""Run a registered Spark query and its DuckDB oracle on the same tables and
compare them as multisets of rows (columns sorted by name)."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

from mirage.sources.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return tuple(_norm(x) for x in v.tolist())
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(v) for v in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, name: str, sf_dir: str, queries: dict, oracle: dict):
    sdf = queries[name](spark, sf_dir)
    s_rows = sdf.toPandas()
    con = duck(sf_dir)
    o_rows = con.execute(oracle[name]).df()
    s_cols, o_cols = sorted(s_rows.columns), sorted(o_rows.columns)
    if s_cols != o_cols:
        return False, f"columns differ: spark-only {set(s_cols)-set(o_cols)} oracle-only {set(o_cols)-set(s_cols)}"
    a, b = rows_of(s_rows), rows_of(o_rows)
    if len(a) != len(b):
        return False, f"row count spark={len(a)} oracle={len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return False, f"first diff: spark={x} oracle={y} cols={s_cols}"
    return True, f"{len(a)} rows"
