"""Local twin of the driver's correctness gate: run a Spark query and its
DuckDB oracle on the same parquet tables and compare row count, column set
and an order-insensitive value hash."""

from __future__ import annotations

import hashlib
import math
import os

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, digits: int | None):
    if v is None:
        return "∅"
    try:
        if pd.isna(v):
            return "∅"
    except (TypeError, ValueError):
        pass
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        if math.isfinite(v) and v == int(v) and abs(v) < 2**53:
            return repr(int(v))
        if digits is not None:
            if v == 0:
                return "0"
            return f"{v:.{digits}g}"
        return repr(v)
    if isinstance(v, int):
        return repr(v)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x, digits) for x in v) + "]"
    try:
        import numpy as np
        if isinstance(v, np.ndarray):
            return "[" + ",".join(_norm(x, digits) for x in v.tolist()) + "]"
        if isinstance(v, np.generic):
            return _norm(v.item(), digits)
    except ImportError:
        pass
    return str(v)


def frame_hash(df: pd.DataFrame, digits: int | None = None) -> str:
    cols = sorted(df.columns)
    rows = sorted("|".join(_norm(v, digits) for v in r) for r in df[cols].itertuples(index=False, name=None))
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()[:16]


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame, digits: int = 9) -> dict:
    res = {
        "rows_spark": len(spark_pdf), "rows_duck": len(duck_pdf),
        "cols_match": sorted(spark_pdf.columns) == sorted(duck_pdf.columns),
    }
    res["rows_match"] = res["rows_spark"] == res["rows_duck"]
    if res["cols_match"]:
        res["exact_hash_match"] = frame_hash(spark_pdf) == frame_hash(duck_pdf)
        res["hash_match"] = frame_hash(spark_pdf, digits) == frame_hash(duck_pdf, digits)
    else:
        res["only_spark"] = sorted(set(spark_pdf.columns) - set(duck_pdf.columns))
        res["only_duck"] = sorted(set(duck_pdf.columns) - set(spark_pdf.columns))
        res["hash_match"] = False
    return res


def diff_rows(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame, digits: int = 9, n: int = 5):
    cols = sorted(set(spark_pdf.columns) & set(duck_pdf.columns))
    a = {"|".join(_norm(v, digits) for v in r) for r in spark_pdf[cols].itertuples(index=False, name=None)}
    b = {"|".join(_norm(v, digits) for v in r) for r in duck_pdf[cols].itertuples(index=False, name=None)}
    return cols, sorted(a - b)[:n], sorted(b - a)[:n]
