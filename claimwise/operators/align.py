"""Schema alignment at plan-build time.

These act on ``df.columns`` / ``df.schema`` only — no Spark job runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructType, TimestampNTZType, TimestampType

from ..functions import dates as D
from ..functions.text import to_snake_case


def normalize_columns(df: DataFrame) -> DataFrame:
    """B1: snake_case every column name."""
    return df.toDF(*[to_snake_case(c) for c in df.columns])


def require_column(df: DataFrame, aliases: list[str], canonical: str) -> DataFrame:
    """B2: the first alias present wins and is renamed; else a KeyError
    listing what was tried."""
    cols = set(df.columns)
    for a in aliases:
        if a in cols:
            return df if a == canonical else df.withColumnRenamed(a, canonical)
    raise KeyError(f"Missing required column '{canonical}'. Tried: {aliases}. "
                   f"Available: {df.columns[:30]}")


def whitelist(df: DataFrame, keep: list[str]) -> DataFrame:
    """Keep the listed columns that exist, in list order."""
    return df.select(*[c for c in keep if c in df.columns])


def drop_present(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop listed columns that exist."""
    return df.drop(*[c for c in cols if c in df.columns])


def first_present(df: DataFrame, candidates: list[str]) -> str | None:
    """The first candidate column that exists."""
    return next((c for c in candidates if c in df.columns), None)


def schema_diff(new_cols: list[str], existing_cols: list[str]) -> tuple[list[str], list[str]]:
    """(missing from new, extra in new)."""
    missing = [c for c in existing_cols if c not in new_cols]
    extra = [c for c in new_cols if c not in existing_cols]
    return missing, extra


def validate_and_cast(new: DataFrame, target: StructType) -> DataFrame:
    """Add missing columns as typed nulls, drop extras, reorder, cast to
    the target type; values that do not convert become null."""
    out = []
    for f in target.fields:
        if f.name in new.columns:
            src = F.col(f.name)
            if new.schema[f.name].dataType == f.dataType:
                out.append(src.alias(f.name))
            else:
                dates = (TimestampNTZType, TimestampType, DateType)
                if isinstance(f.dataType, dates) and isinstance(new.schema[f.name].dataType, StringType):
                    # day-first and ISO texts alike
                    src = D.to_ts(f.name)
                out.append(src.try_cast(f.dataType).alias(f.name))
        else:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
    return new.select(*out)


def header_check(columns: list[str], expected: list[str]) -> list[str]:
    """A4: expected columns missing from the header (case-insensitive)."""
    have = {c.strip().lower() for c in columns}
    return [e for e in expected if e.lower() not in have]


def map_to_contract(df: DataFrame, expected: list[str]) -> DataFrame:
    """Select contract columns by case-insensitive match, ignore extras."""
    by_lower = {c.strip().lower(): c for c in df.columns}
    return df.select(*[F.col(f"`{by_lower[e.lower()]}`").alias(e) for e in expected if e.lower() in by_lower])


def default_filled(df: DataFrame, contract: list[tuple[str, str, object]]) -> DataFrame:
    """Exactly the contract's columns, (name, type, default) in its order: a column
    that is absent, and a null in one, gets the default; None leaves nulls."""
    out = []
    for name, kind, default in contract:
        c = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        out.append((c if default is None else F.coalesce(c, F.lit(default).cast(kind))).alias(name))
    return df.select(*out)
