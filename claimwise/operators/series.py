"""Monthly KPI series.

Series are built with one grouped aggregate over the claims (partial
aggregation, shuffle of one row per (series key, month) per task).  Everything
after that works on the aggregated series, whose size is bounded by the
calendar (months × series keys), not by the claim count; windows over it are
partitioned by the series key when there is one.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import contracts as K
from . import scoring

KPI_NAMES = [k for k, _, _ in K.KPI_DEFINITIONS]


def _agg_expr(kind: str, col: str) -> Column:
    c = F.col(col).cast("double")
    if kind == "count":
        return F.count(F.col(col)).cast("double")
    if kind == "sum":
        # pandas: the sum over only missing values is 0 (ruling Q10)
        return F.coalesce(F.sum(c), F.lit(0.0))
    if kind == "mean":
        return F.avg(c)
    raise ValueError(kind)


def monthly_series(claims: DataFrame, kpis=None, group_cols: list[str] | None = None,
                   date_col: str = "date_sinistre_claim",
                   as_of: _dt.date | None = None) -> DataFrame:
    """H11 + J9: closed claims by month -> one column per KPI.  With
    ``as_of``, months at or after the as-of month are dropped (incomplete)."""
    kpis = kpis or K.KPI_DEFINITIONS
    group_cols = group_cols or []
    df = scoring.closed_claims(claims).where(F.col(date_col).isNotNull())
    df = df.withColumn("period", F.trunc(F.col(date_col).cast("date"), "MM"))
    aggs = [_agg_expr(kind, col).alias(name) for name, kind, col in kpis if col in claims.columns]
    out = df.groupBy(*group_cols, "period").agg(*aggs)
    if as_of is not None:
        out = out.where(F.col("period") < F.trunc(F.lit(as_of), "MM"))
    return out


def fill_month_gaps(series: DataFrame, value_cols: list[str], group_cols: list[str] | None = None) -> DataFrame:
    """Complete month grid from first to last month (per group) and linear
    interpolation of every missing value by month position; values after the
    last known one repeat it, values before the first stay null (pandas
    ``interpolate(method='linear')``)."""
    group_cols = group_cols or []
    bounds = series.groupBy(*group_cols).agg(F.min("period").alias("_lo"), F.max("period").alias("_hi"))
    grid = bounds.select(*group_cols, F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 month"))).alias("period"),
                         "_lo")
    g = grid.join(series, on=[*group_cols, "period"], how="left")
    g = g.withColumn("_idx", F.months_between("period", "_lo").cast("int"))
    back = Window.partitionBy(*group_cols).orderBy("_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fwd = Window.partitionBy(*group_cols).orderBy("_idx").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    fills = {}
    for c in value_cols:
        pv = F.last(F.col(c), ignorenulls=True).over(back)
        pi = F.last(F.when(F.col(c).isNotNull(), F.col("_idx")), ignorenulls=True).over(back)
        nv = F.first(F.col(c), ignorenulls=True).over(fwd)
        ni = F.first(F.when(F.col(c).isNotNull(), F.col("_idx")), ignorenulls=True).over(fwd)
        interp = pv + (nv - pv) * (F.col("_idx") - pi) / (ni - pi)
        fills[c] = (F.when(F.col(c).isNotNull(), F.col(c))
                     .when(pv.isNotNull() & nv.isNotNull(), interp)
                     .when(pv.isNotNull(), pv))
    return g.withColumns(fills).drop("_lo", "_idx")


def to_long(series: DataFrame, value_cols: list[str], group_cols: list[str] | None = None) -> DataFrame:
    """Wide (period, kpi...) -> long (kpi, period, value) via stack."""
    group_cols = group_cols or []
    pairs = ", ".join(f"'{c}', `{c}`" for c in value_cols)
    return series.select(*group_cols, "period",
                         F.expr(f"stack({len(value_cols)}, {pairs}) as (kpi, value)"))


def baselines(long: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """H12 + J10: per KPI mean, sample std, last-3 mean and last-12 mean (all
    months when fewer than 12)."""
    keys = [*(group_cols or []), "kpi"]
    w = Window.partitionBy(*keys).orderBy(F.col("period").desc())
    r = long.withColumn("_rn", F.row_number().over(w))
    return r.groupBy(*keys).agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.avg(F.when(F.col("_rn") <= 3, F.col("value"))).alias("last_3m_avg"),
        F.when(F.count(F.lit(1)) >= 12, F.avg(F.when(F.col("_rn") <= 12, F.col("value"))))
         .otherwise(F.avg("value")).alias("last_12m_avg"),
        F.count(F.lit(1)).alias("n_months"),
        F.max("period").alias("last_period"),
    )


def trailing_mean(series: DataFrame, col: str, n: int, group_cols: list[str] | None = None) -> DataFrame:
    """J10 as a running window: mean of the last n months at every month."""
    w = Window.partitionBy(*(group_cols or [])).orderBy("period").rowsBetween(-(n - 1), 0)
    return series.withColumn(f"{col}_trailing_{n}m", F.avg(col).over(w))
