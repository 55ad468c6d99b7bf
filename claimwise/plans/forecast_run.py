"""Forecast run: ml_claim -> monthly KPI history -> 6-month forecast with
business KPIs, alerts and a portfolio summary (H11–H13, J8–J10, K1–K12).

The point forecaster is pluggable: ``seasonal_naive`` (deterministic, used by
the oracle tests) or the grouped ARIMA-family fit in
``models/timeseries.py`` (M20), which returns the same long shape.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import contracts as K
from ..operators import forecast as FC
from ..operators import scoring, series
from ..session import written

AS_OF = _dt.date(2026, 4, 28)
KPIS = series.KPI_NAMES


@dataclass
class ForecastRun:
    history: DataFrame      # wide, gap-filled (period DATE + KPI columns)
    long: DataFrame         # (kpi, period, value)
    baselines: DataFrame    # per KPI
    point: DataFrame        # (kpi, period, value) raw point forecasts
    adjusted: DataFrame     # after K1–K3
    monthly: DataFrame      # K5–K8, K10 per month


def monthly_history(ml: DataFrame, as_of: _dt.date = AS_OF) -> DataFrame:
    s = series.monthly_series(ml, as_of=as_of)
    return series.fill_month_gaps(s, [k for k in KPIS if k in s.columns])


def run(ml: DataFrame, horizon: int = K.FORECAST_HORIZON, as_of: _dt.date = AS_OF,
        forecaster=None) -> ForecastRun:
    hist = written(monthly_history(ml, as_of), "monthly-history")       # one row a month; all later steps read it
    kp = [k for k in KPIS if k in hist.columns]
    long = series.to_long(hist, kp)
    base = series.baselines(long)
    live = scoring.active_claims(ml).agg(F.max("date_sinistre_claim").alias("_live"))
    end = hist.agg(F.max("period").alias("_end"))
    anchor = end.crossJoin(live).select(FC.anchor_month(F.col("_end"), F.col("_live").cast("date"), F.lit(as_of)).alias("anchor"))
    grid = FC.horizon_grid(anchor, horizon)
    point = (forecaster or FC.seasonal_naive)(long, grid)
    adj = FC.adjust(point, base)
    monthly = written(FC.business_kpis(FC.to_wide(adj), base), "forecast-months")     # a row per month ahead
    return ForecastRun(hist, long, base, point, adj, monthly)
