"""Many-series forecasting with candidate search (M20) and a stationarity
check (M21), as one grouped Spark job.

Each (series, candidate order) pair is one group of ``applyInPandas``: the
series rows are replicated per candidate with ``explode`` over the fixed
candidate list, so the 7 fits of every series run in parallel tasks and the
job scales with the number of series (KPI × any grouping such as region or
coverage).  Inside a group the fit is a Hannan–Rissanen two-stage least
squares estimate of the seasonal ARIMA in numpy; AIC is computed on a sample
common to all candidates so that orders with different differencing compare.
The winner per series is the lowest AIC (``min_by``), falling back in
candidate order when fits fail.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import contracts as K

COMMON_START = 40          # first index of the common AIC sample
HOLDOUT = K.HOLDOUT_MONTHS
ADF_CRIT_5PCT = -2.86      # Dickey–Fuller, constant, large sample

OUT_SCHEMA = ("kpi string, candidate int, order_label string, ok boolean, aic double, holdout_mae double, "
              "holdout_mape double, holdout_rmse double, adf_stat double, stationary boolean, "
              "forecast array<double>")


def _difference(y: np.ndarray, d: int, D: int, s: int) -> np.ndarray:
    x = y.astype(float)
    for _ in range(D):
        x = x[s:] - x[:-s]
    for _ in range(d):
        x = x[1:] - x[:-1]
    return x


def _lags(p: int, P: int, s: int) -> list[int]:
    base = list(range(1, p + 1))
    seas = [s * i for i in range(1, P + 1)] if s else []
    cross = [s * i + j for i in range(1, P + 1) for j in range(1, p + 1)] if s else []
    return sorted(set(base + seas + cross))


def _design(x: np.ndarray, ar: list[int], e: np.ndarray | None, ma: list[int], start: int):
    rows = []
    for t in range(start, len(x)):
        r = [x[t - l] for l in ar]
        if e is not None:
            r += [e[t - l] for l in ma]
        rows.append(r)
    return np.asarray(rows, dtype=float).reshape(len(rows), len(ar) + (len(ma) if e is not None else 0))


def _fit(y: np.ndarray, order, seasonal):
    p, d, q = order
    P, D, Q, s = seasonal
    x = _difference(y, d, D, s)
    ar, ma = _lags(p, P, s), _lags(q, Q, s)
    e = None
    if ma:
        m = min(max(ar + ma + [1]) + 4, max(len(x) // 3, 1))
        long_ar = list(range(1, m + 1))
        X1 = _design(x, long_ar, None, [], m)
        b1, *_ = np.linalg.lstsq(X1, x[m:], rcond=None) if len(X1) else (np.zeros(m),)
        e = np.zeros_like(x)
        e[m:] = x[m:] - X1 @ b1
    lag_max = max(ar + ma + [0])
    start = max(lag_max, len(long_ar) if ma else 0) if ma else lag_max
    X = _design(x, ar, e, ma, start)
    target = x[start:]
    beta, *_ = np.linalg.lstsq(X, target, rcond=None) if X.shape[1] else (np.zeros(0),)
    resid = target - (X @ beta if X.shape[1] else 0.0)
    return x, ar, ma, e, beta, resid, start


def _forecast(y: np.ndarray, order, seasonal, steps: int) -> np.ndarray:
    p, d, q = order
    P, D, Q, s = seasonal
    x, ar, ma, e, beta, resid, start = _fit(y, order, seasonal)
    xs = list(x)
    es = list(e) if e is not None else []
    if e is not None:
        es[start:] = list(resid)
    for _ in range(steps):
        t = len(xs)
        r = [xs[t - l] for l in ar] + ([es[t - l] if t - l < len(es) else 0.0 for l in ma] if e is not None else [])
        xs.append(float(np.dot(beta, r)) if len(r) else 0.0)
        if e is not None:
            es.append(0.0)
    fut = np.asarray(xs[len(x):])
    # undo differencing: regular first, then seasonal
    levels = [y.astype(float)]
    for _ in range(D):
        levels.append(levels[-1][s:] - levels[-1][:-s])
    for _ in range(d):
        levels.append(levels[-1][1:] - levels[-1][:-1])
    cur = fut
    for _ in range(d):
        base = levels.pop(-2)
        hist = list(base)
        for v in cur:
            hist.append(hist[-1] + v)
        cur = np.asarray(hist[len(base):])
    for _ in range(D):
        base = levels.pop(-2)
        hist = list(base)
        for v in cur:
            hist.append(hist[-s] + v)
        cur = np.asarray(hist[len(base):])
    return cur


def _aic(y: np.ndarray, order, seasonal) -> float:
    p, d, q = order
    P, D, Q, s = seasonal
    _x, ar, ma, _e, beta, resid, start = _fit(y, order, seasonal)
    shift = d + D * s                       # index of x[0] in y
    first = max(COMMON_START - shift - start, 0)
    r = resid[first:]
    n = len(r)
    if n < 5:
        return float("inf")
    sse = float(np.dot(r, r))
    k = len(beta) + 1
    return n * np.log(max(sse, 1e-12) / n) + 2 * k


def _adf(y: np.ndarray) -> float:
    dy = np.diff(y)
    if len(dy) < 6:
        return float("nan")
    Y = dy[1:]
    X = np.column_stack([np.ones(len(Y)), y[1:-1], dy[:-1]])
    beta, *_ = np.linalg.lstsq(X, Y, rcond=None)
    res = Y - X @ beta
    dof = max(len(Y) - X.shape[1], 1)
    s2 = float(res @ res) / dof
    cov = s2 * np.linalg.pinv(X.T @ X)
    return float(beta[1] / np.sqrt(cov[1, 1])) if cov[1, 1] > 0 else float("nan")


def _fit_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("period")
    kpi = str(pdf["kpi"].iloc[0])
    cid = int(pdf["candidate"].iloc[0])
    order, seasonal = K.SARIMA_CANDIDATES[cid]
    y = pdf["value"].astype(float).to_numpy()
    y = y[~np.isnan(y)]
    label = f"{order}x{seasonal}"
    row = dict(kpi=kpi, candidate=cid, order_label=label, ok=False, aic=None, holdout_mae=None,
               holdout_mape=None, holdout_rmse=None, adf_stat=None, stationary=None, forecast=None)
    need = order[1] + seasonal[1] * seasonal[3] + max(_lags(*order[:1], seasonal[0], seasonal[3]) + [1]) + 8
    try:
        if len(y) < max(K.MIN_MONTHS_REQUIRED, need + HOLDOUT):
            raise ValueError("series too short")
        row["aic"] = float(_aic(y, order, seasonal))
        fc_h = _forecast(y[:-HOLDOUT], order, seasonal, HOLDOUT)
        act = y[-HOLDOUT:]
        err = fc_h - act
        row["holdout_mae"] = float(np.mean(np.abs(err)))
        row["holdout_mape"] = float(np.mean(np.abs(err) / (np.abs(act) + 1e-9)) * 100)
        row["holdout_rmse"] = float(np.sqrt(np.mean(err ** 2)))
        row["forecast"] = [float(v) for v in _forecast(y, order, seasonal, K.FORECAST_HORIZON)]
        a = _adf(y)
        row["adf_stat"] = a
        row["stationary"] = bool(a < ADF_CRIT_5PCT) if np.isfinite(a) else None
        row["ok"] = bool(np.isfinite(row["aic"]) and np.all(np.isfinite(row["forecast"])))
    except Exception:  # noqa: BLE001 - a failed candidate is reported, others still compete
        row["ok"] = False
    return pd.DataFrame([row])


def fit_candidates(long: DataFrame) -> DataFrame:
    """(kpi, period, value) -> one row per (kpi, candidate) with AIC, hold-out
    metrics, ADF statistic and the horizon forecast."""
    cands = F.array(*[F.lit(i) for i in range(len(K.SARIMA_CANDIDATES))])
    rep = long.select("kpi", "period", "value").withColumn("candidate", F.explode(cands))
    return rep.groupBy("kpi", "candidate").applyInPandas(_fit_group, OUT_SCHEMA)


def select_models(fits: DataFrame) -> DataFrame:
    """Lowest AIC per series among successful fits; candidate order breaks
    ties and is the fallback order."""
    ok = fits.where(F.col("ok"))
    return ok.groupBy("kpi").agg(F.min_by(F.struct(*[c for c in fits.columns if c != "kpi"]),
                                          F.struct("aic", "candidate")).alias("m")).select("kpi", "m.*")


def forecast_long(selected: DataFrame, grid: DataFrame) -> DataFrame:
    """Selected forecasts as (kpi, period, value) on the horizon grid."""
    # the grid holds the horizon months only (6 rows)
    g = grid.withColumn("_h", F.row_number().over(Window.orderBy("period")) - 1)
    ex = selected.select("kpi", F.posexplode("forecast").alias("_h", "value"))
    return ex.join(F.broadcast(g), "_h").select("kpi", "period", "value")


def arima_forecaster(long: DataFrame, grid: DataFrame) -> DataFrame:
    """Forecaster plug-in for ``plans.forecast_run.run``."""
    return forecast_long(select_models(fit_candidates(long)), grid)
