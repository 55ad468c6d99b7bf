"""Scoring runs: active claims -> per-claim prediction records + run summary
(B6, B10, B14, A21, D13–D19, H1–H5, H14, J1).

A run takes a scored DataFrame (probabilities from a Spark ML model, M18,
or the surrogate used by the oracle tests) and returns lazy DataFrames; the
caller decides where they are written (A11 / A17 / A18 sinks).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import contracts as K
from ..functions import numeric as N
from ..operators import align, scoring
from ..sources.tables import Tables
from . import warehouse as W

DELAY_THRESHOLD = 0.5
FRAUD_THRESHOLD = 0.9
DEFAULT_RUN_TS = _dt.datetime(2026, 4, 28, 0, 0, 0)


def run_id(prefix: str, ts: _dt.datetime = DEFAULT_RUN_TS) -> str:
    """``PREFIX-yyyyMMdd-HHmmss``."""
    return f"{prefix}-{ts:%Y%m%d-%H%M%S}"


def surrogate_scores(ml: DataFrame) -> DataFrame:
    """Deterministic stand-in probabilities for model-free KPI tests:
    delay p = l_quantity/50, fraud p = l_discount·10, cost = payout/8."""
    return ml.withColumns({
        "delay_probability": F.col("l_quantity") / 50.0,
        "fraud_probability": F.col("l_discount") * 10,
        "predicted_cost": F.col("montant_indemnisation_claim") / 8,
    })


def scored_claims(t: Tables) -> DataFrame:
    return surrogate_scores(W.ml_claim(W.clean_layer(t)))


def prediction_month(df: DataFrame, date_col: str = "date_sinistre_claim",
                     fallback: _dt.date = DEFAULT_RUN_TS.date()) -> DataFrame:
    """One row (prediction_year, prediction_month) of the latest claim
    date, falling back to ``fallback`` when there is none."""
    m = df.agg(F.max(date_col).alias("_mx"))
    return m.select(
        F.coalesce(F.year("_mx"), F.lit(fallback.year)).alias("prediction_year"),
        F.coalesce(F.month("_mx"), F.lit(fallback.month)).alias("prediction_month"))


def stamp(df: DataFrame, rid: str, scored_at: _dt.datetime = DEFAULT_RUN_TS) -> DataFrame:
    """Run id, scored_at and a replay-stable record key."""
    return df.withColumns({
        "prediction_record_id": F.sha2(F.concat(F.lit(rid), F.lit("|"), F.col("claim_id")), 256),
        "prediction_run_id": F.lit(rid),
        "scored_at": F.lit(scored_at).cast("timestamp_ntz"),
    })


# --------------------------------------------------------------------------
# delay
# --------------------------------------------------------------------------

DELAY_RECORD_BASE = ["claim_id", "client_id", "contract_id", "vehicle_id", "date_sinistre_claim",
                     "statut_sinistre_claim", "type_sinistre_claim", "type_couverture", "sla_jours"]
DELAY_RECORD_PRED = ["delay_probability", "predicted_delayed", "risk_level", "predicted_excess_days",
                     "delay_cost_at_risk_tnd"]


def delay_predictions(scored: DataFrame, threshold: float = DELAY_THRESHOLD) -> DataFrame:
    active = scoring.required_active(scored)
    amt = align.first_present(active, K.AMOUNT_COLUMNS)
    p = scoring.delay_tiers(active, threshold)
    p = scoring.excess_days(p, threshold)
    return scoring.delay_cost_at_risk(p, amt)


def delay_records(pred: DataFrame, threshold: float = DELAY_THRESHOLD, model_name: str = "surrogate",
                  rid: str | None = None) -> DataFrame:
    """Ordered contract columns that exist, run columns first."""
    rid = rid or run_id("RUN")
    amt = align.first_present(pred, K.AMOUNT_COLUMNS)
    keep = [c for c in DELAY_RECORD_BASE + ([amt] if amt else []) + DELAY_RECORD_PRED if c in pred.columns]
    rec = stamp(pred, rid).select("prediction_record_id", "prediction_run_id", "scored_at", *keep)
    rec = rec.withColumns({"decision_threshold": F.lit(float(threshold)), "model_name": F.lit(model_name)})
    return rec.crossJoin(F.broadcast(prediction_month(pred).select("prediction_month")))


# --------------------------------------------------------------------------
# fraud
# --------------------------------------------------------------------------

FRAUD_RECORD_COLS = ["claim_id", "client_id", "contract_id", "vehicle_id", "type_sinistre_claim",
                     "statut_sinistre_claim", "fraud_probability", "predicted_fraud", "risk_level",
                     "recommended_action", "estimated_investigation_hours", "estimated_investigation_cost_tnd",
                     "expected_fraud_exposure_tnd", "expected_preventable_loss_tnd"]


def fraud_predictions(scored: DataFrame, threshold: float = FRAUD_THRESHOLD) -> DataFrame:
    """B6 (fraud variant): active claims, or every claim when none is active."""
    active = scoring.active_claims(scored)
    if active.isEmpty():
        active = scored
    amt = align.first_present(active, K.FRAUD_AMOUNT_COLUMNS)
    p = scoring.fraud_tiers(active, threshold)
    return scoring.fraud_money(p, amt)


def priority_queue(pred: DataFrame, n: int = K.TOP_QUEUE_SIZE, prob: str = "fraud_probability") -> DataFrame:
    """Top-n by probability (claim id breaks ties), ranked 1..n.
    ``orderBy.limit`` plans as TakeOrderedAndProject: each task keeps n rows."""
    top = pred.orderBy(F.col(prob).desc(), F.col("claim_id").asc()).limit(n)
    from pyspark.sql import Window
    w = Window.orderBy(F.col(prob).desc(), F.col("claim_id").asc())
    return top.withColumn("priority_rank", F.row_number().over(w))


def tiered_queues(pred: DataFrame, n: int = K.TOP_QUEUE_SIZE, prob: str = "fraud_probability") -> DataFrame:
    """TOP_20_RISK (all claims) and CRITICAL_TO_MONITOR (Critical tier),
    each ranked by probability.  row_number <= n per list is planned with a
    per-task group limit before the shuffle (WindowGroupLimit)."""
    from pyspark.sql import Window
    a = pred.withColumn("priority_list_type", F.lit("TOP_20_RISK"))
    b = pred.where(F.col("risk_level") == "Critical").withColumn("priority_list_type", F.lit("CRITICAL_TO_MONITOR"))
    u = a.unionByName(b)
    w = Window.partitionBy("priority_list_type").orderBy(F.col(prob).desc(), F.col("claim_id").asc())
    return u.withColumn("priority_rank", F.row_number().over(w)).where(F.col("priority_rank") <= n)


# --------------------------------------------------------------------------
# cost
# --------------------------------------------------------------------------

def cost_predictions(scored: DataFrame) -> DataFrame:
    return scoring.cost_tiers(scoring.required_active(scored))


# FIXED VALUES — the record contracts of a cost and a fraud run: (column, type, default)
RUN_COLUMNS = [("prediction_record_id", "string", None), ("prediction_run_id", "string", None), ("scored_at", "timestamp_ntz", None)]
CLAIM_COLUMNS = [("claim_id", "string", None), ("client_id", "string", None), ("contract_id", "string", None), ("vehicle_id", "string", None),
                 ("date_sinistre_claim", "timestamp_ntz", None), ("statut_sinistre_claim", "string", None), ("type_sinistre_claim", "string", None)]
COST_RECORD = [*RUN_COLUMNS, *CLAIM_COLUMNS, ("type_couverture", "string", None), ("claim_severity_bucket", "string", None),
               ("predicted_cost", "double", None), ("cost_risk_level", "string", None), ("prediction_month", "int", None)]
COST_SUMMARY = [("prediction_run_id", "string", None), ("scored_at", "timestamp_ntz", None), ("total_active_claims", "int", 0),
                ("total_predicted_cost", "double", 0.0), ("average_cost_per_claim", "double", 0.0), ("high_cost_rate", "double", 0.0),
                ("budget_deviation_risk", "double", 0.0), ("cost_threshold_tnd", "double", 0.0), ("projection_month", "int", None)]
FRAUD_RECORD = [*RUN_COLUMNS, *CLAIM_COLUMNS, ("claim_severity_bucket", "string", None), ("fraud_probability", "double", None),
                ("risk_level", "string", None), ("recommended_action", "string", None), ("predicted_fraud", "int", None),
                ("estimated_investigation_hours", "double", None), ("estimated_investigation_cost_tnd", "double", None),
                ("claim_amount_tnd", "double", 0.0), ("expected_fraud_exposure_claim_tnd", "double", 0.0),
                ("expected_preventable_loss_claim_tnd", "double", 0.0), ("prediction_month", "int", None)]
FRAUD_SUMMARY = [("prediction_run_id", "string", None), ("scored_at", "timestamp_ntz", None), ("model_name", "string", "unknown"),
                 ("threshold_used", "double", 0.0), ("total_scored_claims", "long", 0), ("flagged_for_investigation", "long", 0),
                 ("total_investigation_hours", "double", 0.0), ("expected_fraud_exposure_total_tnd", "double", 0.0),
                 ("expected_preventable_loss_tnd", "double", 0.0), ("expected_review_cost_tnd", "double", 0.0),
                 ("expected_net_savings_tnd", "double", 0.0), ("expected_roi", "double", 0.0), ("low_risk_count", "long", 0),
                 ("medium_risk_count", "long", 0), ("high_risk_count", "long", 0), ("critical_risk_count", "long", 0), ("projection_month", "int", None)]


def _run_summary(kpis: DataFrame, pred: DataFrame, contract: list, renamed: dict[str, str], rid: str) -> DataFrame:
    s = kpis.withColumnsRenamed(renamed).withColumns({"prediction_run_id": F.lit(rid), "scored_at": F.lit(DEFAULT_RUN_TS)})
    s = s.crossJoin(F.broadcast(prediction_month(pred).select(F.col("prediction_month").alias("projection_month"))))      # one row each
    return align.default_filled(s, contract)


def cost_records(pred: DataFrame, rid: str | None = None) -> DataFrame:
    """The cost run's per-claim records by contract."""
    rec = stamp(pred, rid or run_id("COST"))
    return align.default_filled(rec.crossJoin(F.broadcast(prediction_month(pred).select("prediction_month"))), COST_RECORD)


def cost_summary_record(pred: DataFrame, history: DataFrame, rid: str | None = None) -> DataFrame:
    kpis = scoring.cost_kpis(pred, history, align.first_present(history, K.AMOUNT_COLUMNS))
    return _run_summary(kpis, pred, COST_SUMMARY, {"total_predicted_indemnisation_tnd": "total_predicted_cost"}, rid or run_id("COST"))


def fraud_records(pred: DataFrame, rid: str | None = None) -> DataFrame:
    """The fraud run's per-claim records; without an amount column the money is 0."""
    amt = align.first_present(pred, K.FRAUD_AMOUNT_COLUMNS)
    rec = stamp(pred, rid or run_id("FRAUD"))
    if amt:
        money, p = F.coalesce(F.col(amt).cast("double"), F.lit(0.0)), F.col("fraud_probability")
        rec = rec.withColumns({"claim_amount_tnd": money, "expected_fraud_exposure_claim_tnd": p * money,
                               "expected_preventable_loss_claim_tnd": F.when(F.col("predicted_fraud") == 1, p * money * F.lit(K.PREVENTED_LOSS_RATIO))})
    return align.default_filled(rec.crossJoin(F.broadcast(prediction_month(pred).select("prediction_month"))), FRAUD_RECORD)


def fraud_summary_record(pred: DataFrame, threshold: float = FRAUD_THRESHOLD, model_name: str | None = None, rid: str | None = None) -> DataFrame:
    kpis = scoring.fraud_kpis(pred, threshold, align.first_present(pred, K.FRAUD_AMOUNT_COLUMNS))
    if model_name:
        kpis = kpis.withColumn("model_name", F.lit(model_name))
    names = {"expected_fraud_exposure_total": "expected_fraud_exposure_total_tnd", "expected_preventable_loss": "expected_preventable_loss_tnd",
             "expected_review_cost": "expected_review_cost_tnd", "expected_net_savings": "expected_net_savings_tnd", "low_count": "low_risk_count",
             "medium_count": "medium_risk_count", "high_count": "high_risk_count", "critical_count": "critical_risk_count"}
    return _run_summary(kpis, pred, FRAUD_SUMMARY, names, rid or run_id("FRAUD"))
