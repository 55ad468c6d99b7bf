"""Nested run documents (A18): one JSON document per scoring or forecast run, for a
dashboard to read.

A document is one row of structs, maps and arrays, assembled by aggregates and
written with ``to_json``.  Arrays hold what the document's contract bounds — the
top claims of a run, the months of a horizon and the at most four alerts of a
month — in a stated order that travels with the elements (``array_sort`` on a key),
not the order in which tasks deliver them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contracts as K
from ..operators import forecast as FC
from ..operators import scoring
from . import runs

CURRENCY = "TND"
TOP_DELAY, TOP_FRAUD = 15, K.TOP_QUEUE_SIZE

DELAY_SUMMARY = ["total_active_claims", "predicted_delayed_count", "predicted_on_time_count", "predicted_delay_rate_pct", "high_risk_count",
                 "medium_risk_count", "low_risk_count", "total_excess_days", "avg_excess_days_per_delayed", "total_amount_at_risk_tnd",
                 "cost_at_risk_tnd", "estimated_delay_penalty_tnd", "recommended_agents", "staffing_cost_tnd"]
DELAY_TOP = ["claim_id", "delay_probability", "predicted_excess_days", "delay_cost_at_risk_tnd", "type_sinistre_claim", "sla_jours"]
FRAUD_TOP = ["claim_id", "fraud_probability", "risk_level", "recommended_action", "client_id", "contract_id", "type_sinistre_claim",
             "statut_sinistre_claim", "predicted_fraud", "montant_indemnisation_claim"]
MONTH_HEAD = ["month", "year", "month_number", "seasonal_context", "risk_level", "is_surge_month", "volume_surge_pct"]


def ordered_array(rows: DataFrame, key: Column, fields: Column, name: str) -> DataFrame:
    """One row: the rows as an array of ``fields`` in the order of ``key``; empty for no rows."""
    a = rows.agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), fields.alias("r")))).alias("a"))
    return a.select(F.transform("a", lambda x: x["r"]).alias(name))


def top_claims(pred: DataFrame, prob: str, n: int, fields: list[str], name: str) -> DataFrame:
    """The n most probable claims (claim id breaks ties): n rows a task, then one array."""
    top = pred.orderBy(F.col(prob).desc(), F.col("claim_id")).limit(n)
    have = [c for c in fields if c in pred.columns]
    return ordered_array(top, F.struct((-F.col(prob)).alias("p"), F.col("claim_id").alias("c")), F.struct(*have), name)


def _distribution(rows: DataFrame, col: str, name: str) -> DataFrame:
    """One row: value -> number of rows, for a column of few values."""
    per = rows.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(col, "n")))).alias(name))


def _beside(*parts: DataFrame) -> DataFrame:
    """One-row tables side by side."""
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))
    return out


def delay_document(pred: DataFrame, threshold: float = runs.DELAY_THRESHOLD, model_name: str = "surrogate",
                   scored_at=runs.DEFAULT_RUN_TS) -> DataFrame:
    s = scoring.delay_run_summary(pred, threshold, "montant_indemnisation_claim")
    high = top_claims(pred.where(F.col("risk_level") == "High"), "delay_probability", TOP_DELAY, DELAY_TOP, "top_high_risk_claims")
    return _beside(s, _distribution(pred, "risk_level", "risk_distribution"), high).select(
        F.lit(str(scored_at)).alias("run_timestamp"), F.lit(model_name).alias("model_name"), "decision_threshold",
        F.lit(CURRENCY).alias("currency"), F.struct(*DELAY_SUMMARY).alias("summary"), "risk_distribution", "top_high_risk_claims")


def fraud_document(pred: DataFrame, threshold: float = runs.FRAUD_THRESHOLD) -> DataFrame:
    kpis = scoring.fraud_kpis(pred, threshold, "montant_indemnisation_claim")
    top = top_claims(pred, "fraud_probability", TOP_FRAUD, FRAUD_TOP, "top_suspicious_claims")
    assumed = F.struct(F.lit(K.PREVENTED_LOSS_RATIO).alias("prevented_loss_ratio"), F.lit(K.AGENT_HOURLY_RATE).alias("agent_hourly_rate"),
                       F.lit("montant_indemnisation_claim").alias("amount_column"))
    return _beside(kpis, _distribution(pred, "risk_level", "risk_distribution"), top).select(
        F.struct(*kpis.columns, "risk_distribution", assumed.alias("assumptions")).alias("summary"), "top_suspicious_claims")


def _named(prefix: str, columns: list[str]) -> Column:
    return F.struct(*[F.col(c).alias(c.removeprefix(prefix)) for c in columns if c.startswith(prefix)])


def forecast_document(monthly: DataFrame, run_timestamp=runs.DEFAULT_RUN_TS) -> DataFrame:
    cols = monthly.columns
    month = F.struct(F.col("period_label").alias("period"), *MONTH_HEAD, _named("forecast_", cols).alias("forecast"),
                     _named("kpi_", cols).alias("business_kpis"), "alerts", "recommendations")
    details = ordered_array(monthly, F.col("period"), month, "monthly_details")
    flat = FC.flatten_month(monthly)
    table = ordered_array(flat, F.col("period"), F.struct(F.col("period_label").alias("period"), *[c for c in flat.columns if c not in ("period", "period_label")]),
                          "flat_table")
    s = FC.portfolio_summary(monthly)
    assumed = F.struct(F.lit(K.AGENT_MONTHLY_SALARY).alias("agent_monthly_salary_tnd"), F.lit(K.AGENT_MONTHLY_CAPACITY).alias("agent_monthly_capacity_claims"),
                       F.lit(K.DELAY_COST_PER_CLAIM).alias("delay_cost_per_claim_tnd"),
                       F.lit(K.EARLY_INTERVENTION_EFFICIENCY * 100).alias("early_intervention_efficiency_pct"))
    return _beside(s.select(F.struct(*s.columns).alias("summary")), details, table).select(
        F.lit(str(run_timestamp)).alias("run_timestamp"), F.lit(K.FORECAST_HORIZON).alias("forecast_horizon_months"),
        F.lit(CURRENCY).alias("currency"), "summary", "monthly_details", "flat_table", assumed.alias("business_assumptions"))


def write_document(doc: DataFrame, path: str) -> None:
    """The one-row document as a JSON text; fields that are null stay as null."""
    doc.select(F.to_json(F.struct(*doc.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", schema).alias("d")).select("d.*")
