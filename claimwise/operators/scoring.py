"""Scoring operators: tiers, per-claim money columns and KPI roll-ups
(B6–B8, D13–D19, D22, H1–H10, H21–H23).

Every operator takes a scored DataFrame with a probability / prediction
column, so it works the same on a Spark ML model output (M18) or on a
surrogate probability.  Every roll-up is a single aggregate (count_if /
sum(when)) — one pass, map-side partial aggregation, no driver collects.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import contracts as K
from ..functions import numeric as N
from ..functions import text as T
from .prefix import bucketed


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------
# filters (B6–B9)
# --------------------------------------------------------------------------

def active_claims(df: DataFrame, status_col: str = "statut_sinistre_claim") -> DataFrame:
    """Status in the three active statuses (the whole table when the
    status column is absent)."""
    if status_col not in df.columns:
        return df
    return df.where(F.col(status_col).isin(*K.ACTIVE_STATUSES))


def closed_claims(df: DataFrame, status_col: str = "statut_sinistre_claim") -> DataFrame:
    """NOT active — a null status is kept (pandas ``~isin``)."""
    if status_col not in df.columns:
        return df
    return df.where(~F.coalesce(F.col(status_col).isin(*K.ACTIVE_STATUSES), F.lit(False)))


def required_active(df: DataFrame) -> DataFrame:
    """B6 (delay, cost): the active claims; a run without any is an error."""
    active = active_claims(df)
    if active.isEmpty():
        raise ValueError("No active claims found. Check data or status values.")
    return active


def dashboard_filter(df: DataFrame, risk: str | None = None, risk_col: str = "risk_level", claim_text: str | None = None,
                     run_id: str | None = None, flag_col: str | None = None, flag: int | None = None) -> DataFrame:
    """The dashboards' filters, each one optional: risk level, part of the
    claim id (C10), run, flagged / delayed or not."""
    if risk:
        df = df.where(F.col(risk_col) == risk)
    if claim_text:
        df = df.where(T.contains_text("claim_id", claim_text))
    if run_id:
        df = df.where(F.col("prediction_run_id") == run_id)
    return df.where(F.col(flag_col) == flag) if flag_col and flag is not None else df


def cost_target_claims(df: DataFrame, status_col: str = "statut_sinistre_claim",
                       closed_statuses: list[str] | None = None) -> DataFrame:
    """Closed-status IN filter for the cost target."""
    return df.where(F.col(status_col).isin(*(closed_statuses or K.COST_CLOSED_STATUSES)))


# --------------------------------------------------------------------------
# tiers and per-claim measures
# --------------------------------------------------------------------------

def delay_tiers(df: DataFrame, threshold: float, prob: str = "delay_probability") -> DataFrame:
    """High >= t (= predicted delayed), Medium >= 0.6t, else Low."""
    p = F.col(prob)
    return df.withColumns({
        "predicted_delayed": (p >= threshold).cast("int"),
        "risk_level": F.when(p >= threshold, "High")
                       .when(p >= threshold * K.DELAY_MEDIUM_FACTOR, "Medium").otherwise("Low"),
    })


def excess_days(df: DataFrame, threshold: float, prob: str = "delay_probability",
                sla: str = "sla_jours") -> DataFrame:
    """clip(round(max(p−t,0)·(sla·1.5+15)), 1, 90) when delayed, else 0;
    a missing SLA counts as 20 days."""
    s = F.coalesce(F.col(sla).cast("double"), F.lit(K.DEFAULT_SLA_DAYS)) if sla in df.columns \
        else F.lit(K.DEFAULT_SLA_DAYS)
    raw = N.np_round(F.greatest(F.col(prob) - F.lit(threshold), F.lit(0.0)) * (s * 1.5 + 15.0), 0)
    clipped = F.least(F.greatest(raw, F.lit(float(K.EXCESS_DAYS_MIN))), F.lit(float(K.EXCESS_DAYS_MAX)))
    return df.withColumn("predicted_excess_days",
                         F.when(F.col("predicted_delayed") == 1, clipped).otherwise(F.lit(0.0)).cast("int"))


def duration_from_log_target(pred_log: Column) -> Column:
    """expm1 -> half-even round -> clip 1..120 (days)."""
    d = N.np_round(F.expm1(pred_log), 0)
    return F.least(F.greatest(d, F.lit(float(K.DURATION_DAYS_MIN))),
                   F.lit(float(K.DURATION_DAYS_MAX))).cast("int")


def delay_cost_at_risk(df: DataFrame, amount: str | None, prob: str = "delay_probability") -> DataFrame:
    """round(amount·p, 2) for predicted-delayed claims, else 0."""
    amt = F.coalesce(F.col(amount).cast("double"), F.lit(0.0)) if amount else F.lit(0.0)
    return df.withColumn("delay_cost_at_risk_tnd",
                         F.when(F.col("predicted_delayed") == 1, N.np_round(amt * F.col(prob), 2))
                         .otherwise(F.lit(0.0)))


def fraud_tiers(df: DataFrame, threshold: float, prob: str = "fraud_probability") -> DataFrame:
    """Critical >= t, High >= round(.7t,4), Medium >= round(.4t,4),
    Low; action map; effort hours = 1.5 + p·6 and cost = hours·18.75."""
    p = F.col(prob)
    hi = round(threshold * K.FRAUD_HIGH_FACTOR, 4)
    med = round(threshold * K.FRAUD_MEDIUM_FACTOR, 4)
    actions = F.create_map(*[F.lit(x) for kv in K.FRAUD_ACTIONS.items() for x in kv])
    hours = F.lit(K.BASE_INVESTIGATION_HOURS) + p * F.lit(K.MAX_INVESTIGATION_HOURS - K.BASE_INVESTIGATION_HOURS)
    out = df.withColumns({
        "predicted_fraud": (p >= threshold).cast("int"),
        "estimated_investigation_hours": hours,
        "risk_level": F.when(p >= threshold, "Critical").when(p >= hi, "High")
                       .when(p >= med, "Medium").otherwise("Low"),
    })
    return out.withColumns({
        "estimated_investigation_cost_tnd": F.col("estimated_investigation_hours") * F.lit(K.AGENT_HOURLY_RATE),
        "recommended_action": actions[F.col("risk_level")],
    })


def fraud_money(df: DataFrame, amount: str | None, prob: str = "fraud_probability",
                prevented_ratio: float = K.PREVENTED_LOSS_RATIO) -> DataFrame:
    """exposure = p·amount; preventable = exposure·0.70 if flagged."""
    amt = F.coalesce(F.col(amount).cast("double"), F.lit(0.0)) if amount else F.lit(0.0)
    exp_ = F.col(prob) * amt
    return df.withColumns({
        "expected_fraud_exposure_tnd": exp_,
        "expected_preventable_loss_tnd": F.when(F.col("predicted_fraud") == 1, exp_ * prevented_ratio)
                                          .otherwise(F.lit(0.0)),
    })


def cost_tiers(df: DataFrame, pred: str = "predicted_cost") -> DataFrame:
    """<5k Low, <15k Medium, else High."""
    p = F.col(pred)
    return df.withColumn("cost_risk_level",
                         F.when(p < K.COST_TIER_LOW, "Low").when(p < K.COST_TIER_MEDIUM, "Medium").otherwise("High"))


# --------------------------------------------------------------------------
# roll-ups
# --------------------------------------------------------------------------

def breakdown(df: DataFrame, group_col: str, label: str, value: str = "predicted_cost") -> DataFrame:
    """H1: count / sum / mean of the value per group (null group dropped),
    share of the total (total floored at 1), rounded; sorted by total desc.
    The total is a one-row aggregate broadcast back (not a global window)."""
    v = F.col(value)
    g = (df.where(F.col(group_col).isNotNull())
           .groupBy(F.col(group_col).alias(label))
           .agg(F.count(v).alias("claim_count"), F.sum(v).alias("_tot"), F.avg(v).alias("_avg")))
    total = df.agg(F.coalesce(F.sum(v), F.lit(0.0)).alias("_grand"))
    out = g.crossJoin(F.broadcast(total))
    return out.select(
        label, "claim_count",
        N.np_round("_tot", 2).alias("total_indemnisation_tnd"),
        N.np_round("_avg", 2).alias("avg_indemnisation_tnd"),
        N.np_round(F.col("_tot") / F.greatest(F.col("_grand"), F.lit(1.0)) * 100.0, 1).alias("pct_of_total_budget"),
    )


def tier_distribution(df: DataFrame, tier: str, value: str) -> DataFrame:
    """H2: count, sum and % of claims per tier."""
    g = df.groupBy(tier).agg(F.count(F.lit(1)).alias("claim_count"), F.sum(value).alias("_sum"))
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    return g.crossJoin(F.broadcast(n)).select(
        tier, "claim_count", N.np_round("_sum", 2).alias("total_value"),
        N.np_round(F.col("claim_count") / F.col("_n") * 100.0, 1).alias("pct_of_claims"))


def delay_run_summary(pred: DataFrame, threshold: float, amount: str | None) -> DataFrame:
    """H4 + H10: the 16 run measures of a delay scoring run, one aggregate."""
    d = F.col("predicted_delayed") == 1
    amt = F.coalesce(F.col(amount).cast("double"), F.lit(0.0)) if amount else F.lit(0.0)
    p = F.col("delay_probability")
    agg = pred.agg(
        F.count(F.lit(1)).alias("total_active_claims"),
        F.count_if(d).alias("predicted_delayed_count"),
        F.count_if(F.col("risk_level") == "High").alias("high_risk_count"),
        F.count_if(F.col("risk_level") == "Medium").alias("medium_risk_count"),
        F.count_if(F.col("risk_level") == "Low").alias("low_risk_count"),
        F.coalesce(F.sum(F.when(d, F.col("predicted_excess_days"))), F.lit(0)).cast("long").alias("total_excess_days"),
        F.avg(F.when(d, F.col("predicted_excess_days"))).alias("_avg_excess"),
        F.coalesce(F.sum(F.when(d, amt)), F.lit(0.0)).alias("_amt_delayed"),
        F.coalesce(F.sum(F.when(d, amt * p)), F.lit(0.0)).alias("_cost_at_risk"),
        F.sum(p).alias("_sum_p"),
        F.avg(p).alias("_avg_p"),
        F.max(p).alias("_max_p"),
    )
    agents = F.greatest(F.lit(1), F.ceil(
        F.col("high_risk_count") / F.lit(K.AGENT_MONTHLY_CAPACITY * K.PRIORITY_CAPACITY_FACTOR)
        + (F.col("medium_risk_count") + F.col("low_risk_count")) / F.lit(float(K.AGENT_MONTHLY_CAPACITY))))
    return agg.select(
        F.lit(float(threshold)).alias("decision_threshold"),
        "total_active_claims", "predicted_delayed_count",
        (F.col("total_active_claims") - F.col("predicted_delayed_count")).alias("predicted_on_time_count"),
        N.np_round(F.col("predicted_delayed_count") / F.greatest(F.col("total_active_claims"), F.lit(1)) * 100.0, 1)
        .alias("predicted_delay_rate_pct"),
        "high_risk_count", "medium_risk_count", "low_risk_count", "total_excess_days",
        F.coalesce(N.np_round("_avg_excess", 1), F.lit(0.0)).alias("avg_excess_days_per_delayed"),
        N.np_round("_amt_delayed", 2).alias("total_amount_at_risk_tnd"),
        N.np_round("_cost_at_risk", 2).alias("cost_at_risk_tnd"),
        N.np_round(F.col("predicted_delayed_count") * F.lit(K.DELAY_COST_PER_CLAIM), 2).alias("estimated_delay_penalty_tnd"),
        agents.cast("int").alias("recommended_agents"),
        N.np_round(agents * F.lit(K.AGENT_MONTHLY_SALARY), 2).alias("staffing_cost_tnd"),
        N.np_round("_avg_p", 4).alias("avg_delay_probability"),
        N.np_round("_max_p", 4).alias("max_delay_probability"),
        # H10 read-model extras
        N.np_round(F.col("_sum_p"), 4).alias("estimated_delayed_claims"),
        N.np_round(F.col("total_excess_days") / F.greatest(F.col("total_active_claims"), F.lit(1)), 4)
        .alias("avg_excess_days_per_claim"),
        N.np_round(F.try_divide(F.col("_cost_at_risk"), F.col("predicted_delayed_count")), 2)
        .alias("cost_at_risk_per_delayed_tnd"),
    )


def fraud_kpis(pred: DataFrame, threshold: float, amount: str | None,
               prevented_ratio: float = K.PREVENTED_LOSS_RATIO,
               hourly_rate: float = K.AGENT_HOURLY_RATE) -> DataFrame:
    """H5 + H6 + H8: flagged, hours, exposure, preventable, review cost, net,
    ROI, tier counts and queue rates — one aggregate."""
    f = F.col("predicted_fraud") == 1
    p = F.col("fraud_probability")
    amt = F.coalesce(F.col(amount).cast("double"), F.lit(0.0)) if amount else F.lit(0.0)
    a = pred.agg(
        F.count(F.lit(1)).alias("total_scored_claims"),
        F.count_if(f).alias("flagged_for_investigation"),
        F.coalesce(F.sum(F.when(f, F.col("estimated_investigation_hours"))), F.lit(0.0)).alias("_hours"),
        F.coalesce(F.sum(p * amt), F.lit(0.0)).alias("_exposure"),
        F.coalesce(F.sum(F.when(f, p * amt)), F.lit(0.0)).alias("_flag_exposure"),
        *[F.count_if(F.col("risk_level") == t).alias(f"{t.lower()}_count")
          for t in ["Critical", "High", "Medium", "Low"]],
        F.avg(p).alias("_avg_p"),
        F.sum(p).alias("_sum_p"),
        F.coalesce(F.sum(F.when(f, p)), F.lit(0.0)).alias("_sum_p_flag"),
    )
    n = F.col("total_scored_claims")
    review = F.col("_hours") * F.lit(hourly_rate)
    prevent = F.col("_flag_exposure") * F.lit(prevented_ratio)
    net = prevent - review
    return a.select(
        F.lit(float(threshold)).alias("threshold_used"),
        "total_scored_claims", "flagged_for_investigation",
        N.np_round("_hours", 4).alias("total_investigation_hours"),
        N.np_round("_exposure", 2).alias("expected_fraud_exposure_total"),
        N.np_round(prevent, 2).alias("expected_preventable_loss"),
        N.np_round(review, 2).alias("expected_review_cost"),
        N.np_round(net, 2).alias("expected_net_savings"),
        N.np_round(F.when(review > 0, net / review).otherwise(F.lit(0.0)), 6).alias("expected_roi"),
        "critical_count", "high_count", "medium_count", "low_count",
        N.np_round(F.col("flagged_for_investigation") / n, 6).alias("queue_load_rate"),
        N.np_round((F.col("high_count") + F.col("critical_count")) / n, 6).alias("high_risk_rate"),
        N.np_round(F.col("critical_count") / n, 6).alias("intervention_rate"),
        N.np_round("_avg_p", 6).alias("avg_fraud_score"),
        N.np_round("_sum_p", 4).alias("expected_fraud_cases"),
        N.np_round("_sum_p_flag", 4).alias("expected_cases_in_queue"),
    )


def cost_kpis(pred: DataFrame, history: DataFrame, hist_col: str | None,
              type_col: str = "type_sinistre_claim", coverage_col: str = "type_couverture") -> DataFrame:
    """H3 + H22: total, average, high-tier rate, 15 % reserve, historical
    average of closed claims, budget deviation, top type / coverage by cost."""
    v = F.col("predicted_cost")
    a = pred.agg(F.coalesce(F.sum(v), F.lit(0.0)).alias("_tot"), F.count(F.lit(1)).alias("_n"),
                 F.count_if(F.col("cost_risk_level") == "High").alias("_high"))
    h = closed_claims(history).agg(
        (F.avg(F.col(hist_col).cast("double")) if hist_col else F.lit(None).cast("double")).alias("_hist"))
    tops = []
    for col, name in ((type_col, "top_claim_type_by_cost"), (coverage_col, "top_coverage_type_by_cost")):
        if col in pred.columns:
            g = pred.where(F.col(col).isNotNull()).groupBy(col).agg(F.sum(v).alias("_s"))
            # max_by on (sum, group) — ties go to the larger label deterministically
            tops.append(g.agg(F.coalesce(F.max_by(F.col(col), F.struct(N.np_round("_s", 2), F.col(col))),
                                         F.lit("N/A")).alias(name)))
        else:
            tops.append(pred.sparkSession.range(1).select(F.lit("N/A").alias(name)))
    out = a.crossJoin(F.broadcast(h))
    for t in tops:
        out = out.crossJoin(F.broadcast(t))
    hist_total = F.col("_hist") * F.col("_n")
    return out.select(
        N.np_round("_tot", 2).alias("total_predicted_indemnisation_tnd"),
        N.np_round(F.when(F.col("_n") > 0, F.col("_tot") / F.col("_n")).otherwise(F.lit(0.0)), 2)
        .alias("average_cost_per_claim"),
        N.np_round("_hist", 2).alias("historical_avg_per_claim_tnd"),
        N.np_round(F.when(F.col("_n") > 0, F.col("_high") / F.col("_n")).otherwise(F.lit(0.0)), 6).alias("high_cost_rate"),
        N.np_round(F.col("_tot") * F.lit(K.RECOVERY_RESERVE_RATE), 2).alias("recovery_reserve_tnd"),
        N.np_round(F.when(F.col("_hist").isNotNull() & (F.col("_n") > 0),
                        (F.col("_tot") - hist_total) / hist_total), 6).alias("budget_deviation_risk"),
        "top_claim_type_by_cost", "top_coverage_type_by_cost",
        F.col("_n").alias("total_active_claims"),
        F.lit(K.COST_TIER_MEDIUM).alias("cost_threshold_tnd"),
    )


def value_counts(df: DataFrame, col: str, keep_null: bool = True) -> DataFrame:
    """H6: counts per value (null kept as its own group unless dropped)."""
    d = df if keep_null else df.where(F.col(col).isNotNull())
    return d.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def pivot_counts(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """H7: one row per ``row`` key, one count column per listed value."""
    return df.groupBy(row).agg(*[F.count_if(F.col(col) == v).alias(f"{v.lower()}_count") for v in values])


def precision_capture_at_k(df: DataFrame, k: float, prob: str) -> DataFrame:
    """H9: precision@k = mean p of the top m = ceil(k·n) claims, capture@k =
    Σp(top m) / Σp.

    No global sort or global window: the claims are scanned once into counts per
    distinct score, written in ranges of the score; the ranges' sums (one row a
    range) say in which range the m-th largest score lies, and only that
    range is read again and ranked.  Rows tied at the cut-off score v* add
    (m − count above v*)·v*, so ties never need ordering."""
    spark = df.sparkSession
    scores = df.select(F.col(prob).cast("double").alias("_p")).where(F.col("_p").isNotNull())
    counts = bucketed(scores.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")), ["_p"], "score-counts")
    ranges = counts.groupBy("_b").agg(F.sum("_c").alias("n"), F.sum(F.col("_c") * F.col("_p")).alias("s")).orderBy(F.desc("_b")).collect()
    n, total = sum(r["n"] for r in ranges), sum(r["s"] for r in ranges)
    m, above, top = math.ceil(float(k) * n), 0, 0.0
    for r in ranges:
        if above + r["n"] >= m:
            break
        above, top = above + r["n"], top + r["s"]
    columns = "k double, top_n long, precision_at_k_pct double, capture_at_k_pct double"
    if not n:
        return spark.createDataFrame([(float(k), 0, None, None)], columns)
    w = Window.partitionBy("_b").orderBy(F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.where(F.col("_b") == r["_b"]).withColumns({
        "_before": F.lit(above) + F.coalesce(F.sum("_c").over(w), F.lit(0)),
        "_sum": F.lit(top) + F.coalesce(F.sum(F.col("_c") * F.col("_p")).over(w), F.lit(0.0))})
    cut = inside.where((F.col("_before") < m) & (F.col("_before") + F.col("_c") >= m)) \
                .select((F.col("_sum") + (F.lit(m) - F.col("_before")) * F.col("_p")).alias("_top"))
    return cut.select(F.lit(float(k)).alias("k"), F.lit(m).cast("long").alias("top_n"), N.np_round(F.col("_top") / F.lit(m) * 100.0, 4).alias("precision_at_k_pct"),
                      N.np_round(F.col("_top") / F.lit(float(total)) * 100.0, 4).alias("capture_at_k_pct"))


def coherence_violations(df: DataFrame, kind: str) -> DataFrame:
    """Rows that break tier coherence (0 rows = pass)."""
    if kind == "delay":
        bad = ((F.col("risk_level") == "High") != (F.col("predicted_delayed") == 1))
    else:
        bad = ((F.col("risk_level") == "Critical") != (F.col("predicted_fraud") == 1))
    return df.where(bad)


def run_history(df: DataFrame, run_col: str = "prediction_run_id") -> DataFrame:
    """Per run — total, delayed, high risk, cost impact, delayed % and
    high-risk % (0 when empty, 1 decimal)."""
    g = df.groupBy(run_col).agg(
        F.count(F.lit(1)).alias("total_claims"),
        F.count_if(F.col("predicted_delayed") == 1).alias("delayed_claims"),
        F.count_if(F.col("risk_level") == "High").alias("high_risk_claims"),
        N.np_round(F.coalesce(F.sum("delay_cost_at_risk_tnd"), F.lit(0.0)), 2).alias("cost_impact_tnd"),
    )
    pct = lambda c: F.when(F.col("total_claims") > 0,
                           N.np_round(F.col(c) / F.col("total_claims") * 100.0, 1)).otherwise(F.lit(0.0))
    return g.withColumns({"delayed_pct": pct("delayed_claims"), "high_risk_pct": pct("high_risk_claims")})


def ceil_k(n: int, k: float) -> int:
    return int(math.ceil(k * n))
