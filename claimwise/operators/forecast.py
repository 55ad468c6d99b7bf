"""Forecast adjustment, business KPIs, alerts and portfolio summary (K1–K12,
H13, E10).

Inputs are small: point forecasts in long form (kpi, period, value) for a
horizon of months, and per-KPI baselines (H12).  The rules are column
expressions; windows are partitioned by KPI over the horizon rows only, and
every lookup table (seasonal multipliers, clamps) is a fixed-size literal
table broadcast to the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import contracts as K
from ..functions import dates as D
from ..functions import numeric as N

KPIS = [k for k, _, _ in K.KPI_DEFINITIONS]
RATE_KPIS = ("delay_rate", "fraud_rate")


def seasonal_table(spark: SparkSession) -> DataFrame:
    """K2 multipliers as a 36-row table (kpi, month_number, factor)."""
    rows = []
    for kpi, table in (("claim_volume", K.SEASONAL_VOLUME), ("delay_rate", K.SEASONAL_DELAY),
                       ("fraud_rate", K.SEASONAL_FRAUD)):
        rows += [(kpi, m, float(f)) for m, f in table.items()]
    return spark.createDataFrame(rows, "kpi string, month_number int, factor double")


def clamp_table(spark: SparkSession) -> DataFrame:
    rows = [(k, float(lo), float(hi), k in RATE_KPIS) for k, (lo, hi) in K.FORECAST_CLAMPS.items()]
    return spark.createDataFrame(rows, "kpi string, lo double, hi double, always boolean")


def anchor_month(series_end: Column, live_anchor: Column, today: Column | None = None) -> Column:
    """K4: the later of the latest active-claim month and the series end
    (either may be missing); with neither, the month before ``today``."""
    later = F.greatest(F.trunc(series_end, "MM"), F.trunc(live_anchor, "MM"))
    return later if today is None else F.coalesce(later, F.add_months(F.trunc(today, "MM"), -1))


def horizon_grid(anchor: DataFrame, horizon: int = K.FORECAST_HORIZON) -> DataFrame:
    """The ``horizon`` month starts after the anchor (column ``anchor``)."""
    return anchor.select(F.explode(D.month_grid(F.add_months(F.col("anchor"), 1), horizon)).alias("period"))


def seasonal_naive(long: DataFrame, grid: DataFrame) -> DataFrame:
    """Deterministic point forecast: each horizon month takes the latest
    observed value of the same calendar month (per KPI)."""
    last = (long.where(F.col("value").isNotNull())
                .withColumn("month_number", F.month("period"))
                .groupBy("kpi", "month_number")
                .agg(F.max_by("value", "period").alias("value")))
    g = grid.withColumn("month_number", F.month("period"))
    return g.join(F.broadcast(last), "month_number").select("kpi", "period", "value")


def adjust(fc: DataFrame, base: DataFrame) -> DataFrame:
    """K1–K3 + D20 on long point forecasts (kpi, period, value):
    clip >= 0; volume anchoring (mean > 1.5·hist12 -> scale to 1.1·hist12);
    seasonal multipliers normalised over the horizon (volume, delay, fraud);
    per-KPI clamps relative to hist12; physical bounds."""
    spark = fc.sparkSession
    w = Window.partitionBy("kpi")
    x = fc.join(F.broadcast(base.select("kpi", F.col("last_12m_avg").alias("h12"))), "kpi", "left")
    v = F.greatest(F.col("value"), F.lit(0.0))
    x = x.withColumn("value", v)
    fc_mean = F.avg("value").over(w)
    anchored = F.when((F.col("kpi") == "claim_volume") & (F.col("h12") > 0)
                      & (fc_mean > K.VOLUME_ANCHOR_FACTOR * F.col("h12")),
                      F.col("value") * (K.VOLUME_SCALE_TARGET * F.col("h12")) / fc_mean).otherwise(F.col("value"))
    x = x.withColumn("value", anchored)
    x = x.withColumn("month_number", F.month("period"))
    x = x.join(F.broadcast(seasonal_table(spark)), ["kpi", "month_number"], "left")
    x = x.withColumn("value", F.when(F.col("factor").isNotNull(),
                                     F.col("value") * (F.col("factor") / F.avg("factor").over(w)))
                      .otherwise(F.col("value")))
    x = x.join(F.broadcast(clamp_table(spark)), "kpi", "left")
    clamped = F.least(F.greatest(F.col("value"), F.col("h12") * F.col("lo")), F.col("h12") * F.col("hi"))
    x = x.withColumn("value", F.when(F.col("lo").isNotNull() & (F.col("always") | (F.col("h12") > 0))
                                     & F.col("h12").isNotNull(), clamped).otherwise(F.col("value")))
    phys = F.when(F.col("kpi").isin(*RATE_KPIS), F.least(F.greatest(F.col("value"), F.lit(0.0)), F.lit(1.0))) \
            .otherwise(F.greatest(F.col("value"), F.lit(0.0)))
    return x.select("kpi", "period", phys.alias("value"))


def to_wide(long: DataFrame) -> DataFrame:
    return long.groupBy("period").pivot("kpi", KPIS).agg(F.first("value"))


def baseline_row(base: DataFrame) -> DataFrame:
    """One row: hist12_<kpi>, last3_<kpi> (pivot of the ≤5-row baseline table)."""
    return base.agg(*[F.max(F.when(F.col("kpi") == k, F.col(c))).alias(f"{p}_{k}")
                      for k in KPIS for c, p in (("last_12m_avg", "hist12"), ("last_3m_avg", "last3"))])


def business_kpis(wide: DataFrame, base: DataFrame) -> DataFrame:
    """One row per forecast month with the business measures,
    risk level, surge flag, alerts (array<struct>) and recommendations."""
    x = wide.crossJoin(F.broadcast(baseline_row(base)))
    c = F.col
    vol = F.greatest(F.coalesce(c("claim_volume"), F.lit(100.0)), F.lit(0.0))
    x = x.withColumn("_vol", vol)
    x = x.withColumns({
        "_cost": F.greatest(F.coalesce(c("total_indemnisation"), c("_vol") * 800.0), F.lit(0.0)),
        "_delay": F.least(F.greatest(F.coalesce(c("delay_rate"), F.lit(K.BASELINE_DELAY_RATE)), F.lit(0.0)), F.lit(1.0)),
        "_fraud": F.least(F.greatest(F.coalesce(c("fraud_rate"), F.lit(K.BASELINE_FRAUD_RATE)), F.lit(0.0)), F.lit(1.0)),
    })
    x = x.withColumn("_avg", F.greatest(F.coalesce(c("avg_claim_amount"), c("_cost") / F.greatest(c("_vol"), F.lit(1.0))),
                                        F.lit(0.0)))
    hist_vol = F.coalesce(c("hist12_claim_volume"), F.lit(100.0))
    agents = F.least(F.greatest(F.rint(F.lit(float(K.BASELINE_AGENTS)) * (c("_vol") / F.greatest(hist_vol, F.lit(1.0)))),
                                F.lit(float(max(1, K.BASELINE_AGENTS - 7)))),
                     F.lit(float(K.BASELINE_AGENTS + 10))).cast("int")
    x = x.withColumns({
        "_delays": c("_vol") * c("_delay"),
        "_cases": c("_vol") * c("_fraud"),
        "_agents": agents,
    })
    x = x.withColumns({
        "_exposure": c("_cases") * c("_avg"),
        "_staffing": c("_agents") * K.AGENT_MONTHLY_SALARY,
        "_delay_cost": c("_delays") * K.DELAY_COST_PER_CLAIM,
        "_inv_cost": c("_cases") * K.INVESTIGATION_COST_PER_CLAIM,
    })
    x = x.withColumns({
        "_preventable": c("_delay_cost") * K.EARLY_INTERVENTION_EFFICIENCY,
        "_net_fraud": F.greatest(F.lit(0.0), c("_exposure") * K.FRAUD_RECOVERY_RATE - c("_inv_cost")),
    })
    base_cost = F.coalesce(c("hist12_total_indemnisation"), c("_cost"))
    base_vol = F.coalesce(c("last3_claim_volume"), c("_vol"))
    x = x.withColumns({
        "_net": c("_preventable") + c("_net_fraud"),
        "_budget": (c("_cost") - base_cost) / F.greatest(base_cost, F.lit(1.0)) * 100.0,
        "_workload": c("_vol") / F.greatest(c("_agents") * K.AGENT_MONTHLY_CAPACITY, F.lit(1)),
        "_surge": (c("_vol") - base_vol) / F.greatest(base_vol, F.lit(1.0)) * 100.0,
    })
    x = x.withColumns({
        "_roi": c("_net") / F.greatest(c("_inv_cost") + c("_agents") * K.AGENT_INTERVENTION_COST, F.lit(1.0)) * 100.0,
        "risk_level": F.when((c("_delay") >= K.DELAY_RATE_CRITICAL) | (c("_fraud") >= K.FRAUD_RATE_WARNING * 2), "CRITICAL")
                       .when((c("_delay") >= K.DELAY_RATE_WARNING) | (c("_fraud") >= K.FRAUD_RATE_WARNING), "HIGH")
                       .when(c("_delay") >= K.DELAY_RATE_WARNING * 0.65, "MEDIUM").otherwise("LOW"),
        "is_surge_month": c("_surge") > K.VOLUME_SURGE_THRESHOLD * 100,
        "month": D.month_label("period"),
    })
    notes = F.create_map(*[F.lit(v) for kv in K.SEASONAL_NOTE.items() for v in kv])
    x = x.withColumns({"alerts": _alerts(x), "recommendations": _recommendations(x),
                       "seasonal_context": F.coalesce(notes[F.month("period")], F.lit(""))})
    r = N.np_round
    return x.select(
        "period",
        D.period_label("period").alias("period_label"),
        "month",
        F.year("period").alias("year"),
        F.month("period").alias("month_number"),
        "seasonal_context",
        r(c("_vol"), 1).alias("forecast_claim_volume"),
        r(c("_cost"), 2).alias("forecast_total_indemnisation_tnd"),
        r(c("_delay") * 100, 1).alias("forecast_delay_rate_pct"),
        r(c("_fraud") * 100, 2).alias("forecast_fraud_rate_pct"),
        r(c("_avg"), 2).alias("forecast_avg_claim_amount_tnd"),
        r(c("_delays"), 1).alias("kpi_expected_delayed_claims"),
        r(c("_cases"), 1).alias("kpi_expected_fraud_cases"),
        r(c("_exposure"), 2).alias("kpi_expected_fraud_exposure_tnd"),
        c("_agents").alias("kpi_recommended_agents"),
        r(c("_staffing"), 2).alias("kpi_staffing_cost_tnd"),
        r(c("_delay_cost"), 2).alias("kpi_total_delay_cost_tnd"),
        r(c("_preventable"), 2).alias("kpi_preventable_delay_cost_tnd"),
        r(c("_net_fraud"), 2).alias("kpi_net_fraud_savings_tnd"),
        r(c("_net"), 2).alias("kpi_net_savings_potential_tnd"),
        r(c("_roi"), 1).alias("kpi_intervention_roi_pct"),
        r(c("_budget"), 1).alias("kpi_budget_variance_pct"),
        r(c("_workload"), 3).alias("kpi_workload_index"),
        "risk_level",
        r(c("_surge"), 1).alias("volume_surge_pct"),
        "is_surge_month",
        F.size("alerts").alias("alert_count"),
        "alerts", "recommendations",
    )


def _alert(level: str, typ: str, msg: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), F.lit(typ).alias("type"), msg.alias("message"))


def _alerts(x: DataFrame) -> Column:
    """K8: 0–4 alerts per month (array<struct<level,type,message>>)."""
    c = F.col
    extra = F.greatest(F.lit(0), c("_agents") - K.BASELINE_AGENTS)
    investigators = F.greatest(F.lit(1), F.ceil(c("_cases") / 5)).cast("int")
    items = [
        F.when(c("is_surge_month"), _alert("HIGH", "VOLUME_SURGE",
               F.format_string(K.MSG_VOLUME_SURGE, c("month"), c("_surge"), extra))),
        F.when(c("_delay") >= K.DELAY_RATE_CRITICAL, _alert("CRITICAL", "DELAY_RISK",
               F.format_string(K.MSG_DELAY_CRITICAL, c("_delay") * 100, c("month"))))
         .when(c("_delay") >= K.DELAY_RATE_WARNING, _alert("HIGH", "DELAY_RISK",
               F.format_string(K.MSG_DELAY_HIGH, c("_delay") * 100, c("month")))),
        F.when(c("_fraud") >= K.FRAUD_RATE_WARNING, _alert("HIGH", "FRAUD_RISK",
               F.format_string(K.MSG_FRAUD, c("_fraud") * 100, c("_cases"), c("month"), investigators))),
        F.when(c("_budget") > K.BUDGET_OVERSHOOT_PCT * 100, _alert("MEDIUM", "BUDGET_ALERT",
               F.format_string(K.MSG_BUDGET, c("_budget"), c("month")))),
    ]
    return F.filter(F.array(*items), lambda a: a.isNotNull())


def _recommendations(x: DataFrame) -> Column:
    """Conditional manager recommendations (array<string>)."""
    c = F.col
    items = [
        F.when(c("_net") > 5000, F.format_string(K.REC_SAVINGS, (c("_net") / 1000).cast("long"))),
        F.when(c("_delays") > 10, F.format_string(K.REC_DELAYS, c("_delays").cast("long"))),
        F.when(c("_cases") > 3, F.format_string(K.REC_FRAUD, F.ceil(c("_cases")))),
        F.when(c("_workload") > 0.85, F.format_string(K.REC_WORKLOAD, c("_workload") * 100)),
        F.when(c("_budget") < -10, F.lit(K.REC_BACKLOG)),
    ]
    return F.filter(F.array(*items), lambda a: a.isNotNull())


def explode_alerts(monthly: DataFrame) -> DataFrame:
    """K9: one row per alert; J6 display order (period ascending, alert level
    descending as text) over the ≤ 4 × horizon alert rows."""
    return monthly.select("period_label", "month", "risk_level", "is_surge_month",
                          F.explode("alerts").alias("a")) \
                  .select("period_label", "month", "risk_level", "is_surge_month",
                          F.col("a.level").alias("alert_level"), F.col("a.type").alias("alert_type"),
                          F.col("a.message").alias("alert_message")) \
                  .orderBy(F.col("period_label").asc(), F.col("alert_level").desc(), F.col("alert_type").asc())


def flatten_month(monthly: DataFrame) -> DataFrame:
    """K12 + C11: the wide table row: joined alert messages truncated at 255,
    recommendations joined."""
    return monthly.withColumns({
        "alert_messages": F.substring(F.array_join(F.transform("alerts", lambda a: a["message"]), " | "), 1, 255),
        "recommendations_text": F.array_join("recommendations", " | "),
    }).drop("alerts", "recommendations")


def portfolio_summary(monthly: DataFrame) -> DataFrame:
    """H13 + K11 over the (≤ horizon) forecast months, from the rounded
    monthly values; peak months take the earliest month on ties."""
    c = F.col

    def peak(col):
        return F.min_by(F.struct(c("month").alias("m"), c(col).alias("v")),
                        F.struct((-c(col)).alias("nv"), c("period").alias("p")))

    # the months' values are rounded: exact sums, so that no order of them tips a later rounding
    total = lambda col: F.sum(c(col).cast("decimal(28,6)")).cast("double")
    mean = lambda col: total(col) / F.count(c(col))
    labels = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(c("period"), c("month"))))),
                                      lambda s: s["month"])
    a = monthly.agg(
        F.count(F.lit(1)).alias("horizon_months"),
        F.min("period_label").alias("_first"), F.max("period_label").alias("_last"),
        total("forecast_claim_volume").alias("_vol"),
        total("forecast_total_indemnisation_tnd").alias("_cost"),
        mean("forecast_delay_rate_pct").alias("_delay"),
        mean("forecast_fraud_rate_pct").alias("_fraud"),
        total("kpi_expected_delayed_claims").alias("_delays"),
        total("kpi_expected_fraud_exposure_tnd").alias("_exp"),
        total("kpi_net_savings_potential_tnd").alias("_sav"),
        F.avg("kpi_recommended_agents").alias("_agents"),
        peak("forecast_claim_volume").alias("_pv"),
        peak("forecast_delay_rate_pct").alias("_pd"),
        peak("forecast_total_indemnisation_tnd").alias("_pc"),
        labels(c("risk_level").isin("CRITICAL", "HIGH")).alias("_hr"),
        labels(c("is_surge_month")).alias("_sg"),
        F.sum("alert_count").alias("total_alerts"),
        F.sum(F.size(F.filter("alerts", lambda x: x["level"] == "CRITICAL"))).alias("critical_alerts"),
        F.sum(F.size(F.filter("alerts", lambda x: x["level"] == "HIGH"))).alias("high_alerts"),
    )
    r = N.np_round
    insight_parts = F.filter(F.array(
        F.when(F.size("_sg") > 0, F.format_string(K.INS_SURGE, F.array_join("_sg", ", "))),
        F.when(F.size("_hr") > 0, F.format_string(K.INS_HIGH_RISK, F.array_join("_hr", ", "))),
        F.when(c("_delay") > K.DELAY_RATE_WARNING * 100, F.format_string(K.INS_DELAY, c("_delay"))),
        F.when(c("_fraud") > K.FRAUD_RATE_WARNING * 100, F.format_string(K.INS_FRAUD, c("_fraud"))),
        F.when(c("_sav") > 30000, F.format_string(K.INS_SAVINGS, (c("_sav") / 1000).cast("long"))),
    ), lambda s: s.isNotNull())
    return a.select(
        "horizon_months",
        F.concat_ws(" → ", "_first", "_last").alias("total_forecast_period"),
        r(c("_vol"), 0).alias("total_expected_claims"),
        r(c("_cost"), 2).alias("total_expected_cost_tnd"),
        r(c("_delay"), 1).alias("avg_monthly_delay_rate_pct"),
        r(c("_fraud"), 2).alias("avg_monthly_fraud_rate_pct"),
        r(c("_delays"), 0).alias("total_expected_delays"),
        r(c("_exp"), 2).alias("total_fraud_exposure_tnd"),
        r(c("_sav"), 2).alias("total_net_savings_potential_tnd"),
        r(c("_agents"), 1).alias("avg_agents_needed_per_month"),
        c("_pv.m").alias("peak_volume_month"), r(c("_pv.v"), 0).alias("peak_volume_claims"),
        c("_pd.m").alias("peak_delay_month"), r(c("_pd.v"), 1).alias("peak_delay_rate_pct"),
        c("_pc.m").alias("peak_cost_month"), r(c("_pc.v"), 2).alias("peak_cost_tnd"),
        F.array_join("_hr", " | ").alias("high_risk_months"),
        F.array_join("_sg", " | ").alias("surge_expected_months"),
        c("total_alerts").cast("int").alias("total_alerts"),
        c("critical_alerts").cast("int").alias("critical_alerts"),
        c("high_alerts").cast("int").alias("high_alerts"),
        F.when(F.size(insight_parts) > 0, F.array_join(insight_parts, "  "))
         .otherwise(F.lit(K.INS_STABLE)).alias("strategic_insight"),
    )
