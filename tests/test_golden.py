"""Golden values recomputed from published outputs (FIXTURES §4)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimwise.operators import forecast as FC
from claimwise.operators import scoring

# FIXED VALUES — published forecast months (inputs as published, rounded)
MONTHS = [
    # period, volume, total, delay %, fraud %, avg amount, agents, exp. delays, fraud cases, exposure,
    # delay cost, preventable, net fraud savings, net savings, ROI %, workload
    ("2026-03-01", 725.7, 2777193.59, 20.9, 2.89, 3031.0, 12, 152.0, 20.9, 63496.36, 182344.45, 72937.78, 19081.38, 92019.16, 1364.8, 0.756),
    ("2026-04-01", 857.7, 2748678.31, 23.1, 3.04, 2972.54, 14, 198.5, 26.1, 77468.08, 238184.76, 95273.9, 23204.64, 118478.55, 1461.0, 0.766),
    ("2026-05-01", 873.2, 2713236.31, 24.2, 3.19, 2883.85, 15, 211.7, 27.9, 80345.99, 254053.5, 101621.4, 23941.99, 125563.39, 1446.7, 0.728),
    ("2026-06-01", 1055.9, 2837451.61, 26.4, 3.49, 2991.43, 18, 279.3, 36.9, 110375.16, 335123.75, 134049.5, 33096.75, 167146.25, 1528.6, 0.733),
    ("2026-07-01", 1180.4, 2810087.35, 28.7, 3.8, 2900.72, 20, 338.2, 44.8, 130056.25, 405871.79, 162348.72, 38794.31, 201143.02, 1580.6, 0.738),
    ("2026-08-01", 1145.8, 2842234.36, 27.6, 3.65, 2963.65, 19, 315.7, 41.8, 123817.42, 378802.55, 151521.02, 37069.3, 188590.32, 1575.9, 0.754),
]


def test_forecast_month_kpis_reproduce(spark):
    wide = spark.createDataFrame(
        [(dt.date.fromisoformat(p), v, t, d / 100, f / 100, a) for p, v, t, d, f, a, *_ in MONTHS],
        "period date, claim_volume double, total_indemnisation double, delay_rate double, fraud_rate double, "
        "avg_claim_amount double")
    base = spark.createDataFrame([("claim_volume", 1134.0, 2000.0), ("total_indemnisation", 4.0e6, 4.0e6)],
                                 "kpi string, last_12m_avg double, last_3m_avg double")
    got = {r.period_label: r for r in FC.business_kpis(wide, base).collect()}
    for p, *_, agents, delays, cases, exposure, dcost, prev, nfs, net, roi, work in MONTHS:
        r = got[p[:7]]
        assert r.kpi_recommended_agents == agents
        for mine, ref in ((r.kpi_expected_delayed_claims, delays), (r.kpi_expected_fraud_cases, cases),
                          (r.kpi_expected_fraud_exposure_tnd, exposure), (r.kpi_total_delay_cost_tnd, dcost),
                          (r.kpi_preventable_delay_cost_tnd, prev), (r.kpi_net_fraud_savings_tnd, nfs),
                          (r.kpi_net_savings_potential_tnd, net), (r.kpi_intervention_roi_pct, roi),
                          (r.kpi_workload_index, work)):
            assert mine == pytest.approx(ref, rel=0.01)


def test_risk_levels_and_alerts(spark):
    wide = spark.createDataFrame([(dt.date(2026, 6, 1), 1055.9, 2837451.61, 0.264, 0.0349, 2991.43)],
                                 "period date, claim_volume double, total_indemnisation double, delay_rate double, "
                                 "fraud_rate double, avg_claim_amount double")
    base = spark.createDataFrame([("claim_volume", 1134.0, 2000.0), ("total_indemnisation", 4.0e6, 4.0e6)],
                                 "kpi string, last_12m_avg double, last_3m_avg double")
    r = FC.business_kpis(wide, base).first()
    assert r.risk_level == "HIGH"
    assert [(a.level, a.type) for a in r.alerts] == [("HIGH", "DELAY_RISK")]


# FIXED VALUES — published cost breakdown by claim type (count, total, avg, % of budget)
BREAKDOWN = [
    ("Collision", 1540, 6375329.5, 4139.82, 38.6), ("Dommages Corporels", 369, 3785113.0, 10257.76, 22.9),
    ("Vol", 285, 1808591.6, 6345.94, 11.0), ("Incendie", 225, 1789354.5, 7952.69, 10.8),
    ("Catastrophe Naturelle", 152, 1636501.9, 10766.46, 9.9), ("Bris De Glace", 451, 613476.4, 1360.26, 3.7),
    ("Accident", 185, 342881.44, 1853.41, 2.1), ("Responsabilité Civile", 80, 147641.36, 1845.52, 0.9),
]


def test_cost_breakdown_golden(spark):
    rows = [(t, tot / n) for t, n, tot, _a, _p in BREAKDOWN for _ in range(n)]
    df = spark.createDataFrame(rows, "type_sinistre_claim string, predicted_cost double")
    got = {r.claim_type: r for r in scoring.breakdown(df, "type_sinistre_claim", "claim_type").collect()}
    assert sum(r.claim_count for r in got.values()) == 3287
    for t, n, _tot, avg, pct in BREAKDOWN:
        assert got[t].claim_count == n
        assert got[t].avg_indemnisation_tnd == pytest.approx(avg, abs=0.02)
        assert got[t].pct_of_total_budget == pytest.approx(pct, abs=0.051)


def test_fraud_review_cost_chain():
    # published: hours × 18.75 = review cost; preventable − cost = net; net / cost = ROI
    hours, preventable = 187.2661635875702, 102331.73756966632
    from claimwise import contracts as K
    cost = hours * K.AGENT_HOURLY_RATE
    assert cost == pytest.approx(3511.240567266941)
    assert preventable - cost == pytest.approx(98820.49700239938)
    assert (preventable - cost) / cost == pytest.approx(28.14404057746425)
