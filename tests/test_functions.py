"""Unit tables for the scalar cleaning functions (expected = our rulings)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimwise.functions import dates as D
from claimwise.functions import numeric as N
from claimwise.functions import text as T
from claimwise import contracts as K


def _one(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(fn(F.col("x")).alias("y")).collect()]


def test_normalize_id(spark):
    assert _one(spark, [" cli-1 ", "nan", "None", "", None], T.normalize_id) == ["CLI-1", None, None, None, None]


def test_to_numeric_flexible(spark):
    got = _one(spark, ["12,5", "1 000", "DT: 2", "oui", "faux", "n/a", "abc"], N.to_numeric_flexible)
    assert got == [12.5, 1000.0, 2.0, 1.0, 0.0, None, None]


def test_safe_to_numeric(spark):
    assert _one(spark, ["12,5", "1 000", "DT: 2"], N.to_double) == [12.5, 1000.0, None]


def test_safe_to_bool(spark):
    got = _one(spark, ["VRAI", "1", "1.0", "Non", "0", "2", "?"], N.to_bool)
    assert got == [True, True, True, False, False, None, None]


def test_title_case(spark):
    assert _one(spark, ["saint-denis l'ariana été"], lambda c: T.clean_text(c, "title")) == ["Saint-Denis L'Ariana Été"]


def test_status(spark):
    got = _one(spark, ["Refusée", "clos avec  indemnisation", "cloturé", "en cours", "en cours d'expertise",
                       "suspendu"], T.standardize_status)
    assert got == ["Refusé", "Clos_avec_indemnisation", "Clos", "En_cours", "En_cours_d_expertise", "Suspendu"]


def test_gender_and_driving(spark):
    assert _one(spark, ["Homme", "femme", "Féminin", "x", None], T.canonical_gender) == ["M", "F", "F", None, None]
    assert _one(spark, [" agressif ", "PRUDENT", "autre", "?"], T.canonical_driving) == ["Aggressif", "Prudent", None, None]


def test_bands(spark):
    age = _one(spark, [24.0, 24.5, 34.0, 65.0, None], lambda c: N.fixed_band(c, K.AGE_BANDS, low=0), "double")
    assert age == ["<25", "25-34", "25-34", "65+", None]
    credit = _one(spark, [450.0, 451.0, 600.0, 750.0, 751.0], lambda c: N.fixed_band(c, K.CREDIT_BANDS), "double")
    assert credit == ["poor", "fair", "fair", "good", "excellent"]
    tenure = _one(spark, [180.0, 181.0, 365.0, 1095.0, 1096.0], lambda c: N.fixed_band(c, K.TENURE_BANDS), "double")
    assert tenure == ["<6m", "6-12m", "6-12m", "2-3y", "3y+"]


def test_day_first_dates(spark):
    got = _one(spark, ["03/04/2024", "2024-04-03", "bad"], D.to_ts)
    assert got == [dt.datetime(2024, 4, 3), dt.datetime(2024, 4, 3), None]


def test_numpy_rounding(spark):
    assert _one(spark, [2.5, 3.5, 16118.505], lambda c: N.np_round(c, 0), "double") == [2.0, 4.0, 16119.0]
    assert _one(spark, [0.125, 16118.505], lambda c: N.np_round(c, 2), "double") == [0.12, 16118.5]


def test_equal_quantile_edges(spark):
    from claimwise.operators import stats
    df = spark.createDataFrame([(0.0,), (0.0,), (0.0,), (1.0,)], "v double")
    q = df.crossJoin(spark.createDataFrame([([0.0, 0.0, 1.0],)], "__q_s array<double>"))
    got = [r[0] for r in q.select(stats.quantile_band(F.col("v"), "s", K.SEVERITY_LABELS)).collect()]
    assert got == ["low", "low", "low", "high"]


def test_clip_all_null_column_unchanged(spark):
    from claimwise.operators import stats
    df = spark.createDataFrame([(None,), (None,)], "v double")
    out = stats.attach_quantiles(df, {"v": (F.col("v"), [0.01, 0.99])})
    assert [r[0] for r in out.select(stats.clip(F.col("v"), "v")).collect()] == [None, None]


@pytest.mark.parametrize("p,tier", [(0.90, "Critical"), (0.63, "High"), (0.36, "Medium"), (0.35, "Low")])
def test_fraud_tiers(spark, p, tier):
    from claimwise.operators import scoring
    df = spark.createDataFrame([(p,)], "fraud_probability double")
    assert scoring.fraud_tiers(df, 0.9).first()["risk_level"] == tier


def test_delay_tiers_and_excess_days(spark):
    from claimwise.operators import scoring
    df = spark.createDataFrame([(0.5, 20.0), (0.3, 20.0), (0.29, 20.0), (0.9, 20.0), (0.49, 20.0), (0.9, None)],
                               "delay_probability double, sla_jours double")
    out = scoring.excess_days(scoring.delay_tiers(df, 0.5), 0.5).collect()
    assert [(r.risk_level, r.predicted_delayed) for r in out[:3]] == [("High", 1), ("Medium", 0), ("Low", 0)]
    assert [r.predicted_excess_days for r in out] == [1, 0, 0, 18, 0, 18]


def test_recommended_agents(spark):
    from claimwise.operators import scoring
    rows = [("High", 1)] * 84 + [("Medium", 0)] * 2410 + [("Low", 0)] * 723
    df = spark.createDataFrame([(r, d, 0.5, 0, 0.0) for r, d in rows],
                               "risk_level string, predicted_delayed int, delay_probability double, "
                               "predicted_excess_days int, x double")
    assert scoring.delay_run_summary(df, 0.5, None).first()["recommended_agents"] == 42


def test_snake_case_headers():
    assert T.to_snake_case("Prénom") == "prenom"
    assert T.to_snake_case(" Risque RSE / Total-Score ") == "risque_rse_total_score"
