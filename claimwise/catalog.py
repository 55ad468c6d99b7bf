"""Registered queries: one per operator row of the coverage checklist.

Every query reads the test tables through the bindings (so its work grows
with the tables) and returns a lazy DataFrame.  Keys follow
``<id>_<snake_name>``; the oracle twins live in ``oracle/sql.py``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import contracts as K
from .functions import dates as D
from .functions import numeric as N
from .functions import text as T
from .operators import scoring
from .plans import layers as L
from .plans import runs
from .plans import warehouse as W
from .session import written
from .sources import bindings
from .sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


class _Clean:
    """The clean tables by name, each built when it is asked for."""

    def __init__(self, ctx: Ctx):
        self._ctx = ctx

    def __getattr__(self, name: str) -> DataFrame:
        return getattr(self._ctx.layers(f"stg_clean_{name}").clean, name)


class Ctx:
    """Per-call plan pieces.  The stg / dw / ml layers that a query reads come from
    their materialised Parquet tables (built once per input fingerprint, see
    ``plans/layers.py``); everything after them is lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.t = Tables(spark, sf_dir)

    def layers(self, *names: str) -> L.Layers:
        return L.build_layers(self.spark, self.sf_dir, wanted=names)

    @property
    def cl(self) -> _Clean:
        return _Clean(self)

    @property
    def ml(self) -> DataFrame:
        return self.layers("ml_claim").ml_claim

    @property
    def joined(self) -> DataFrame:
        """The rows and columns of ``ml`` but its clipped ratio, joined as far as a query reads them."""
        return W.ml_claim(self.layers(*L.CLEAN).clean, ratio=False)

    @functools.cached_property
    def ratio_bounds(self):
        return W.ratio_bounds(self.layers(*L.CLEAN).clean, lambda df: written(df, "ratio", codec="zstd"))

    def features(self, rows: DataFrame | None = None) -> DataFrame:
        """The rows and columns of ``ml``, its ratio included, for these clean claims (all, without
        ``rows``), joined as far as a query reads them and not written as a table."""
        cl = self.layers(*L.CLEAN).clean
        return W.ml_claim(cl, rows=cl.claims if rows is None else rows, bounds=self.ratio_bounds, ratio=self.ratio_bounds is not None)

    @property
    def fact(self) -> DataFrame:
        return self.layers("dw_fact_claim").fact_claim

    @property
    def scored(self) -> DataFrame:
        return runs.surrogate_scores(self.joined)


def r2(c):
    return N.np_round(c, 2)


# ==========================================================================
# flagship
# ==========================================================================

@query("h1_claim_breakdown")
def claim_breakdown(spark, sf_dir):
    """Flagship: clean claims grouped by claim type × severity band."""
    c = Ctx(spark, sf_dir).cl.claims
    return (c.where(F.col("type_sinistre_claim").isNotNull() & F.col("claim_severity_bucket").isNotNull())
             .groupBy("type_sinistre_claim", "claim_severity_bucket")
             .agg(F.count(F.lit(1)).alias("claim_count"),
                  r2(F.sum("montant_indemnisation_claim")).alias("total_indemnisation_tnd"),
                  r2(F.avg("montant_indemnisation_claim")).alias("avg_indemnisation_tnd"),
                  F.sum("is_delayed").alias("delayed_count"),
                  F.sum("est_frauduleux_claim").alias("fraud_count")))


# ==========================================================================
# clean layer and warehouse tables (C, D, E, F, G1–G6 composed)
# ==========================================================================

@query("g1_stg_clean_clients")
def q_clean_clients(spark, sf_dir):
    return Ctx(spark, sf_dir).cl.clients


@query("g1_stg_clean_policies")
def q_clean_policies(spark, sf_dir):
    return Ctx(spark, sf_dir).cl.policies


@query("g1_stg_clean_vehicles")
def q_clean_vehicles(spark, sf_dir):
    return Ctx(spark, sf_dir).cl.vehicles


@query("g1_stg_clean_claims")
def q_clean_claims(spark, sf_dir):
    return Ctx(spark, sf_dir).cl.claims


@query("g2_dim_client")
def q_dim_client(spark, sf_dir):
    return W.dim_client(Ctx(spark, sf_dir).cl.clients)


@query("g2_dim_policy")
def q_dim_policy(spark, sf_dir):
    return W.dim_policy(Ctx(spark, sf_dir).cl.policies)


@query("g2_dim_vehicle")
def q_dim_vehicle(spark, sf_dir):
    return W.dim_vehicle(Ctx(spark, sf_dir).cl.vehicles)


@query("g3_dim_time")
def q_dim_time(spark, sf_dir):
    cl = Ctx(spark, sf_dir).cl
    return W.dim_time(cl.policies, cl.claims)


@query("g4_fact_claim")
def q_fact_claim(spark, sf_dir):
    return Ctx(spark, sf_dir).fact


@query("g6_ml_claim")
def q_ml_claim(spark, sf_dir):
    return Ctx(spark, sf_dir).ml


# ==========================================================================
# scalar cleaning functions on the raw bindings
# ==========================================================================

@query("c1_c3_c7_c8_client_text_cleaning")
def q_client_text(spark, sf_dir):
    r = bindings.clients_raw(Tables(spark, sf_dir))
    return r.select(
        F.col("client_id").alias("raw_client_id"), F.col("dup"),
        T.normalize_id("client_id").alias("client_id"),
        T.normalize_missing("nom").alias("nom_missing_normalized"),
        T.clean_text(T.normalize_missing("nom"), "title").alias("nom"),
        T.clean_text("gouvernorat", "upper").alias("gouvernorat_upper"),
        T.canonical_gender("genre").alias("genre"),
        T.canonical_driving("driving_behavior").alias("driving_behavior"),
    )


@query("c4_c5_c6_status_standardization")
def q_status(spark, sf_dir):
    r = bindings.claims_raw(Tables(spark, sf_dir))
    return (r.groupBy("statut_sinistre_claim", "type_sinistre_claim")
             .agg(F.count(F.lit(1)).alias("n"))
             .select("statut_sinistre_claim", "type_sinistre_claim", "n",
                     T.standardize_status("statut_sinistre_claim").alias("status_clean"),
                     T.status_key("statut_sinistre_claim").alias("status_key"),
                     T.remove_accents("statut_sinistre_claim").alias("status_unaccented"),
                     T.collapse_whitespace("statut_sinistre_claim").alias("status_collapsed"),
                     T.clean_text("type_sinistre_claim", "title").alias("type_clean")))


@query("c9_c13_vehicle_text_cleaning")
def q_vehicle_text(spark, sf_dir):
    r = bindings.vehicles_raw(Tables(spark, sf_dir))
    return r.select("vehicle_id",
                    T.normalize_plate("immatriculation").alias("immatriculation"),
                    T.clean_text("type_vehicule", "title").alias("type_vehicule"),
                    T.clean_text("usage_vehicule", "title").alias("usage_vehicule"),
                    T.display_type(F.col("type_vehicule")).alias("type_display"))


@query("d2_d3_d4_d5_client_numeric_parsing")
def q_client_numbers(spark, sf_dir):
    r = bindings.clients_raw(Tables(spark, sf_dir))
    # stage 1: missing-token normalisation in its own projection
    pre = ["age", "revenu_annuel", "nb_retards_paiement", "nb_infractions_majeures", "score_credit"]
    r = r.withColumns({f"_n_{c}": T.normalize_missing(c) for c in pre})
    flex = {c: N.to_numeric_flexible(f"_n_{c}", prenormalized=True) for c in pre}
    r = r.withColumns({f"_f_{c}": v for c, v in flex.items()})
    age = N.null_outside(F.col("_f_age"), K.AGE_MIN, K.AGE_MAX)
    return r.select(
        "client_id", "dup",
        F.col("_f_age").alias("age_raw_num"),
        age.alias("age"),
        F.col("_f_revenu_annuel").alias("revenu_annuel"),
        N.to_double("revenu_annuel").alias("revenu_safe_numeric"),
        N.to_int_count("_n_nb_retards_paiement", prenormalized=True).alias("nb_retards_paiement"),
        N.to_int_count("_n_nb_infractions_majeures", prenormalized=True).alias("nb_infractions_majeures"),
        N.to_bool("participe_conduite_responsable").alias("participe_bool"),
        N.flag01("participe_conduite_responsable").alias("participe_flag"),
        N.fixed_band(age, K.AGE_BANDS, low=K.AGE_BAND_LOW).alias("age_group"),
        N.fixed_band(F.col("_f_score_credit"), K.CREDIT_BANDS).alias("credit_band"),
    )


@query("e1_e2_e5_policy_dates")
def q_policy_dates(spark, sf_dir):
    r = bindings.policies_raw(Tables(spark, sf_dir))
    deb = D.to_ts("date_debut_contrat")
    fin = F.col("date_fin_contrat")
    return r.select(
        "contract_id",
        deb.alias("date_debut_contrat"),
        D.whole_days(deb, fin).alias("policy_duration_days"),
        N.fixed_band(D.whole_days(deb, fin), K.TENURE_BANDS).alias("policy_tenure_bucket"),
        D.date_key(deb).alias("start_date_key"),
        D.period_label(deb).alias("start_period"),
        N.safe_ratio(F.col("prime_assurance_annuelle"), F.col("nb_sinistres_precedents")).alias("premium_per_prior"),
        N.floor_at_zero(F.col("nb_sinistres_precedents").cast("double")).alias("nb_sinistres_precedents"),
    )


@query("e3_e4_claim_durations_and_parts")
def q_claim_durations(spark, sf_dir):
    r = bindings.claims_raw(Tables(spark, sf_dir))
    s, e = F.col("date_sinistre_claim"), F.col("date_cloture_claim")
    h = D.hours_between(s, e)
    return r.select(
        "claim_id", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
        h.alias("duree_traitement_heures"), (h / 24.0).alias("duree_traitement_jours"),
        F.year(s).alias("claim_year"), F.quarter(s).alias("claim_quarter"),
        D.day_of_week_mon0(s).alias("claim_dayofweek"), F.weekofyear(s).alias("claim_week"),
        D.month_label(s).alias("claim_month_label"),
        F.coalesce(h / 24.0 > N.to_double("sla_jours"), F.lit(False)).cast("int").alias("is_delayed"),
    )


# ==========================================================================
# scoring runs (surrogate probabilities)
# ==========================================================================

@query("d13_d17_d19_delay_predictions")
def q_delay_predictions(spark, sf_dir):
    pred = runs.delay_predictions(Ctx(spark, sf_dir).scored)
    return runs.delay_records(pred)


@query("d13_d15_d16_fraud_predictions")
def q_fraud_predictions(spark, sf_dir):
    pred = runs.fraud_predictions(Ctx(spark, sf_dir).scored)
    return pred.select(*runs.FRAUD_RECORD_COLS, "montant_indemnisation_claim")


@query("d14_cost_predictions")
def q_cost_predictions(spark, sf_dir):
    pred = runs.cost_predictions(Ctx(spark, sf_dir).scored)
    return pred.select("claim_id", "type_sinistre_claim", "predicted_cost", "cost_risk_level")


@query("h1_cost_breakdown_by_claim_type")
def q_bd_type(spark, sf_dir):
    return scoring.breakdown(runs.cost_predictions(Ctx(spark, sf_dir).scored), "type_sinistre_claim", "claim_type")


@query("h1_cost_breakdown_by_severity")
def q_bd_sev(spark, sf_dir):
    return scoring.breakdown(runs.cost_predictions(Ctx(spark, sf_dir).scored), "claim_severity_bucket",
                             "severity_bucket")


@query("h1_cost_breakdown_by_coverage")
def q_bd_cov(spark, sf_dir):
    return scoring.breakdown(runs.cost_predictions(Ctx(spark, sf_dir).scored), "type_couverture", "coverage_type")


@query("h2_cost_tier_distribution")
def q_tiers(spark, sf_dir):
    return scoring.tier_distribution(runs.cost_predictions(Ctx(spark, sf_dir).scored), "cost_risk_level",
                                     "predicted_cost")


@query("h3_h22_cost_kpis")
def q_cost_kpis(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    scored = c.scored
    return scoring.cost_kpis(runs.cost_predictions(scored), scored, "montant_indemnisation_claim")


@query("h4_h10_delay_run_summary")
def q_delay_summary(spark, sf_dir):
    pred = runs.delay_predictions(Ctx(spark, sf_dir).scored)
    return scoring.delay_run_summary(pred, runs.DELAY_THRESHOLD, "montant_indemnisation_claim")


@query("h5_h8_fraud_kpis")
def q_fraud_kpis(spark, sf_dir):
    pred = runs.fraud_predictions(Ctx(spark, sf_dir).scored)
    return scoring.fraud_kpis(pred, runs.FRAUD_THRESHOLD, "montant_indemnisation_claim")


@query("h6_fraud_risk_distribution")
def q_fraud_dist(spark, sf_dir):
    return scoring.value_counts(runs.fraud_predictions(Ctx(spark, sf_dir).scored), "risk_level")


@query("h7_delay_risk_pivot_by_type")
def q_pivot(spark, sf_dir):
    pred = runs.delay_predictions(Ctx(spark, sf_dir).scored)
    return scoring.pivot_counts(pred, "type_sinistre_claim", "risk_level", ["High", "Medium", "Low"])


@query("h9_precision_capture_at_10pct")
def q_prec_k(spark, sf_dir):
    pred = runs.fraud_predictions(Ctx(spark, sf_dir).scored)
    return scoring.precision_capture_at_k(pred, 0.10, "fraud_probability")


@query("h21_delay_coherence_violations")
def q_coh_delay(spark, sf_dir):
    pred = runs.delay_predictions(Ctx(spark, sf_dir).scored)
    return scoring.coherence_violations(pred, "delay").select("claim_id", "risk_level", "predicted_delayed")


@query("h21_fraud_coherence_violations")
def q_coh_fraud(spark, sf_dir):
    pred = runs.fraud_predictions(Ctx(spark, sf_dir).scored)
    return scoring.coherence_violations(pred, "fraud").select("claim_id", "risk_level", "predicted_fraud")


@query("h23_run_history")
def q_run_history(spark, sf_dir):
    rec = runs.delay_records(runs.delay_predictions(Ctx(spark, sf_dir).scored))
    return scoring.run_history(rec)


@query("j1_fraud_priority_queue")
def q_priority(spark, sf_dir):
    pred = runs.fraud_predictions(Ctx(spark, sf_dir).scored)
    return runs.priority_queue(pred).select("priority_rank", "claim_id", "fraud_probability", "risk_level",
                                           "recommended_action", "montant_indemnisation_claim")


@query("j2_tiered_fraud_queues")
def q_tiered(spark, sf_dir):
    pred = runs.fraud_predictions(Ctx(spark, sf_dir).scored)
    return runs.tiered_queues(pred).select("priority_list_type", "priority_rank", "claim_id", "fraud_probability")


@query("j3_top15_high_delay_risk")
def q_top15(spark, sf_dir):
    pred = runs.delay_predictions(Ctx(spark, sf_dir).scored)
    return (pred.where(F.col("risk_level") == "High")
                .orderBy(F.col("delay_probability").desc(), F.col("claim_id").asc()).limit(K.TOP_TIER_SIZE)
                .select("claim_id", "delay_probability", "predicted_excess_days", "delay_cost_at_risk_tnd"))


@query("j4_delay_prediction_page_3")
def q_page(spark, sf_dir):
    """J4 + B11: High-risk filter, page 3 of 20 rows, with page metadata."""
    pred = runs.delay_predictions(Ctx(spark, sf_dir).scored).where(F.col("risk_level") == "High")
    page, size = 3, K.PAGE_SIZE
    rows = (pred.orderBy(F.col("delay_probability").desc(), F.col("claim_id").asc())
                .offset((page - 1) * size).limit(size)
                .select("claim_id", "delay_probability", "risk_level"))
    meta = pred.agg(F.count(F.lit(1)).alias("total_count")).select(
        "total_count", F.ceil(F.col("total_count") / size).cast("long").alias("total_pages"),
        F.lit(page > 1).alias("has_previous"), (F.lit(page) < F.ceil(F.col("total_count") / size)).alias("has_next"))
    return rows.crossJoin(F.broadcast(meta))


@query("j5_latest_claim")
def q_latest(spark, sf_dir):
    c = Ctx(spark, sf_dir).cl.claims
    return (c.orderBy(F.col("date_sinistre_claim").desc(), F.col("claim_id").desc()).limit(1)
             .select("claim_id", "date_sinistre_claim", "statut_sinistre_claim"))


@query("b11_c10_cost_dashboard_filter")
def q_dash_filter(spark, sf_dir):
    """Risk level equals + claim id contains."""
    pred = runs.cost_predictions(Ctx(spark, sf_dir).scored)
    return scoring.dashboard_filter(pred, risk="Medium", risk_col="cost_risk_level", claim_text="-3").select(
        "claim_id", "predicted_cost", "cost_risk_level")


@query("b11_delay_dashboard_filter")
def q_dash_delay(spark, sf_dir):
    """The records of one run: risk level, delayed flag, run id and claim id text together."""
    rec = runs.delay_records(runs.delay_predictions(Ctx(spark, sf_dir).scored))
    return scoring.dashboard_filter(rec, risk="High", claim_text="-2", run_id=runs.run_id("RUN"), flag_col="predicted_delayed", flag=1).select(
        "prediction_run_id", "claim_id", "delay_probability", "predicted_delayed", "risk_level")


@query("b7_closed_claims_amount")
def q_closed(spark, sf_dir):
    """The closed claims themselves (a null status counts as closed), with their amounts."""
    return scoring.closed_claims(Ctx(spark, sf_dir).joined).select("claim_id", "statut_sinistre_claim", "montant_indemnisation_claim", "montant_estime_dommage_claim")


@query("b8_cost_target_claims")
def q_cost_target(spark, sf_dir):
    """The claims that the cost model learns from, with its target."""
    return scoring.cost_target_claims(Ctx(spark, sf_dir).joined).select("claim_id", "statut_sinistre_claim", "montant_indemnisation_claim")


@query("b14_cost_records")
def q_cost_records(spark, sf_dir):
    return runs.cost_records(runs.cost_predictions(Ctx(spark, sf_dir).scored))


@query("b14_fraud_records")
def q_fraud_records(spark, sf_dir):
    return runs.fraud_records(runs.fraud_predictions(Ctx(spark, sf_dir).scored))


@query("d22_cost_summary_record")
def q_cost_summary(spark, sf_dir):
    scored = Ctx(spark, sf_dir).scored
    return runs.cost_summary_record(runs.cost_predictions(scored), scored)


@query("d22_fraud_summary_record")
def q_fraud_summary(spark, sf_dir):
    return runs.fraud_summary_record(runs.fraud_predictions(Ctx(spark, sf_dir).scored))


@query("h14_prediction_period")
def q_period(spark, sf_dir):
    return runs.prediction_month(scoring.active_claims(Ctx(spark, sf_dir).joined))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    # further query modules register themselves on import
    from . import catalog_more  # noqa: F401
    return dict(QUERIES)


_ = Window  # re-exported for query modules
