"""Clean layer: raw clients / policies / vehicles / claims -> stg tables.

Each transform is DataFrame -> DataFrame, lazily built; optional columns are
detected on ``df.columns`` at plan-build time (an absent optional column means
"skip the step").  Global statistics (clip bounds, quantile bands) are
computed in one aggregate per pass and attached as a broadcast one-row cross
join.  As in the reference, quantiles are taken before dedup (claims,
policies, vehicles); clients drop null ids first.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import contracts as K
from ..functions import dates as D
from ..functions import numeric as N
from ..functions import text as T
from ..operators import align, stats
from ..operators.dedup import keep_first

AS_OF_DATE = _dt.date(2026, 4, 28)


def _dtype(df: DataFrame, c: str):
    return df.schema[c].dataType


def _with(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    return df.withColumns(cols) if cols else df


def staged(df: DataFrame, stage) -> DataFrame:
    """Hand the row-local result to ``stage`` (e.g. write + re-read as
    Parquet) before the global-statistics passes; identity when None."""
    return stage(df) if stage is not None else df


def _measures(df: DataFrame, cols: list[str], stage) -> DataFrame | None:
    """The columns that the global statistics read, staged on their own: the wide rows are
    then read, cleaned and written in one job, once the statistics are known."""
    return staged(df.select(*cols), stage) if cols else None


def _text_numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    """The text-typed ones of ``cols`` parsed (D1) in a projection of their own: what follows
    refers to a number several times, and would parse its text as often."""
    return _with(df, {c: N.text_number(c) for c in cols if c in df.columns and isinstance(_dtype(df, c), StringType)})


# --------------------------------------------------------------------------
# clients
# --------------------------------------------------------------------------

def clean_clients(raw: DataFrame, order_cols: list[str] | None = None, stage=None) -> DataFrame:
    df = align.normalize_columns(raw)
    df = align.require_column(df, K.CLIENT_ID_ALIASES, "client_id")
    df = df.withColumn("client_id", T.normalize_id("client_id")).where(F.col("client_id").isNotNull())
    has = set(df.columns)

    # stage 1: missing-token normalisation of every text-typed input, in its
    # own projection (normalize_missing is idempotent)
    flex_cols = [c for c in ["age", "revenu_annuel", "score_credit", *K.CLIENT_COUNT_COLS, *K.CLIENT_RISK_COLS]
                 if c in has and isinstance(_dtype(df, c), StringType)]
    pre = set(flex_cols) | ({c for c in K.CLIENT_TEXT_COLS if c in has})
    df = _with(df, {c: T.normalize_missing(c) for c in sorted(pre)})
    # then the texts' numbers, parsed once a row
    df = _with(df, {f"_n_{c}": N.first_number(c) for c in flex_cols})
    df = _with(df, {c: N.to_numeric_flexible(c, prenormalized=True, parsed=F.col(f"_n_{c}")) for c in flex_cols}).drop(*[f"_n_{c}" for c in flex_cols])

    def flex(c):
        return N.to_numeric_flexible(c, _dtype(df, c))

    step: dict[str, Column] = {}
    for c in K.CLIENT_TEXT_COLS:
        if c in has:
            step[c] = T.clean_text(c, "title")
    if "genre" in has:
        step["genre"] = T.canonical_gender("genre")
    if "age" in has:
        step["age"] = N.null_outside(flex("age"), K.AGE_MIN, K.AGE_MAX)
    if "revenu_annuel" in has:
        v = flex("revenu_annuel")
        step["revenu_annuel"] = F.when(~(v < 0), v)
    if "score_credit" in has:
        step["score_credit"] = N.null_outside(flex("score_credit"), K.CREDIT_MIN, K.CREDIT_MAX)
    for c in K.CLIENT_COUNT_COLS:
        if c in has:
            step[c] = N.to_int_count(c, _dtype(df, c))
    for c in K.CLIENT_RISK_COLS:
        if c in has:
            step[c] = flex(c)
    for c in K.CLIENT_BOOL_COLS:
        if c in has:
            step[c] = N.flag01(c)
    if "driving_behavior" in has:
        step["driving_behavior"] = T.canonical_driving("driving_behavior")
    df = staged(_with(df, step), stage)

    # pass 1: clip bounds
    clip_cols = [c for c in ["revenu_annuel", "score_credit", *K.CLIENT_RISK_COLS] if c in has]
    df = stats.attach_quantiles(df, {c: (F.col(c), [K.CLIP_LOW, K.CLIP_HIGH]) for c in clip_cols})
    df = stats.drop_quantiles(_with(df, {c: stats.clip(F.col(c), c) for c in clip_cols}))

    # pass 2: income quintiles on the clipped income
    if "revenu_annuel" in has:
        df = stats.attach_quantiles(df, {"income": (F.col("revenu_annuel"), K.QUINTILE_PROBS)})

    step = {}
    if "age" in has:
        step["age_group"] = N.fixed_band(F.col("age"), K.AGE_BANDS, low=K.AGE_BAND_LOW)
    if "revenu_annuel" in has:
        step["income_band"] = stats.quantile_band(F.col("revenu_annuel"), "income", K.QUINTILE_LABELS)
    if "score_credit" in has:
        step["credit_band"] = N.fixed_band(F.col("score_credit"), K.CREDIT_BANDS)
    drv = []
    if "nb_infractions_majeures" in has:
        drv.append((F.col("nb_infractions_majeures"), 1.0))
    if "points_permis_retires" in has:
        drv.append((F.col("points_permis_retires").cast("double") / 10.0, 1.0))
    step["driving_risk_score"] = N.weighted_score(drv)
    fin = [(F.col(c), 1.0) for c in K.FIN_STRESS_COLS if c in has]
    step["financial_stress_score"] = N.weighted_score(fin)
    step["responsible_behavior_score"] = N.flag_count([F.col(c) for c in K.RESPONSIBLE_FLAGS if c in has])
    df = stats.drop_quantiles(_with(df, step))

    df = keep_first(df, ["client_id"], order_cols)
    return align.whitelist(df, K.CLIENT_KEEP)


# --------------------------------------------------------------------------
# policies
# --------------------------------------------------------------------------

def clean_policies(raw: DataFrame, stage=None) -> DataFrame:
    df = align.normalize_columns(raw)
    df = align.require_column(df, K.CONTRACT_ID_ALIASES, "contract_id")
    df = align.require_column(df, K.CLIENT_ID_ALIASES, "client_id")
    has = set(df.columns)
    step: dict[str, Column] = {
        "contract_id": T.normalize_id("contract_id"),
        "client_id": T.normalize_id("client_id"),
    }
    for c in ["date_debut_contrat", "date_fin_contrat"]:
        step[c] = D.to_ts(c, _dtype(df, c)) if c in has else F.lit(None).cast("timestamp_ntz")
    if "type_couverture" in has:
        step["type_couverture"] = T.clean_text("type_couverture", "title")
    if "prime_assurance_annuelle" in has:
        v = N.to_double("prime_assurance_annuelle", _dtype(df, "prime_assurance_annuelle"))
        step["prime_assurance_annuelle"] = F.when(~(v < 0), v)
    if "nb_sinistres_precedents" in has:
        step["nb_sinistres_precedents"] = N.floor_at_zero(
            N.to_double("nb_sinistres_precedents", _dtype(df, "nb_sinistres_precedents")))
    if "delai_souscription_sinistre_jours" in has:
        v = N.to_double("delai_souscription_sinistre_jours", _dtype(df, "delai_souscription_sinistre_jours"))
        step["delai_souscription_sinistre_jours"] = F.when(~(v < 0), v)
    df = _with(df, step)

    clip_cols = [c for c in ["prime_assurance_annuelle", "delai_souscription_sinistre_jours"] if c in has]
    df = stats.attach_quantiles(df, {c: (F.col(c), [K.CLIP_LOW, K.CLIP_HIGH]) for c in clip_cols}, of=_measures(df, clip_cols, stage))
    df = _with(df, {c: stats.clip(F.col(c), c) for c in clip_cols})
    df = stats.drop_quantiles(df)

    dur = D.whole_days("date_debut_contrat", "date_fin_contrat")
    df = df.withColumn("policy_duration_days", dur)
    df = df.withColumn("policy_tenure_bucket", N.fixed_band(F.col("policy_duration_days"), K.TENURE_BANDS))
    # keep-first over all rows (null key included), then drop the null key
    df = keep_first(df, ["contract_id"], [])
    return df.where(F.col("contract_id").isNotNull())


# --------------------------------------------------------------------------
# vehicles
# --------------------------------------------------------------------------

def clean_vehicles(raw: DataFrame, as_of: _dt.date = AS_OF_DATE, stage=None) -> DataFrame:
    df = align.normalize_columns(raw)
    df = align.require_column(df, K.VEHICLE_ID_ALIASES, "vehicle_id")
    df = align.require_column(df, K.CONTRACT_ID_ALIASES, "contract_id")
    has = set(df.columns)
    year = as_of.year
    step: dict[str, Column] = {
        "vehicle_id": T.normalize_id("vehicle_id"),
        "contract_id": T.normalize_id("contract_id"),
    }
    for c in ["type_vehicule", "marque", "modele", "usage_vehicule"]:
        if c in has:
            step[c] = T.clean_text(c, "title")
    if "immatriculation" in has:
        step["immatriculation"] = T.normalize_plate("immatriculation")
    num = {c: N.to_double(c, _dtype(df, c))
           for c in ["annee_modele", "puissance_fiscale", "kilometrage_actuel", "valeur_vehicule"] if c in has}
    if "annee_modele" in num:
        step["annee_modele"] = N.null_outside(num["annee_modele"], K.VEHICLE_MIN_YEAR, year + 1)
    if "puissance_fiscale" in num:
        step["puissance_fiscale"] = N.null_outside(num["puissance_fiscale"], 0, K.VEHICLE_MAX_POWER)
    if "kilometrage_actuel" in num:
        step["kilometrage_actuel"] = N.null_outside(num["kilometrage_actuel"], 0, K.VEHICLE_MAX_KM)
    if "valeur_vehicule" in num:
        step["valeur_vehicule"] = N.null_outside(num["valeur_vehicule"], 0, K.VEHICLE_MAX_VALUE)
    df = _with(df, step)
    if "annee_modele" in has:
        df = df.withColumn("vehicle_age", N.null_outside(F.lit(float(year)) - F.col("annee_modele"),
                                                         0, K.VEHICLE_MAX_AGE))
    else:
        df = df.withColumn("vehicle_age", F.lit(None).cast("double"))
    df = staged(df, stage)

    clip_cols = [c for c in ["puissance_fiscale", "kilometrage_actuel", "valeur_vehicule"] if c in has]
    df = stats.attach_quantiles(df, {c: (F.col(c), [K.CLIP_LOW, K.CLIP_HIGH]) for c in clip_cols})
    df = stats.drop_quantiles(_with(df, {c: stats.clip(F.col(c), c) for c in clip_cols}))

    if "kilometrage_actuel" in has:
        mpy = N.safe_ratio(F.col("kilometrage_actuel"), F.col("vehicle_age"))
        df = df.withColumn("mileage_per_year", N.null_outside(mpy, 0, K.VEHICLE_MAX_KM_PER_YEAR))
    else:
        df = df.withColumn("mileage_per_year", F.lit(None).cast("double"))

    specs = {}
    if "kilometrage_actuel" in has:
        specs["mileage_per_year"] = (F.col("mileage_per_year"), [K.CLIP_LOW, K.CLIP_HIGH])
    if "valeur_vehicule" in has:
        specs["value"] = (F.col("valeur_vehicule"), K.QUINTILE_PROBS)
    df = stats.attach_quantiles(df, specs)
    step = {}
    if "kilometrage_actuel" in has:
        step["mileage_per_year"] = stats.clip(F.col("mileage_per_year"), "mileage_per_year")
    if "valeur_vehicule" in has:
        step["vehicle_value_band"] = stats.quantile_band(F.col("valeur_vehicule"), "value", K.QUINTILE_LABELS)
    df = stats.drop_quantiles(_with(df, step))

    df = df.where(F.col("vehicle_id").isNotNull())
    return keep_first(df, ["vehicle_id"], [])


# --------------------------------------------------------------------------
# claims
# --------------------------------------------------------------------------

def clean_claim_rows(raw: DataFrame) -> DataFrame:
    """The row-local part (ids, dates, text, status, amounts, flags, durations,
    is_delayed), the same for batch tables and streams; what rests on the whole
    table (clip bounds, severity bands, dedup) follows in ``clean_claims``."""
    df = align.normalize_columns(raw)
    df = align.require_column(df, K.CLAIM_ID_ALIASES, "claim_id")
    df = align.require_column(df, K.CONTRACT_ID_ALIASES, "contract_id")
    df = align.require_column(df, K.CLIENT_ID_ALIASES, "client_id")
    df = align.require_column(df, K.VEHICLE_ID_ALIASES, "vehicle_id")
    df = _text_numbers(df, [*K.AMOUNT_COLUMNS, "sla_jours", "duree_traitement_jours", "duree_traitement_heures"])
    has = set(df.columns)

    step: dict[str, Column] = {c: T.normalize_id(c) for c in ["claim_id", "contract_id", "client_id", "vehicle_id"]}
    for c in ["date_sinistre_claim", "date_cloture_claim"]:
        step[c] = D.to_ts(c, _dtype(df, c)) if c in has else F.lit(None).cast("timestamp_ntz")
    if "type_sinistre_claim" in has:
        step["type_sinistre_claim"] = T.clean_text("type_sinistre_claim", "title")
    if "statut_sinistre_claim" in has:
        step["statut_sinistre_claim"] = T.standardize_status("statut_sinistre_claim")
    if "description_sinistre_claim" in has:
        step["description_sinistre_claim"] = T.collapse_whitespace("description_sinistre_claim")
    money = [c for c in K.AMOUNT_COLUMNS if c in has]
    for c in money:
        v = N.to_double(c, _dtype(df, c))
        step[c] = F.when(~(v < 0), v)
    if "est_frauduleux_claim" in has:
        step["est_frauduleux_claim"] = N.flag01("est_frauduleux_claim")
    for c in ["incoherence_dommages", "nature_sinistre_consistante"]:
        if c in has:
            step[c] = N.to_bool(c)
    for c in ["sla_jours", "duree_traitement_jours", "duree_traitement_heures"]:
        if c in has:
            v = N.to_double(c, _dtype(df, c))
            step[c] = F.when(~(v < 0), v)
        else:
            step[c] = F.lit(None).cast("double")
    return _durations(_with(df, step), "is_delayed" in has)


def _durations(df: DataFrame, has_flag: bool) -> DataFrame:
    """Durations recomputed from the two timestamps when both exist, and the delay flag."""
    both = F.col("date_sinistre_claim").isNotNull() & F.col("date_cloture_claim").isNotNull()
    hours = D.hours_between("date_sinistre_claim", "date_cloture_claim")
    df = df.withColumns({
        "duree_traitement_heures": F.when(both, hours).otherwise(F.col("duree_traitement_heures")),
        "duree_traitement_jours": F.when(both, hours / 24.0).otherwise(F.col("duree_traitement_jours")),
    })
    if has_flag:
        return df.withColumn("is_delayed", N.flag01("is_delayed"))
    # null comparison counts as "not delayed" (ruling Q2)
    return df.withColumn("is_delayed", F.coalesce(F.col("duree_traitement_jours") > F.col("sla_jours"), F.lit(False)).cast("int"))


def clean_claims(raw: DataFrame, order_cols: list[str] | None = None, stage=None, within: list[str] | None = None) -> DataFrame:
    """``within``: raw columns with one value per claim id (see ``keep_first``); those that
    are there go after the dedup."""
    own = set(align.normalize_columns(raw).columns)
    df = clean_claim_rows(raw)
    has = set(df.columns)
    money = [c for c in K.AMOUNT_COLUMNS if c in has]

    # pass 1: clip the money columns
    every, bounds = _measures(df, money, stage), {c: (F.col(c), [K.CLIP_LOW, K.CLIP_HIGH]) for c in money}
    if money:
        found = stats.quantile_constants(every, bounds)
        df, every = (stats.drop_quantiles(_with(stats.with_constants(x, found), {c: stats.clip(F.col(c), c) for c in money})) for x in (df, every))

    # pass 2: gap ratio clip + severity quantiles on the clipped payout
    both_money = "montant_estime_dommage_claim" in has and "montant_indemnisation_claim" in has
    gap = F.col("montant_indemnisation_claim") - F.col("montant_estime_dommage_claim")
    specs = {}
    if both_money:
        specs["claim_gap_ratio"] = (N.safe_ratio(gap, F.col("montant_estime_dommage_claim")), [K.CLIP_LOW, K.CLIP_HIGH])
    if "montant_indemnisation_claim" in has:
        specs["severity"] = (F.col("montant_indemnisation_claim"), K.SEVERITY_PROBS)
    # what follows from a row's own amounts and dates is added after the dedup, whose shuffle does not carry it
    within = [c for c in within or [] if c in has]
    cols = [c for c in df.columns if c not in within]
    late = [] if "is_delayed" in own else [c for c in ("duree_traitement_heures", "duree_traitement_jours", "is_delayed") if c not in own]
    df = keep_first(df.where(F.col("claim_id").isNotNull()).drop(*late), ["claim_id"], order_cols, within).drop(*within)
    if late:
        df = _with(df, {c: F.lit(None).cast("double") for c in late if c != "is_delayed"})
        df = _durations(df, False).select(*cols)
    if both_money:
        df = df.withColumn("claim_gap_amount", gap)
        df = df.withColumn("claim_gap_ratio", N.safe_ratio(F.col("claim_gap_amount"), F.col("montant_estime_dommage_claim")))
    df, step = stats.attach_quantiles(df, specs, of=every), {}
    if both_money:
        step["claim_gap_ratio"] = stats.clip(F.col("claim_gap_ratio"), "claim_gap_ratio")
    if "montant_indemnisation_claim" in has:
        step["claim_severity_bucket"] = stats.quantile_band(
            F.col("montant_indemnisation_claim"), "severity", K.SEVERITY_LABELS)
    return stats.drop_quantiles(_with(df, step))
