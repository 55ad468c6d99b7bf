"""Warehouse layer (G2–G6, G13): dimensions, dim_time, fact_claim, ml_claim.

Joins are left equi-joins of the claims fact against N:1 dimensions (each
dimension is unique on its key by construction of the clean layer).  No join
is forced to broadcast: the dimensions grow with the data (clients,
policies and vehicles are tens of millions of rows at 100 TB), so the
strategy is left to AQE, which broadcasts only under
``spark.sql.autoBroadcastJoinThreshold`` measured at runtime and otherwise
sort-merges, splitting skewed claim-side partitions (skewJoin).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import contracts as K
from ..functions import dates as D
from ..functions import numeric as N
from ..operators import align, stats
from ..sources import bindings
from ..sources.tables import Tables
from . import clean


@dataclass
class CleanLayer:
    clients: DataFrame
    policies: DataFrame
    vehicles: DataFrame
    claims: DataFrame


def clean_layer(t: Tables) -> CleanLayer:
    return CleanLayer(
        clients=clean.clean_clients(bindings.clients_raw(t), bindings.CLIENT_ORDER_COLS),
        policies=clean.clean_policies(bindings.policies_raw(t)),
        vehicles=clean.clean_vehicles(bindings.vehicles_raw(t)),
        claims=clean.clean_claims(bindings.claims_raw(t), bindings.CLAIM_ORDER_COLS),
    )


def dim_client(clients: DataFrame) -> DataFrame:
    """G2 (clean clients are already unique on client_id)."""
    return align.whitelist(clients, K.DIM_CLIENT_COLS)


def dim_policy(policies: DataFrame) -> DataFrame:
    return align.whitelist(policies, K.DIM_POLICY_COLS)


def dim_vehicle(vehicles: DataFrame) -> DataFrame:
    return align.whitelist(vehicles, K.DIM_VEHICLE_COLS)


def dim_time(policies: DataFrame, claims: DataFrame) -> DataFrame:
    """Union of the four date columns -> day -> distinct -> date parts."""
    parts = []
    for df, cols in ((policies, ["date_debut_contrat", "date_fin_contrat"]),
                     (claims, ["date_sinistre_claim", "date_cloture_claim"])):
        for c in cols:
            if c in df.columns:
                parts.append(df.select(F.col(c).cast("date").alias("full_date")))
    if not parts:
        return policies.sparkSession.createDataFrame(
            [], "date_key int, full_date date, year int, month int, day int, quarter int, week_of_year int")
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    d = u.where(F.col("full_date").isNotNull()).distinct()
    return d.select(
        D.date_key("full_date").alias("date_key"),
        "full_date",
        F.year("full_date").alias("year"),
        F.month("full_date").alias("month"),
        F.dayofmonth("full_date").alias("day"),
        F.quarter("full_date").alias("quarter"),
        F.weekofyear("full_date").alias("week_of_year"),
    )


def _left_join_coalesced(left: DataFrame, right: DataFrame, key: str,
                         prefer_left: tuple[str, ...] = ()) -> DataFrame:
    """Left join on ``key``; every non-key column present on both sides is
    coalesced into one (G5, ruling Q5) — right side first unless listed in
    ``prefer_left`` — so no _x/_y suffixes ever appear."""
    shared = [c for c in right.columns if c != key and c in left.columns]
    if not shared:
        return left.join(right, on=key, how="left")
    r = right.select(key, *[F.col(c).alias(f"__r_{c}") if c in shared else F.col(c)
                            for c in right.columns if c != key])
    j = left.join(r, on=key, how="left")
    fixes = {}
    for c in shared:
        a, b = (F.col(c), F.col(f"__r_{c}")) if c in prefer_left else (F.col(f"__r_{c}"), F.col(c))
        fixes[c] = F.coalesce(a, b)
    return j.withColumns(fixes).drop(*[f"__r_{c}" for c in shared])


def fact_claim(cl: CleanLayer, stage=None) -> DataFrame:
    """Claims ⟕ policies ⟕ clients ⟕ vehicles, date_key, clipped loss ratio.  The
    ratio's bounds come from a join of the columns that it needs, handed to ``stage`` (e.g.
    written) as the quantiles read it several times; the wide join runs once."""
    fact = cl.claims
    pol = align.whitelist(cl.policies, K.FACT_POLICY_COLS)
    fact = _left_join_coalesced(fact, pol, "contract_id", prefer_left=("client_id",))
    of = None
    if "montant_indemnisation_claim" in fact.columns and "prime_assurance_annuelle" in fact.columns:
        ratio = N.safe_ratio(F.col("montant_indemnisation_claim"), F.col("prime_assurance_annuelle"))
        fact = fact.withColumn("loss_ratio", ratio)
        of = clean.staged(fact.select("loss_ratio"), stage)
    cli = align.whitelist(cl.clients, K.FACT_CLIENT_COLS)
    fact = _left_join_coalesced(fact, cli, "client_id")
    veh = align.whitelist(cl.vehicles, K.FACT_VEHICLE_COLS)
    fact = _left_join_coalesced(fact, veh, "vehicle_id")
    if "date_sinistre_claim" in fact.columns:
        fact = fact.withColumn("date_key", D.date_key("date_sinistre_claim"))
    if of is not None:
        last = [c for c in fact.columns if c != "loss_ratio"]
        fact = stats.attach_quantiles(fact, {"loss_ratio": (F.col("loss_ratio"), [K.CLIP_LOW, K.CLIP_HIGH])}, of=of)
        fact = fact.select(*last, stats.clip(F.col("loss_ratio"), "loss_ratio").alias("loss_ratio"))
    return align.drop_present(fact, K.FACT_DROP_COLS)


RATIO = "premium_to_value_ratio"


def _ratio(df: DataFrame) -> DataFrame:
    return df.withColumn(RATIO, N.safe_ratio(F.col("prime_assurance_annuelle"), F.col("valeur_vehicule")))


def _ml_dims(cl: CleanLayer, unique: bool) -> dict[str, DataFrame]:
    """Key -> the dimension's feature columns, declared unique on its key if asked for."""
    dims = {"contract_id": align.whitelist(cl.policies, K.ML_POLICY_COLS), "client_id": align.whitelist(cl.clients, K.ML_CLIENT_COLS),
            "vehicle_id": align.whitelist(cl.vehicles, K.ML_VEHICLE_COLS)}
    return {key: dim.dropDuplicates([key]) if unique else dim for key, dim in dims.items()}


def ratio_bounds(cl: CleanLayer, stage=None) -> dict | DataFrame | None:
    """The bounds of the features' ratio over all claims (None without the columns for it),
    from a join of the columns that it needs, handed to ``stage``."""
    dims = _ml_dims(cl, False)
    narrow = _left_join_coalesced(_left_join_coalesced(cl.claims, dims["contract_id"], "contract_id"), dims["vehicle_id"], "vehicle_id")
    if "prime_assurance_annuelle" not in narrow.columns or "valeur_vehicule" not in narrow.columns:
        return None
    of = clean.staged(_ratio(narrow).select(RATIO), stage)
    return stats.quantile_constants(of, {"ptv": (F.col(RATIO), [K.CLIP_LOW, K.CLIP_HIGH])})


def ml_claim(cl: CleanLayer, ratio: bool = True, stage=None, rows: DataFrame | None = None, bounds=None) -> DataFrame:
    """Feature join + ratios + date parts − leakage columns.  The ratio's bounds come
    from ``ratio_bounds`` (or are given); the wide join runs once.

    Without ``ratio`` (and its bounds over all claims) nothing is computed here, and the
    dimensions are seen to be unique on their keys: a reader's plan then carries only the
    columns that it reads and leaves out the joins that it needs none of.  So it does with ``rows``,
    the clean claims whose features are wanted; the ratio's bounds are those of all claims."""
    base = cl.claims if rows is None else rows
    if "statut_sinistre_claim" not in base.columns:
        base = base.withColumn("statut_sinistre_claim", F.lit("Unknown"))
    if ratio and bounds is None:
        bounds = ratio_bounds(cl, stage)
    for key, dim in _ml_dims(cl, not ratio or rows is not None).items():
        base = _left_join_coalesced(base, dim, key)
    if ratio and bounds is not None:
        base = stats.with_constants(_ratio(base), bounds)
        base = stats.drop_quantiles(base.withColumn(RATIO, stats.clip(F.col(RATIO), "ptv")))
    if "date_sinistre_claim" in base.columns:
        ds = F.col("date_sinistre_claim")
        base = base.withColumns({
            "claim_year": F.year(ds),
            "claim_month": F.month(ds),
            "claim_quarter": F.quarter(ds),
            "claim_dayofweek": D.day_of_week_mon0(ds),
            "claim_hour": F.hour(ds),
        })
    return align.drop_present(base, K.ML_LEAKAGE_COLS)


def unjoined(cl: CleanLayer, wanted: list[str]) -> list[str]:
    """Those of the features ``wanted`` that a claim has by itself, without any dimension."""
    joined = {RATIO}.union(*[dim.columns for dim in _ml_dims(cl, False).values()])
    return [c for c in wanted if c not in joined]


def ml_parts(cl: CleanLayer, rows: DataFrame, wanted: list[str], bounds, stage) -> list[tuple[DataFrame, list[str]]]:
    """The features ``wanted`` of ``rows`` (claims with their keys and those of their features that no
    join gives), not joined into wide rows: tables with a column ``_rows``, the claims that one row of
    them stands for, each with the features that it has.

    What only a dimension holds is its row, standing for the claims with its key; a claim without one
    has no value there.  What rests on several tables comes from a join of its own columns, staged."""
    parts, dims = [], _ml_dims(cl, True)
    left = [c for c in wanted if c not in rows.columns]
    once = {c for dim in dims.values() for c in dim.columns if sum(c in d.columns for d in (cl.claims, *dims.values())) == 1}
    for key, dim in dims.items():
        own = [c for c in left if c in once and c in dim.columns]
        if own:
            per = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
            parts.append((clean.staged(dim.select(key, *own).join(per, key).drop(key), stage), own))
            left = [c for c in left if c not in own]
    ours = [c for c in wanted if c in rows.columns]
    if ours:
        parts.append((rows.select(*ours).withColumn("_rows", F.lit(1)), ours))
    if left:
        joined = ml_claim(cl, rows=rows, bounds=bounds, ratio=bounds is not None).select(*left)
        parts.append((clean.staged(joined, stage).withColumn("_rows", F.lit(1)), left))
    return parts
