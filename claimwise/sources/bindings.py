"""Canonical raw views over the driver's test tables.

The test data is TPC-H-shaped; these bindings re-dress it as the four dirty
raw insurance tables (clients, policies, vehicles, claims), the login audit
event log and the user table.  The dirt is deliberate: padded / lower-case
ids, missing tokens, French booleans, decimal commas, numbers inside text,
day-first string dates, negative durations, duplicate keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Tables

# total order used for keep-first dedup of claims (physical-order stand-in)
CLAIM_ORDER_COLS = ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount",
                    "l_tax", "l_shipdate"]
CLIENT_ORDER_COLS = ["dup"]
# what a claim id is made of, so it has one value per claim id: rows joined by it need no shuffle of their own for the dedup
CLAIM_WITHIN = ["l_orderkey"]

# the tables, and their columns, that the raw views are made of
SOURCES = {
    "clients_raw": {"customer": ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]},
    "policies_raw": {"orders": ["o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority", "o_totalprice"]},
    "vehicles_raw": {"part": ["p_partkey", "p_type", "p_brand", "p_name", "p_size", "p_retailprice"]},
    "claims_raw": {"lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount",
                                "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"],
                   "orders": ["o_orderkey", "o_custkey", "o_orderdate"]},
}


def clients_raw(t: Tables) -> DataFrame:
    c = t.customer
    base = c.withColumn("dup", F.lit(0)).unionByName(
        c.where(F.col("c_custkey") % 50 == 0).withColumn("dup", F.lit(1)))
    e = F.expr
    return base.select(
        F.concat(F.lit(" cli-"), F.col("c_custkey").cast("string"), F.lit(" ")).alias("client_id"),
        e("case when c_custkey % 17 = 0 then 'Non renseigné' when c_custkey % 13 = 0 then '' "
          "else concat(' ', lower(c_name)) end").alias("nom"),
        e("case c_custkey % 6 when 0 then 'Homme' when 1 then 'femme' when 2 then 'M' "
          "when 3 then 'Féminin' when 4 then 'x' end").alias("genre"),
        e("concat(cast(c_custkey % 110 as string), ' ans')").alias("age"),
        e("concat(cast(cast(floor(abs(c_acctbal)) as bigint) as string), ',5')").alias("revenu_annuel"),
        e("cast((c_custkey * 7) % 1100 as string)").alias("score_credit"),
        F.lower("c_mktsegment").alias("gouvernorat"),
        e("case c_custkey % 5 when 0 then 'oui' when 1 then '-1' "
          "else cast(c_custkey % 4 as string) end").alias("nb_retards_paiement"),
        e("case when c_custkey % 9 = 0 then '--' else cast(c_custkey % 3 as string) end")
        .alias("nb_infractions_majeures"),
        e("cast(c_custkey % 12 as string)").alias("points_permis_retires"),
        e("case c_custkey % 5 when 0 then 'oui' when 1 then 'NON' when 2 then '1' "
          "when 3 then 'faux' else '?' end").alias("participe_conduite_responsable"),
        e("case c_custkey % 4 when 0 then ' agressif ' when 1 then 'PRUDENT' when 2 then 'normal' "
          "else 'autre' end").alias("driving_behavior"),
        e("cast(c_custkey % 100 as string)").alias("risque_global"),
        F.col("dup"),
    )


def policies_raw(t: Tables) -> DataFrame:
    e = F.expr
    return t.orders.select(
        F.concat(F.lit("con-"), F.col("o_orderkey").cast("string")).alias("contract_id"),
        F.concat(F.lit("cli-"), F.col("o_custkey").cast("string")).alias("client_id"),
        e("concat(lpad(cast(day(o_orderdate) as string), 2, '0'), '/', "
          "lpad(cast(month(o_orderdate) as string), 2, '0'), '/', cast(year(o_orderdate) as string))")
        .alias("date_debut_contrat"),
        e("case o_orderstatus when 'F' then o_orderdate + interval 150 day "
          "when 'O' then o_orderdate + interval 400 day else o_orderdate + interval 1200 day end")
        .alias("date_fin_contrat"),
        e("lower(substr(o_orderpriority, 3))").alias("type_couverture"),
        F.col("o_totalprice").alias("prime_assurance_annuelle"),
        e("(o_custkey % 4) - 1").alias("nb_sinistres_precedents"),
        e("(o_orderkey % 90) - 5").alias("delai_souscription_sinistre_jours"),
    )


def vehicles_raw(t: Tables) -> DataFrame:
    e = F.expr
    return t.part.select(
        F.concat(F.lit("veh-"), F.col("p_partkey").cast("string")).alias("vehicle_id"),
        F.concat(F.lit("con-"), F.col("p_partkey").cast("string")).alias("contract_id"),
        F.lower("p_type").alias("type_vehicule"),
        F.col("p_brand").alias("marque"),
        F.col("p_name").alias("modele"),
        e("1960 + (p_partkey % 70)").alias("annee_modele"),
        e("p_size * 5").alias("puissance_fiscale"),
        e("(p_partkey * 1777) % 3200000").alias("kilometrage_actuel"),
        e("p_retailprice * 20").alias("valeur_vehicule"),
        F.concat(F.lit("tu "), F.col("p_partkey").cast("string")).alias("immatriculation"),
        e("case when p_partkey % 2 = 0 then 'privé' else 'taxi' end").alias("usage_vehicule"),
    )


def claims_raw(t: Tables) -> DataFrame:
    return claims_raw_from(t.lineitem, t.orders)


def claims_raw_keyed(t: Tables) -> DataFrame:
    """``claims_raw`` with the ``CLAIM_WITHIN`` columns, its rows lying by them (a sort-merge join)."""
    return claims_raw_from(t.lineitem, t.orders.hint("merge"), CLAIM_WITHIN)


def claims_raw_from(li: DataFrame, orders: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Claims binding from line items (batch or stream) and orders (static)."""
    e = F.expr
    o = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    return j.select(
        e("concat(' clm-', cast(l_orderkey as string), '-', cast(l_linenumber as string))").alias("claim_id"),
        e("concat('con-', cast(l_orderkey as string))").alias("contract_id"),
        e("concat('cli-', cast(o_custkey as string))").alias("client_id"),
        e("concat('veh-', cast(l_partkey as string))").alias("vehicle_id"),
        F.col("o_orderdate").alias("date_sinistre_claim"),
        e("case when l_linestatus = 'F' then l_shipdate end").alias("date_cloture_claim"),
        e("case l_returnflag when 'A' then ' accident ' when 'N' then 'VOL' else 'bris de glace' end")
        .alias("type_sinistre_claim"),
        e("case when l_linestatus = 'O' then case l_linenumber % 3 when 0 then 'Ouvert' "
          "when 1 then 'en cours' else 'En cours d expertise' end "
          "else case l_linenumber % 4 when 0 then 'Refusée' when 1 then 'clos avec  indemnisation' "
          "when 2 then 'cloturé' else 'clos_sans_indemnisation' end end").alias("statut_sinistre_claim"),
        F.col("l_extendedprice").alias("montant_estime_dommage_claim"),
        e("l_extendedprice * (1 - l_discount)").alias("montant_indemnisation_claim"),
        e("case when l_discount >= 0.095 then 'oui' when l_discount < 0.005 then '?' else 'non' end")
        .alias("est_frauduleux_claim"),
        e("concat(cast(cast(l_quantity as bigint) as string), ',0')").alias("sla_jours"),
        "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate", *(within or []),
    )


def audit_events(t: Tables) -> DataFrame:
    return audit_events_from(t.events)


def audit_events_from(events: DataFrame) -> DataFrame:
    """Login-attempt binding over the event log (batch or stream), every row of
    it: errors and bare views are failed attempts, all other actions succeed."""
    e = F.expr
    return events.select(
        "event_id",
        F.col("ts").alias("created_at"),
        "user_id",
        e("concat('user', cast(user_id as string))").alias("login_attempted"),
        e("case when event_type in ('error', 'view') then 'LOGIN_FAILED' else 'LOGIN_SUCCESS' end").alias("event_type"),
        e("concat('10.0.0.', cast(cast(floor(value) as bigint) % 4 as string))").alias("ip_address"),
    )


def users(t: Tables) -> DataFrame:
    u = t.events.select("user_id").distinct()
    return u.select(
        "user_id",
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("login"),
        (F.col("user_id") % 10 != 0).alias("is_active"),
        (F.lit(1) + F.col("user_id") % 3).cast("int").alias("role_id"),
    )


def accounts(t: Tables) -> DataFrame:
    """The users with further keys: every 50th has the e-mail address of the user
    before, every 70th, in capitals, the user name of the second before."""
    e = F.expr
    return users(t).select(
        "user_id", "login",
        e("concat('user', cast(if(user_id % 50 = 0, user_id - 1, user_id) as string), '@example.org')").alias("email"),
        e("if(user_id % 70 = 0, upper(concat(' name', cast(user_id - 2 as string))), concat('name', cast(user_id as string)))").alias("username"))
