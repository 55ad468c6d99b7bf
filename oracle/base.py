"""Shared DuckDB CTE chain: raw bindings, clean layer, warehouse.

Python functions here are *SQL text macros* (they return DuckDB expression
strings) so that the long cleaning expressions are written once.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# expression macros (DuckDB dialect)
# ---------------------------------------------------------------------------

# FIXED VALUES — the token lists of the contract, restated in SQL
MISSING = ("'', 'nan', 'none', 'null', 'n/a', 'na', 'non renseigne', 'non renseigné', "
           "'non renseignee', 'non renseignée', '-', '--', '?', 'inconnu', 'inconnue'")
TRUE_T = "'1', 'true', 'vrai', 'yes', 'oui', 'y', 't'"
FALSE_T = "'0', 'false', 'faux', 'no', 'non', 'n', 'f'"


def strip(x: str) -> str:
    return f"regexp_replace(CAST({x} AS VARCHAR), '^\\s+|\\s+$', '', 'g')"


def nid(x: str) -> str:
    u = f"upper({strip(x)})"
    return f"(CASE WHEN {u} IN ('NAN', 'NONE', '') THEN NULL ELSE {u} END)"


def nmiss(x: str) -> str:
    s = strip(x)
    return f"(CASE WHEN lower({s}) IN ({MISSING}) THEN NULL ELSE {s} END)"


def title(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all(lower({x}), '(\\p{{L}}+|[^\\p{{L}}]+)', 1), "
            f"lambda r: upper(r[1:1]) || r[2:]), '')")


def ctext(x: str, mode: str = "title") -> str:
    s = strip(x)
    v = f"(CASE WHEN {s} IN ('nan', 'None', '') THEN NULL ELSE {s} END)"
    if mode == "title":
        return f"(CASE WHEN {v} IS NULL THEN NULL ELSE {title(v)} END)"
    if mode == "upper":
        return f"upper({v})"
    if mode == "lower":
        return f"lower({v})"
    return v


def finite(x: str) -> str:
    return f"(CASE WHEN isnan({x}) OR isinf({x}) THEN NULL ELSE {x} END)"


def todbl(x: str) -> str:
    """safe_to_numeric on text."""
    return finite(f"TRY_CAST(replace(regexp_replace(CAST({x} AS VARCHAR), '\\s', '', 'g'), ',', '.') AS DOUBLE)")


def flex(x: str) -> str:
    """to_numeric_flexible on text."""
    m = nmiss(x)
    chunk = f"regexp_extract(replace(replace({m}, ' ', ''), ',', '.'), '([-+]?\\d*\\.?\\d+)', 1)"
    return (f"(CASE WHEN lower({m}) IN ({TRUE_T}) THEN 1.0 WHEN lower({m}) IN ({FALSE_T}) THEN 0.0 "
            f"ELSE {finite(f'TRY_CAST(NULLIF({chunk}, {chr(39)}{chr(39)}) AS DOUBLE)')} END)")


def tobool(x: str) -> str:
    s = strip(x)
    n = f"TRY_CAST({s} AS DOUBLE)"
    return (f"(CASE WHEN {n} = 1 THEN true WHEN {n} = 0 THEN false "
            f"WHEN lower({s}) IN ({TRUE_T}) THEN true WHEN lower({s}) IN ({FALSE_T}) THEN false END)")


def flag(x: str) -> str:
    return f"CAST({tobool(x)} AS INTEGER)"


def clip(x: str, q: str) -> str:
    """winsorise x to the 2-element list q (null bounds -> unchanged)."""
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN {q}[1] IS NOT NULL AND {x} < {q}[1] THEN {q}[1] "
            f"WHEN {q}[2] IS NOT NULL AND {x} > {q}[2] THEN {q}[2] ELSE {x} END)")


def qband(x: str, q: str, labels: list[str]) -> str:
    parts = [f"WHEN {x} IS NULL OR {q}[1] IS NULL THEN NULL"]
    for i, lab in enumerate(labels[:-1], start=1):
        parts.append(f"WHEN {x} <= {q}[{i}] THEN '{lab}'")
    return f"(CASE {' '.join(parts)} ELSE '{labels[-1]}' END)"


def secs(a: str, b: str) -> str:
    return f"(CAST(epoch_us({b}) - epoch_us({a}) AS DOUBLE) / 1e6)"


def qlist(x: str, probs: list[float]) -> str:
    """Exact linear-interpolated quantiles as a list, with the interpolation
    written as (hi_idx - pos)·v[lo] + (pos - lo_idx)·v[hi], pos = (n-1)·p, so
    the result is bit-identical to Spark's ``percentile``."""
    arr = f"list_sort(list({x}) FILTER (WHERE {x} IS NOT NULL))"
    n = f"count({x})"
    items = []
    for p in probs:
        pos = f"(({n} - 1) * CAST({float(p)!r} AS DOUBLE))"
        lo, hi = f"CAST(floor({pos}) AS BIGINT)", f"CAST(ceil({pos}) AS BIGINT)"
        lk, hk = f"{arr}[{lo} + 1]", f"{arr}[{hi} + 1]"
        items.append(f"CASE WHEN {n} = 0 THEN NULL WHEN {lo} = {hi} OR {lk} = {hk} THEN {lk} "
                     f"ELSE (CAST({hi} AS DOUBLE) - {pos}) * {lk} + ({pos} - CAST({lo} AS DOUBLE)) * {hk} END")
    return "[" + ", ".join(items) + "]"


def q2(x: str) -> str:
    return qlist(x, [0.01, 0.99])


STATUS_CASE = """CASE {k}
  WHEN 'refuse' THEN 'Refusé' WHEN 'refusee' THEN 'Refusé' WHEN 'rejet' THEN 'Refusé' WHEN 'rejetee' THEN 'Refusé'
  WHEN 'clos' THEN 'Clos' WHEN 'cloture' THEN 'Clos' WHEN 'cloture_' THEN 'Clos'
  WHEN 'clos_avec_indemnisation' THEN 'Clos_avec_indemnisation' WHEN 'clos_avec_indemnisation_' THEN 'Clos_avec_indemnisation'
  WHEN 'clos_avec_indemnisation.' THEN 'Clos_avec_indemnisation' WHEN 'clos_avec_indemnisation__' THEN 'Clos_avec_indemnisation'
  WHEN 'clos_sans_indemnisation' THEN 'Clos_sans_indemnisation' WHEN 'clos_sans_indemnisation_' THEN 'Clos_sans_indemnisation'
  WHEN 'ouvert' THEN 'Ouvert' WHEN 'en_cours' THEN 'En_cours'
  WHEN 'en_cours_dexpertise' THEN 'En_cours_d_expertise' WHEN 'en_cours_expertise' THEN 'En_cours_d_expertise'
  WHEN 'en_cours_d_expertise' THEN 'En_cours_d_expertise' END"""


def status(x: str) -> str:
    k = f"translate(replace(regexp_replace({ctext(x, 'lower')}, '\\s+', '_', 'g'), '''', '_'), 'éèêàç', 'eeeac')"
    return f"COALESCE({STATUS_CASE.format(k=k)}, {ctext(x, 'title')})"


def gender(x: str) -> str:
    g = f"upper({nmiss(x)})"
    return (f"(CASE {g} WHEN 'MASCULIN' THEN 'M' WHEN 'HOMME' THEN 'M' WHEN 'MALE' THEN 'M' WHEN 'M' THEN 'M' "
            f"WHEN 'FEMININ' THEN 'F' WHEN 'FÉMININ' THEN 'F' WHEN 'FEMME' THEN 'F' WHEN 'FEMALE' THEN 'F' "
            f"WHEN 'F' THEN 'F' END)")


def driving(x: str) -> str:
    t = ctext(nmiss(x), "title")
    return (f"(CASE {t} WHEN 'Aggressive' THEN 'Aggressif' WHEN 'Agressif' THEN 'Aggressif' "
            f"WHEN 'Aggressif' THEN 'Aggressif' WHEN 'Prudent' THEN 'Prudent' WHEN 'Normal' THEN 'Normal' END)")


def between_or_null(x: str, lo, hi) -> str:
    conds = []
    if lo is not None:
        conds.append(f"{x} >= {lo}")
    if hi is not None:
        conds.append(f"{x} <= {hi}")
    return f"(CASE WHEN {' AND '.join(conds)} THEN {x} END)"


def neg_null(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN NULL ELSE {x} END)"


# ---------------------------------------------------------------------------
# raw bindings (valid in both engines)
# ---------------------------------------------------------------------------

RAW = {
"clients_raw": """
select concat(' cli-', cast(c_custkey as string), ' ') as client_id,
  case when c_custkey % 17 = 0 then 'Non renseigné' when c_custkey % 13 = 0 then '' else concat(' ', lower(c_name)) end as nom,
  case c_custkey % 6 when 0 then 'Homme' when 1 then 'femme' when 2 then 'M' when 3 then 'Féminin' when 4 then 'x' end as genre,
  concat(cast(c_custkey % 110 as string), ' ans') as age,
  concat(cast(cast(floor(abs(c_acctbal)) as bigint) as string), ',5') as revenu_annuel,
  cast((c_custkey * 7) % 1100 as string) as score_credit,
  lower(c_mktsegment) as gouvernorat,
  case c_custkey % 5 when 0 then 'oui' when 1 then '-1' else cast(c_custkey % 4 as string) end as nb_retards_paiement,
  case when c_custkey % 9 = 0 then '--' else cast(c_custkey % 3 as string) end as nb_infractions_majeures,
  cast(c_custkey % 12 as string) as points_permis_retires,
  case c_custkey % 5 when 0 then 'oui' when 1 then 'NON' when 2 then '1' when 3 then 'faux' else '?' end as participe_conduite_responsable,
  case c_custkey % 4 when 0 then ' agressif ' when 1 then 'PRUDENT' when 2 then 'normal' else 'autre' end as driving_behavior,
  cast(c_custkey % 100 as string) as risque_global, dup
from (select *, 0 as dup from customer union all select *, 1 as dup from customer where c_custkey % 50 = 0) c""",
"policies_raw": """
select concat('con-', cast(o_orderkey as string)) as contract_id, concat('cli-', cast(o_custkey as string)) as client_id,
  concat(lpad(cast(day(o_orderdate) as string), 2, '0'), '/', lpad(cast(month(o_orderdate) as string), 2, '0'), '/', cast(year(o_orderdate) as string)) as date_debut_contrat,
  case o_orderstatus when 'F' then o_orderdate + interval 150 day when 'O' then o_orderdate + interval 400 day else o_orderdate + interval 1200 day end as date_fin_contrat,
  lower(substr(o_orderpriority, 3)) as type_couverture, o_totalprice as prime_assurance_annuelle,
  (o_custkey % 4) - 1 as nb_sinistres_precedents, (o_orderkey % 90) - 5 as delai_souscription_sinistre_jours
from orders""",
"vehicles_raw": """
select concat('veh-', cast(p_partkey as string)) as vehicle_id, concat('con-', cast(p_partkey as string)) as contract_id,
  lower(p_type) as type_vehicule, p_brand as marque, p_name as modele, 1960 + (p_partkey % 70) as annee_modele,
  p_size * 5 as puissance_fiscale, (p_partkey * 1777) % 3200000 as kilometrage_actuel, p_retailprice * 20 as valeur_vehicule,
  concat('tu ', cast(p_partkey as string)) as immatriculation, case when p_partkey % 2 = 0 then 'privé' else 'taxi' end as usage_vehicule
from part""",
"claims_raw": """
select concat(' clm-', cast(l_orderkey as string), '-', cast(l_linenumber as string)) as claim_id,
  concat('con-', cast(l_orderkey as string)) as contract_id, concat('cli-', cast(o_custkey as string)) as client_id,
  concat('veh-', cast(l_partkey as string)) as vehicle_id, o_orderdate as date_sinistre_claim,
  case when l_linestatus = 'F' then l_shipdate end as date_cloture_claim,
  case l_returnflag when 'A' then ' accident ' when 'N' then 'VOL' else 'bris de glace' end as type_sinistre_claim,
  case when l_linestatus = 'O' then case l_linenumber % 3 when 0 then 'Ouvert' when 1 then 'en cours' else 'En cours d expertise' end
       else case l_linenumber % 4 when 0 then 'Refusée' when 1 then 'clos avec  indemnisation' when 2 then 'cloturé' else 'clos_sans_indemnisation' end end as statut_sinistre_claim,
  l_extendedprice as montant_estime_dommage_claim, l_extendedprice * (1 - l_discount) as montant_indemnisation_claim,
  case when l_discount >= 0.095 then 'oui' when l_discount < 0.005 then '?' else 'non' end as est_frauduleux_claim,
  concat(cast(cast(l_quantity as bigint) as string), ',0') as sla_jours,
  l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate
from lineitem join orders on l_orderkey = o_orderkey""",
"audit_events": """
select event_id, ts as created_at, user_id, concat('user', cast(user_id as string)) as login_attempted,
  case when event_type = 'error' or event_type = 'view' then 'LOGIN_FAILED' else 'LOGIN_SUCCESS' end as event_type,
  concat('10.0.0.', cast(cast(floor(value) as bigint) % 4 as string)) as ip_address
from events""",
"users": """
select user_id, concat('user', cast(user_id as string)) as login, user_id % 10 <> 0 as is_active, cast(1 + user_id % 3 as int) as role_id
from (select distinct user_id from events) u""",
}

# ---------------------------------------------------------------------------
# clean layer
# ---------------------------------------------------------------------------

CLEAN = {}

CLEAN["cc1"] = f"""
SELECT client_id,
  {ctext(nmiss('nom'))} AS nom,
  {gender('genre')} AS genre,
  {between_or_null(flex('age'), 16, 100)} AS age,
  {neg_null(flex('revenu_annuel'))} AS revenu_annuel,
  {between_or_null(flex('score_credit'), 0, 1000)} AS score_credit,
  {ctext(nmiss('gouvernorat'))} AS gouvernorat,
  CAST({between_or_null(f"floor({flex('nb_retards_paiement')})", 0, None)} AS BIGINT) AS nb_retards_paiement,
  CAST({between_or_null(f"floor({flex('nb_infractions_majeures')})", 0, None)} AS BIGINT) AS nb_infractions_majeures,
  CAST({between_or_null(f"floor({flex('points_permis_retires')})", 0, None)} AS BIGINT) AS points_permis_retires,
  {flag('participe_conduite_responsable')} AS participe_conduite_responsable,
  {driving('driving_behavior')} AS driving_behavior,
  {flex('risque_global')} AS risque_global,
  dup
FROM (SELECT * REPLACE ({nid('client_id')} AS client_id) FROM clients_raw) r
WHERE client_id IS NOT NULL"""

CLEAN["ccq1"] = f"""SELECT {q2('revenu_annuel')} AS q_rev, {q2('score_credit')} AS q_score,
  {q2('risque_global')} AS q_rg FROM cc1"""

CLEAN["cc2"] = f"""SELECT cc1.* REPLACE ({clip('revenu_annuel', 'q_rev')} AS revenu_annuel,
  {clip('score_credit', 'q_score')} AS score_credit, {clip('risque_global', 'q_rg')} AS risque_global)
FROM cc1, ccq1"""

CLEAN["ccq2"] = f"SELECT {qlist('revenu_annuel', [0.2, 0.4, 0.6, 0.8])} AS q_inc FROM cc2"

CLEAN["cc3"] = f"""SELECT cc2.*,
  CASE WHEN age > 0 AND age <= 24 THEN '<25' WHEN age > 0 AND age <= 34 THEN '25-34'
       WHEN age > 0 AND age <= 44 THEN '35-44' WHEN age > 0 AND age <= 54 THEN '45-54'
       WHEN age > 0 AND age <= 64 THEN '55-64' WHEN age > 0 AND age <= 120 THEN '65+' END AS age_group,
  {qband('revenu_annuel', 'q_inc', ['very_low', 'low', 'mid', 'high', 'very_high'])} AS income_band,
  CASE WHEN score_credit <= 450 THEN 'poor' WHEN score_credit <= 600 THEN 'fair'
       WHEN score_credit <= 750 THEN 'good' WHEN score_credit IS NOT NULL THEN 'excellent' END AS credit_band,
  greatest(COALESCE(CAST(nb_infractions_majeures AS DOUBLE), 0.0)
           + COALESCE(CAST(points_permis_retires AS DOUBLE) / 10.0, 0.0), 0.0) AS driving_risk_score,
  greatest(COALESCE(CAST(nb_retards_paiement AS DOUBLE), 0.0), 0.0) AS financial_stress_score,
  CAST(COALESCE(participe_conduite_responsable, 0) AS INTEGER) AS responsible_behavior_score
FROM cc2, ccq2"""

CLEAN["clean_clients"] = """SELECT client_id, nom, genre, age, age_group, revenu_annuel, income_band, score_credit,
  credit_band, gouvernorat, nb_retards_paiement, nb_infractions_majeures, points_permis_retires,
  participe_conduite_responsable, driving_behavior, risque_global, driving_risk_score,
  financial_stress_score, responsible_behavior_score
FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY dup) AS rn FROM cc3) WHERE rn = 1"""

CLEAN["cp0"] = f"""
SELECT {nid('contract_id')} AS contract_id, {nid('client_id')} AS client_id,
  CAST(try_strptime({strip('date_debut_contrat')}, ['%d/%m/%Y %H:%M:%S', '%d/%m/%Y %H:%M', '%d/%m/%Y', '%d-%m-%Y', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d']) AS TIMESTAMP) AS date_debut_contrat,
  CAST(date_fin_contrat AS TIMESTAMP) AS date_fin_contrat,
  {ctext('type_couverture')} AS type_couverture,
  {neg_null('CAST(prime_assurance_annuelle AS DOUBLE)')} AS prime_assurance_annuelle,
  CASE WHEN CAST(nb_sinistres_precedents AS DOUBLE) < 0 THEN 0.0 ELSE CAST(nb_sinistres_precedents AS DOUBLE) END AS nb_sinistres_precedents,
  {neg_null('CAST(delai_souscription_sinistre_jours AS DOUBLE)')} AS delai_souscription_sinistre_jours
FROM policies_raw"""

CLEAN["cpq"] = f"SELECT {q2('prime_assurance_annuelle')} AS q_p, {q2('delai_souscription_sinistre_jours')} AS q_d FROM cp0"

CLEAN["cp1"] = f"""SELECT contract_id, client_id, date_debut_contrat, date_fin_contrat, type_couverture,
  {clip('prime_assurance_annuelle', 'q_p')} AS prime_assurance_annuelle, nb_sinistres_precedents,
  {clip('delai_souscription_sinistre_jours', 'q_d')} AS delai_souscription_sinistre_jours,
  CAST(CASE WHEN floor({secs('date_debut_contrat', 'date_fin_contrat')} / 86400.0) >= 0
            THEN floor({secs('date_debut_contrat', 'date_fin_contrat')} / 86400.0) END AS DOUBLE) AS policy_duration_days
FROM cp0, cpq"""

CLEAN["clean_policies"] = """SELECT * EXCLUDE (rn) FROM (
  SELECT *, CASE WHEN policy_duration_days <= 180 THEN '<6m' WHEN policy_duration_days <= 365 THEN '6-12m'
    WHEN policy_duration_days <= 730 THEN '1-2y' WHEN policy_duration_days <= 1095 THEN '2-3y'
    WHEN policy_duration_days IS NOT NULL THEN '3y+' END AS policy_tenure_bucket,
    row_number() OVER (PARTITION BY contract_id ORDER BY client_id NULLS FIRST, date_debut_contrat NULLS FIRST) AS rn
  FROM cp1) WHERE rn = 1 AND contract_id IS NOT NULL"""

CLEAN["cv0"] = f"""
SELECT {nid('vehicle_id')} AS vehicle_id, {nid('contract_id')} AS contract_id,
  {ctext('type_vehicule')} AS type_vehicule, {ctext('marque')} AS marque, {ctext('modele')} AS modele,
  {ctext('usage_vehicule')} AS usage_vehicule,
  replace({ctext('immatriculation', 'upper')}, ' ', '') AS immatriculation,
  {between_or_null('CAST(annee_modele AS DOUBLE)', 1970, 2027)} AS annee_modele,
  {between_or_null('CAST(puissance_fiscale AS DOUBLE)', 0, 200)} AS puissance_fiscale,
  {between_or_null('CAST(kilometrage_actuel AS DOUBLE)', 0, 3000000)} AS kilometrage_actuel,
  {between_or_null('CAST(valeur_vehicule AS DOUBLE)', 0, 50000000)} AS valeur_vehicule
FROM vehicles_raw"""

CLEAN["cv1"] = f"""SELECT *, {between_or_null('2026.0 - annee_modele', 0, 100)} AS vehicle_age FROM cv0"""
CLEAN["cvq1"] = f"""SELECT {q2('puissance_fiscale')} AS q_pw, {q2('kilometrage_actuel')} AS q_km,
  {q2('valeur_vehicule')} AS q_val FROM cv1"""
CLEAN["cv2"] = f"""SELECT cv1.* REPLACE ({clip('puissance_fiscale', 'q_pw')} AS puissance_fiscale,
    {clip('kilometrage_actuel', 'q_km')} AS kilometrage_actuel, {clip('valeur_vehicule', 'q_val')} AS valeur_vehicule),
  {between_or_null(f"({clip('kilometrage_actuel', 'q_km')}) / NULLIF(vehicle_age, 0)", 0, 300000)} AS mileage_per_year
FROM cv1, cvq1"""
CLEAN["cvq2"] = f"""SELECT {q2('mileage_per_year')} AS q_mpy,
  {qlist('valeur_vehicule', [0.2, 0.4, 0.6, 0.8])} AS q_vb FROM cv2"""
CLEAN["clean_vehicles"] = f"""SELECT * EXCLUDE (rn) FROM (
  SELECT cv2.* REPLACE ({clip('mileage_per_year', 'q_mpy')} AS mileage_per_year),
    {qband('valeur_vehicule', 'q_vb', ['very_low', 'low', 'mid', 'high', 'very_high'])} AS vehicle_value_band,
    row_number() OVER (PARTITION BY vehicle_id ORDER BY contract_id) AS rn
  FROM cv2, cvq2) WHERE rn = 1 AND vehicle_id IS NOT NULL"""

CLEAN["cl0"] = f"""
SELECT {nid('claim_id')} AS claim_id, {nid('contract_id')} AS contract_id, {nid('client_id')} AS client_id,
  {nid('vehicle_id')} AS vehicle_id,
  CAST(date_sinistre_claim AS TIMESTAMP) AS date_sinistre_claim, CAST(date_cloture_claim AS TIMESTAMP) AS date_cloture_claim,
  {ctext('type_sinistre_claim')} AS type_sinistre_claim,
  {status('statut_sinistre_claim')} AS statut_sinistre_claim,
  {neg_null('CAST(montant_estime_dommage_claim AS DOUBLE)')} AS montant_estime_dommage_claim,
  {neg_null('CAST(montant_indemnisation_claim AS DOUBLE)')} AS montant_indemnisation_claim,
  {flag('est_frauduleux_claim')} AS est_frauduleux_claim,
  {neg_null(todbl('sla_jours'))} AS sla_jours,
  l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate
FROM claims_raw"""

_H = f"(CASE WHEN {secs('date_sinistre_claim', 'date_cloture_claim')} / 3600.0 >= 0 THEN {secs('date_sinistre_claim', 'date_cloture_claim')} / 3600.0 END)"
_BOTH = "date_sinistre_claim IS NOT NULL AND date_cloture_claim IS NOT NULL"
CLEAN["cl1"] = f"""SELECT *,
  CAST(COALESCE(duree_traitement_jours > sla_jours, false) AS INTEGER) AS is_delayed
FROM (SELECT cl0.*,
  CASE WHEN {_BOTH} THEN {_H} / 24.0 ELSE CAST(NULL AS DOUBLE) END AS duree_traitement_jours,
  CASE WHEN {_BOTH} THEN {_H} ELSE CAST(NULL AS DOUBLE) END AS duree_traitement_heures
  FROM cl0) x"""
CLEAN["clq1"] = f"""SELECT {q2('montant_estime_dommage_claim')} AS q_est, {q2('montant_indemnisation_claim')} AS q_ind FROM cl1"""
CLEAN["cl2"] = f"""SELECT *, montant_indemnisation_claim - montant_estime_dommage_claim AS claim_gap_amount,
  (montant_indemnisation_claim - montant_estime_dommage_claim) / NULLIF(montant_estime_dommage_claim, 0) AS claim_gap_ratio
FROM (SELECT cl1.* REPLACE ({clip('montant_estime_dommage_claim', 'q_est')} AS montant_estime_dommage_claim,
  {clip('montant_indemnisation_claim', 'q_ind')} AS montant_indemnisation_claim) FROM cl1, clq1) x"""
CLEAN["clq2"] = f"""SELECT {q2('claim_gap_ratio')} AS q_gr,
  {qlist('montant_indemnisation_claim', [0.5, 0.8, 0.95])} AS q_sev FROM cl2"""
CLEAN["cl3"] = f"""SELECT cl2.* REPLACE ({clip('claim_gap_ratio', 'q_gr')} AS claim_gap_ratio),
  {qband('montant_indemnisation_claim', 'q_sev', ['low', 'medium', 'high', 'very_high'])} AS claim_severity_bucket
FROM cl2, clq2"""
CLEAN["clean_claims"] = """SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity,
    l_discount, l_tax, l_shipdate) AS rn FROM cl3 WHERE claim_id IS NOT NULL) WHERE rn = 1"""

# ---------------------------------------------------------------------------
# warehouse
# ---------------------------------------------------------------------------

WH = {}
WH["fact0"] = """
SELECT c.* EXCLUDE (client_id, date_cloture_claim, duree_traitement_jours, duree_traitement_heures, sla_jours, is_delayed),
  COALESCE(c.client_id, p.client_id) AS client_id,
  p.type_couverture, p.prime_assurance_annuelle, p.nb_sinistres_precedents, p.delai_souscription_sinistre_jours,
  p.policy_duration_days, p.policy_tenure_bucket
FROM clean_claims c LEFT JOIN clean_policies p ON c.contract_id = p.contract_id"""
WH["fact1"] = """
SELECT f.*, k.risque_global, k.driving_risk_score, k.financial_stress_score, k.responsible_behavior_score,
  v.vehicle_age, v.valeur_vehicule, v.mileage_per_year, v.vehicle_value_band, v.usage_vehicule, v.type_vehicule,
  CAST(strftime(f.date_sinistre_claim, '%Y%m%d') AS INTEGER) AS date_key,
  f.montant_indemnisation_claim / NULLIF(f.prime_assurance_annuelle, 0) AS loss_ratio
FROM fact0 f LEFT JOIN clean_clients k ON f.client_id = k.client_id
LEFT JOIN clean_vehicles v ON f.vehicle_id = v.vehicle_id"""
WH["factq"] = f"SELECT {q2('loss_ratio')} AS q_lr FROM fact1"
WH["fact_claim"] = f"SELECT fact1.* REPLACE ({clip('loss_ratio', 'q_lr')} AS loss_ratio) FROM fact1, factq"

WH["ml0"] = """
SELECT c.* EXCLUDE (date_cloture_claim, duree_traitement_jours, duree_traitement_heures),
  p.type_couverture, p.prime_assurance_annuelle, p.nb_sinistres_precedents, p.delai_souscription_sinistre_jours,
  p.policy_duration_days, p.policy_tenure_bucket, p.date_debut_contrat,
  k.age, k.age_group, k.genre, k.revenu_annuel, k.income_band, k.score_credit, k.credit_band,
  k.nb_retards_paiement, k.nb_infractions_majeures, k.points_permis_retires, k.driving_risk_score,
  k.financial_stress_score, k.responsible_behavior_score, k.risque_global,
  v.type_vehicule, v.marque, v.modele, v.usage_vehicule, v.vehicle_age, v.valeur_vehicule, v.vehicle_value_band,
  v.kilometrage_actuel, v.mileage_per_year, v.puissance_fiscale,
  p.prime_assurance_annuelle / NULLIF(v.valeur_vehicule, 0) AS premium_to_value_ratio,
  year(c.date_sinistre_claim) AS claim_year, month(c.date_sinistre_claim) AS claim_month,
  quarter(c.date_sinistre_claim) AS claim_quarter, isodow(c.date_sinistre_claim) - 1 AS claim_dayofweek,
  hour(c.date_sinistre_claim) AS claim_hour
FROM clean_claims c
LEFT JOIN clean_policies p ON c.contract_id = p.contract_id
LEFT JOIN clean_clients k ON c.client_id = k.client_id
LEFT JOIN clean_vehicles v ON c.vehicle_id = v.vehicle_id"""
WH["mlq"] = f"SELECT {q2('premium_to_value_ratio')} AS q_ptv FROM ml0"
WH["ml_claim"] = f"SELECT ml0.* REPLACE ({clip('premium_to_value_ratio', 'q_ptv')} AS premium_to_value_ratio) FROM ml0, mlq"

WH["dim_time"] = """
SELECT CAST(strftime(full_date, '%Y%m%d') AS INTEGER) AS date_key, full_date, year(full_date) AS year,
  month(full_date) AS month, day(full_date) AS day, quarter(full_date) AS quarter, weekofyear(full_date) AS week_of_year
FROM (SELECT DISTINCT CAST(d AS DATE) AS full_date FROM (
  SELECT date_debut_contrat AS d FROM clean_policies UNION ALL SELECT date_fin_contrat FROM clean_policies
  UNION ALL SELECT date_sinistre_claim FROM clean_claims UNION ALL SELECT date_cloture_claim FROM clean_claims) u
  WHERE d IS NOT NULL) t"""

# active-claim scoring view (surrogate probabilities; see FIXTURES §3)
WH["scored"] = """
SELECT m.*, l_quantity / 50.0 AS delay_probability, l_discount * 10 AS fraud_probability,
  montant_indemnisation_claim / 8 AS predicted_cost
FROM ml_claim m"""
WH["active"] = """SELECT * FROM scored WHERE statut_sinistre_claim IN ('Ouvert', 'En_cours', 'En_cours_d_expertise')"""


def with_all(extra: dict[str, str] | None = None) -> str:
    """Every CTE in dependency order; DuckDB skips the unreferenced ones."""
    ctes = {**RAW, **CLEAN, **WH, **(extra or {})}
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + "\n"
