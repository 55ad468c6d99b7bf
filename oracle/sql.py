"""Final SELECT per registered query (DuckDB dialect) over the shared CTEs."""

from __future__ import annotations

from . import base as B

W = B.with_all
S: dict[str, str] = {}

S["h1_claim_breakdown"] = """
SELECT type_sinistre_claim, claim_severity_bucket, count(*) AS claim_count,
  round_even(sum(montant_indemnisation_claim), 2) AS total_indemnisation_tnd,
  round_even(avg(montant_indemnisation_claim), 2) AS avg_indemnisation_tnd,
  CAST(sum(is_delayed) AS BIGINT) AS delayed_count, CAST(sum(est_frauduleux_claim) AS BIGINT) AS fraud_count
FROM clean_claims WHERE type_sinistre_claim IS NOT NULL AND claim_severity_bucket IS NOT NULL
GROUP BY type_sinistre_claim, claim_severity_bucket"""

S["g1_stg_clean_clients"] = "SELECT * FROM clean_clients"
S["g1_stg_clean_policies"] = "SELECT * FROM clean_policies"
S["g1_stg_clean_vehicles"] = "SELECT * FROM clean_vehicles"
S["g1_stg_clean_claims"] = "SELECT * FROM clean_claims"
S["g2_dim_client"] = """SELECT client_id, nom, genre, age, age_group, revenu_annuel, income_band, score_credit,
  credit_band, gouvernorat, driving_risk_score, financial_stress_score, responsible_behavior_score, risque_global
FROM clean_clients"""
S["g2_dim_policy"] = """SELECT contract_id, client_id, date_debut_contrat, date_fin_contrat, type_couverture,
  prime_assurance_annuelle, nb_sinistres_precedents, delai_souscription_sinistre_jours, policy_duration_days,
  policy_tenure_bucket FROM clean_policies"""
S["g2_dim_vehicle"] = """SELECT vehicle_id, contract_id, type_vehicule, marque, modele, annee_modele, vehicle_age,
  puissance_fiscale, kilometrage_actuel, mileage_per_year, valeur_vehicule, vehicle_value_band, usage_vehicule
FROM clean_vehicles"""
S["g3_dim_time"] = "SELECT * FROM dim_time"
S["g4_fact_claim"] = "SELECT * FROM fact_claim"
S["g6_ml_claim"] = "SELECT * FROM ml_claim"

S["c1_c3_c7_c8_client_text_cleaning"] = f"""
SELECT client_id AS raw_client_id, dup, {B.nid('client_id')} AS client_id,
  {B.nmiss('nom')} AS nom_missing_normalized, {B.ctext(B.nmiss('nom'))} AS nom,
  {B.ctext('gouvernorat', 'upper')} AS gouvernorat_upper, {B.gender('genre')} AS genre,
  {B.driving('driving_behavior')} AS driving_behavior
FROM clients_raw"""

_COLLAPSED = B.strip("regexp_replace(statut_sinistre_claim, '\\s+', ' ', 'g')")
_KEY = (f"translate(replace(regexp_replace({B.ctext('statut_sinistre_claim', 'lower')}, '\\s+', '_', 'g'), "
        f"'''', '_'), 'éèêàç', 'eeeac')")
S["c4_c5_c6_status_standardization"] = f"""
SELECT statut_sinistre_claim, type_sinistre_claim, n,
  {B.status('statut_sinistre_claim')} AS status_clean,
  {_KEY} AS status_key,
  translate(statut_sinistre_claim, 'éèêëàâîïôùûüçÉÈÊËÀÂÎÏÔÙÛÜÇ', 'eeeeaaiiouuucEEEEAAIIOUUUC') AS status_unaccented,
  CASE WHEN {_COLLAPSED} IN ('nan', 'None', '') THEN NULL ELSE {_COLLAPSED} END AS status_collapsed,
  {B.ctext('type_sinistre_claim')} AS type_clean
FROM (SELECT statut_sinistre_claim, type_sinistre_claim, count(*) AS n FROM claims_raw GROUP BY 1, 2) g"""

S["c9_c13_vehicle_text_cleaning"] = f"""
SELECT vehicle_id, replace({B.ctext('immatriculation', 'upper')}, ' ', '') AS immatriculation,
  {B.ctext('type_vehicule')} AS type_vehicule, {B.ctext('usage_vehicule')} AS usage_vehicule,
  upper(replace(type_vehicule, '_', ' ')) AS type_display
FROM vehicles_raw"""

_AGE = B.between_or_null(B.flex('age'), 16, 100)


def _count(x):
    return f"CAST({B.between_or_null(f'floor({B.flex(x)})', 0, None)} AS BIGINT)"


S["d2_d3_d4_d5_client_numeric_parsing"] = f"""
SELECT client_id, dup, {B.flex('age')} AS age_raw_num, {_AGE} AS age,
  {B.flex('revenu_annuel')} AS revenu_annuel, {B.todbl('revenu_annuel')} AS revenu_safe_numeric,
  {_count('nb_retards_paiement')} AS nb_retards_paiement, {_count('nb_infractions_majeures')} AS nb_infractions_majeures,
  {B.tobool('participe_conduite_responsable')} AS participe_bool, {B.flag('participe_conduite_responsable')} AS participe_flag,
  CASE WHEN {_AGE} > 0 AND {_AGE} <= 24 THEN '<25' WHEN {_AGE} > 0 AND {_AGE} <= 34 THEN '25-34'
       WHEN {_AGE} > 0 AND {_AGE} <= 44 THEN '35-44' WHEN {_AGE} > 0 AND {_AGE} <= 54 THEN '45-54'
       WHEN {_AGE} > 0 AND {_AGE} <= 64 THEN '55-64' WHEN {_AGE} > 0 AND {_AGE} <= 120 THEN '65+' END AS age_group,
  CASE WHEN {B.flex('score_credit')} <= 450 THEN 'poor' WHEN {B.flex('score_credit')} <= 600 THEN 'fair'
       WHEN {B.flex('score_credit')} <= 750 THEN 'good' WHEN {B.flex('score_credit')} IS NOT NULL THEN 'excellent' END AS credit_band
FROM clients_raw"""

_DEB = ("CAST(try_strptime(" + B.strip('date_debut_contrat') +
        ", ['%d/%m/%Y %H:%M:%S', '%d/%m/%Y %H:%M', '%d/%m/%Y', '%d-%m-%Y', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d']) AS TIMESTAMP)")
_DUR = f"CAST(CASE WHEN floor({B.secs('deb', 'date_fin_contrat')} / 86400.0) >= 0 THEN floor({B.secs('deb', 'date_fin_contrat')} / 86400.0) END AS DOUBLE)"
S["e1_e2_e5_policy_dates"] = f"""
SELECT contract_id, deb AS date_debut_contrat, {_DUR} AS policy_duration_days,
  CASE WHEN {_DUR} <= 180 THEN '<6m' WHEN {_DUR} <= 365 THEN '6-12m' WHEN {_DUR} <= 730 THEN '1-2y'
       WHEN {_DUR} <= 1095 THEN '2-3y' WHEN {_DUR} IS NOT NULL THEN '3y+' END AS policy_tenure_bucket,
  CAST(strftime(deb, '%Y%m%d') AS INTEGER) AS start_date_key, strftime(deb, '%Y-%m') AS start_period,
  prime_assurance_annuelle / NULLIF(nb_sinistres_precedents, 0) AS premium_per_prior,
  CASE WHEN CAST(nb_sinistres_precedents AS DOUBLE) < 0 THEN 0.0 ELSE CAST(nb_sinistres_precedents AS DOUBLE) END AS nb_sinistres_precedents
FROM (SELECT *, {_DEB} AS deb FROM policies_raw) p"""

_HRS = (f"(CASE WHEN {B.secs('date_sinistre_claim', 'date_cloture_claim')} / 3600.0 >= 0 "
        f"THEN {B.secs('date_sinistre_claim', 'date_cloture_claim')} / 3600.0 END)")
S["e3_e4_claim_durations_and_parts"] = f"""
SELECT claim_id, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax,
  {_HRS} AS duree_traitement_heures, {_HRS} / 24.0 AS duree_traitement_jours,
  year(date_sinistre_claim) AS claim_year, quarter(date_sinistre_claim) AS claim_quarter,
  isodow(date_sinistre_claim) - 1 AS claim_dayofweek, weekofyear(date_sinistre_claim) AS claim_week,
  strftime(date_sinistre_claim, '%B %Y') AS claim_month_label,
  CAST(COALESCE({_HRS} / 24.0 > {B.todbl('sla_jours')}, false) AS INTEGER) AS is_delayed
FROM claims_raw"""

# ---------------------------------------------------------------------------
# scoring
# ---------------------------------------------------------------------------

SCORING_CTES = {
    "dp0": """SELECT a.*, CAST(delay_probability >= 0.5 AS INTEGER) AS predicted_delayed,
  CASE WHEN delay_probability >= 0.5 THEN 'High' WHEN delay_probability >= CAST(0.3 AS DOUBLE) THEN 'Medium' ELSE 'Low' END AS risk_level
FROM active a""",
    "dp": """SELECT dp0.*,
  CAST(CASE WHEN predicted_delayed = 1 THEN least(greatest(round_even(greatest(delay_probability - 0.5, 0.0)
       * (COALESCE(sla_jours, 20.0) * 1.5 + 15.0), 0), 1.0), 90.0) ELSE 0.0 END AS INTEGER) AS predicted_excess_days,
  CASE WHEN predicted_delayed = 1 THEN round_even(COALESCE(montant_indemnisation_claim, 0.0) * delay_probability, 2)
       ELSE 0.0 END AS delay_cost_at_risk_tnd
FROM dp0""",
    "fp0": """SELECT a.*, CAST(fraud_probability >= 0.9 AS INTEGER) AS predicted_fraud,
  1.5 + fraud_probability * 6.0 AS estimated_investigation_hours,
  CASE WHEN fraud_probability >= 0.9 THEN 'Critical' WHEN fraud_probability >= CAST(0.63 AS DOUBLE) THEN 'High'
       WHEN fraud_probability >= CAST(0.36 AS DOUBLE) THEN 'Medium' ELSE 'Low' END AS risk_level
FROM active a""",
    "fp": """SELECT fp0.*, estimated_investigation_hours * 18.75 AS estimated_investigation_cost_tnd,
  CASE risk_level WHEN 'Critical' THEN 'Escalate: SIU review within 24h' WHEN 'High' THEN 'Priority review within 48h'
       WHEN 'Medium' THEN 'Desk review if capacity allows' WHEN 'Low' THEN 'Straight-through processing' END AS recommended_action,
  fraud_probability * COALESCE(montant_indemnisation_claim, 0.0) AS expected_fraud_exposure_tnd,
  CASE WHEN predicted_fraud = 1 THEN fraud_probability * COALESCE(montant_indemnisation_claim, 0.0) * 0.7 ELSE 0.0 END
    AS expected_preventable_loss_tnd
FROM fp0""",
    "cp": """SELECT a.*, CASE WHEN predicted_cost < 5000 THEN 'Low' WHEN predicted_cost < 15000 THEN 'Medium'
  ELSE 'High' END AS cost_risk_level FROM active a""",
    "drec": """SELECT sha256('RUN-20260428-000000' || '|' || claim_id) AS prediction_record_id,
  'RUN-20260428-000000' AS prediction_run_id, TIMESTAMP '2026-04-28 00:00:00' AS scored_at,
  claim_id, client_id, contract_id, vehicle_id, date_sinistre_claim, statut_sinistre_claim, type_sinistre_claim,
  type_couverture, sla_jours, montant_indemnisation_claim, delay_probability, predicted_delayed, risk_level,
  predicted_excess_days, delay_cost_at_risk_tnd, 0.5 AS decision_threshold, 'surrogate' AS model_name,
  (SELECT COALESCE(month(max(date_sinistre_claim)), 4) FROM dp) AS prediction_month
FROM dp""",
}


def WS(extra: dict | None = None) -> str:
    return W({**SCORING_CTES, **(extra or {})})


S["d13_d17_d19_delay_predictions"] = "SELECT * FROM drec"
S["d13_d15_d16_fraud_predictions"] = """SELECT claim_id, client_id, contract_id, vehicle_id, type_sinistre_claim,
  statut_sinistre_claim, fraud_probability, predicted_fraud, risk_level, recommended_action,
  estimated_investigation_hours, estimated_investigation_cost_tnd, expected_fraud_exposure_tnd,
  expected_preventable_loss_tnd, montant_indemnisation_claim FROM fp"""
S["d14_cost_predictions"] = "SELECT claim_id, type_sinistre_claim, predicted_cost, cost_risk_level FROM cp"


def _bd(col: str, label: str) -> str:
    return f"""SELECT {col} AS {label}, count(predicted_cost) AS claim_count,
  round_even(sum(predicted_cost), 2) AS total_indemnisation_tnd, round_even(avg(predicted_cost), 2) AS avg_indemnisation_tnd,
  round_even(sum(predicted_cost) / greatest(max(g), 1.0) * 100.0, 1) AS pct_of_total_budget
FROM cp, (SELECT COALESCE(sum(predicted_cost), 0.0) AS g FROM cp) t WHERE {col} IS NOT NULL GROUP BY {col}"""


S["h1_cost_breakdown_by_claim_type"] = _bd("type_sinistre_claim", "claim_type")
S["h1_cost_breakdown_by_severity"] = _bd("claim_severity_bucket", "severity_bucket")
S["h1_cost_breakdown_by_coverage"] = _bd("type_couverture", "coverage_type")
S["h2_cost_tier_distribution"] = """SELECT cost_risk_level, count(*) AS claim_count,
  round_even(sum(predicted_cost), 2) AS total_value, round_even(count(*) / max(n) * 100.0, 1) AS pct_of_claims
FROM cp, (SELECT count(*) AS n FROM cp) t GROUP BY cost_risk_level"""

S["h3_h22_cost_kpis"] = """
SELECT round_even(tot, 2) AS total_predicted_indemnisation_tnd,
  round_even(CASE WHEN n > 0 THEN tot / n ELSE 0.0 END, 2) AS average_cost_per_claim,
  round_even(hist, 2) AS historical_avg_per_claim_tnd,
  round_even(CASE WHEN n > 0 THEN high / n ELSE 0.0 END, 6) AS high_cost_rate,
  round_even(tot * 0.15, 2) AS recovery_reserve_tnd,
  round_even(CASE WHEN hist IS NOT NULL AND n > 0 THEN (tot - hist * n) / (hist * n) END, 6) AS budget_deviation_risk,
  COALESCE(tt, 'N/A') AS top_claim_type_by_cost, COALESCE(tc, 'N/A') AS top_coverage_type_by_cost,
  n AS total_active_claims, 15000.0 AS cost_threshold_tnd
FROM (SELECT COALESCE(sum(predicted_cost), 0.0) AS tot, count(*) AS n, count_if(cost_risk_level = 'High') AS high FROM cp) a,
  (SELECT avg(montant_indemnisation_claim) AS hist FROM scored
    WHERE NOT COALESCE(statut_sinistre_claim IN ('Ouvert', 'En_cours', 'En_cours_d_expertise'), false)) h,
  (SELECT max(type_sinistre_claim) FILTER (WHERE rk = 1) AS tt FROM (SELECT type_sinistre_claim,
     row_number() OVER (ORDER BY round_even(sum(predicted_cost), 2) DESC, type_sinistre_claim DESC) AS rk
     FROM cp WHERE type_sinistre_claim IS NOT NULL GROUP BY type_sinistre_claim) x) t1,
  (SELECT max(type_couverture) FILTER (WHERE rk = 1) AS tc FROM (SELECT type_couverture,
     row_number() OVER (ORDER BY round_even(sum(predicted_cost), 2) DESC, type_couverture DESC) AS rk
     FROM cp WHERE type_couverture IS NOT NULL GROUP BY type_couverture) y) t2"""

S["h4_h10_delay_run_summary"] = """
SELECT 0.5 AS decision_threshold, n AS total_active_claims, delayed AS predicted_delayed_count,
  n - delayed AS predicted_on_time_count, round_even(delayed / greatest(n, 1) * 100.0, 1) AS predicted_delay_rate_pct,
  high AS high_risk_count, med AS medium_risk_count, low AS low_risk_count, total_excess AS total_excess_days,
  COALESCE(round_even(avg_excess, 1), 0.0) AS avg_excess_days_per_delayed,
  round_even(amt_delayed, 2) AS total_amount_at_risk_tnd, round_even(car, 2) AS cost_at_risk_tnd,
  round_even(delayed * 1200.0, 2) AS estimated_delay_penalty_tnd,
  CAST(greatest(1, ceil(high / 40.0 + (med + low) / 80.0)) AS INTEGER) AS recommended_agents,
  round_even(greatest(1, ceil(high / 40.0 + (med + low) / 80.0)) * 3000.0, 2) AS staffing_cost_tnd,
  round_even(avg_p, 4) AS avg_delay_probability, round_even(max_p, 4) AS max_delay_probability,
  round_even(sum_p, 4) AS estimated_delayed_claims,
  round_even(total_excess / greatest(n, 1), 4) AS avg_excess_days_per_claim,
  round_even(car / NULLIF(delayed, 0), 2) AS cost_at_risk_per_delayed_tnd
FROM (SELECT count(*) AS n, count_if(predicted_delayed = 1) AS delayed,
  count_if(risk_level = 'High') AS high, count_if(risk_level = 'Medium') AS med, count_if(risk_level = 'Low') AS low,
  CAST(COALESCE(sum(CASE WHEN predicted_delayed = 1 THEN predicted_excess_days END), 0) AS BIGINT) AS total_excess,
  avg(CASE WHEN predicted_delayed = 1 THEN predicted_excess_days END) AS avg_excess,
  COALESCE(sum(CASE WHEN predicted_delayed = 1 THEN COALESCE(montant_indemnisation_claim, 0.0) END), 0.0) AS amt_delayed,
  COALESCE(sum(CASE WHEN predicted_delayed = 1 THEN COALESCE(montant_indemnisation_claim, 0.0) * delay_probability END), 0.0) AS car,
  sum(delay_probability) AS sum_p, avg(delay_probability) AS avg_p, max(delay_probability) AS max_p FROM dp) s"""

S["h5_h8_fraud_kpis"] = """
SELECT 0.9 AS threshold_used, n AS total_scored_claims, flagged AS flagged_for_investigation,
  round_even(hours, 4) AS total_investigation_hours, round_even(exposure, 2) AS expected_fraud_exposure_total,
  round_even(flag_exp * 0.7, 2) AS expected_preventable_loss, round_even(hours * 18.75, 2) AS expected_review_cost,
  round_even(flag_exp * 0.7 - hours * 18.75, 2) AS expected_net_savings,
  round_even(CASE WHEN hours * 18.75 > 0 THEN (flag_exp * 0.7 - hours * 18.75) / (hours * 18.75) ELSE 0.0 END, 6) AS expected_roi,
  crit AS critical_count, high AS high_count, med AS medium_count, low AS low_count,
  round_even(flagged / n, 6) AS queue_load_rate, round_even((high + crit) / n, 6) AS high_risk_rate,
  round_even(crit / n, 6) AS intervention_rate, round_even(avg_p, 6) AS avg_fraud_score,
  round_even(sum_p, 4) AS expected_fraud_cases, round_even(sum_pf, 4) AS expected_cases_in_queue
FROM (SELECT count(*) AS n, count_if(predicted_fraud = 1) AS flagged,
  COALESCE(sum(CASE WHEN predicted_fraud = 1 THEN estimated_investigation_hours END), 0.0) AS hours,
  COALESCE(sum(fraud_probability * COALESCE(montant_indemnisation_claim, 0.0)), 0.0) AS exposure,
  COALESCE(sum(CASE WHEN predicted_fraud = 1 THEN fraud_probability * COALESCE(montant_indemnisation_claim, 0.0) END), 0.0) AS flag_exp,
  count_if(risk_level = 'Critical') AS crit, count_if(risk_level = 'High') AS high,
  count_if(risk_level = 'Medium') AS med, count_if(risk_level = 'Low') AS low,
  avg(fraud_probability) AS avg_p, sum(fraud_probability) AS sum_p,
  COALESCE(sum(CASE WHEN predicted_fraud = 1 THEN fraud_probability END), 0.0) AS sum_pf FROM fp) s"""

S["h6_fraud_risk_distribution"] = "SELECT risk_level, count(*) AS n FROM fp GROUP BY risk_level"
S["h7_delay_risk_pivot_by_type"] = """SELECT type_sinistre_claim, count_if(risk_level = 'High') AS high_count,
  count_if(risk_level = 'Medium') AS medium_count, count_if(risk_level = 'Low') AS low_count
FROM dp GROUP BY type_sinistre_claim"""
S["h9_precision_capture_at_10pct"] = """
SELECT 0.1 AS k, CAST(max(m) AS BIGINT) AS top_n, round_even(avg(fraud_probability) * 100.0, 4) AS precision_at_k_pct,
  round_even(sum(fraud_probability) / max(tot) * 100.0, 4) AS capture_at_k_pct
FROM (SELECT fraud_probability, row_number() OVER (ORDER BY fraud_probability DESC, claim_id) AS rk FROM fp) r,
  (SELECT ceil(0.1 * count(*)) AS m, sum(fraud_probability) AS tot FROM fp) t WHERE rk <= m"""
S["h21_delay_coherence_violations"] = """SELECT claim_id, risk_level, predicted_delayed FROM dp
WHERE (risk_level = 'High') <> (predicted_delayed = 1)"""
S["h21_fraud_coherence_violations"] = """SELECT claim_id, risk_level, predicted_fraud FROM fp
WHERE (risk_level = 'Critical') <> (predicted_fraud = 1)"""
S["h23_run_history"] = """SELECT prediction_run_id, count(*) AS total_claims, count_if(predicted_delayed = 1) AS delayed_claims,
  count_if(risk_level = 'High') AS high_risk_claims, round_even(COALESCE(sum(delay_cost_at_risk_tnd), 0.0), 2) AS cost_impact_tnd,
  CASE WHEN count(*) > 0 THEN round_even(count_if(predicted_delayed = 1) / count(*) * 100.0, 1) ELSE 0.0 END AS delayed_pct,
  CASE WHEN count(*) > 0 THEN round_even(count_if(risk_level = 'High') / count(*) * 100.0, 1) ELSE 0.0 END AS high_risk_pct
FROM drec GROUP BY prediction_run_id"""
S["j1_fraud_priority_queue"] = """SELECT * FROM (SELECT row_number() OVER (ORDER BY fraud_probability DESC, claim_id) AS priority_rank,
  claim_id, fraud_probability, risk_level, recommended_action, montant_indemnisation_claim FROM fp) q WHERE priority_rank <= 20"""
S["j2_tiered_fraud_queues"] = """SELECT * FROM (
  SELECT priority_list_type, row_number() OVER (PARTITION BY priority_list_type ORDER BY fraud_probability DESC, claim_id) AS priority_rank,
    claim_id, fraud_probability
  FROM (SELECT 'TOP_20_RISK' AS priority_list_type, * FROM fp
        UNION ALL SELECT 'CRITICAL_TO_MONITOR', * FROM fp WHERE risk_level = 'Critical') u) q WHERE priority_rank <= 20"""
S["j3_top15_high_delay_risk"] = """SELECT claim_id, delay_probability, predicted_excess_days, delay_cost_at_risk_tnd
FROM dp WHERE risk_level = 'High' ORDER BY delay_probability DESC, claim_id LIMIT 15"""
S["j4_delay_prediction_page_3"] = """
SELECT claim_id, delay_probability, risk_level, total_count, CAST(ceil(total_count / 20) AS BIGINT) AS total_pages,
  true AS has_previous, 3 < ceil(total_count / 20) AS has_next
FROM (SELECT claim_id, delay_probability, risk_level FROM dp WHERE risk_level = 'High'
      ORDER BY delay_probability DESC, claim_id LIMIT 20 OFFSET 40) r,
  (SELECT count(*) AS total_count FROM dp WHERE risk_level = 'High') m"""
S["j5_latest_claim"] = """SELECT claim_id, date_sinistre_claim, statut_sinistre_claim FROM clean_claims
ORDER BY date_sinistre_claim DESC NULLS LAST, claim_id DESC LIMIT 1"""
S["b11_c10_cost_dashboard_filter"] = """SELECT claim_id, predicted_cost, cost_risk_level FROM cp
WHERE cost_risk_level = 'Medium' AND contains(claim_id, '-3')"""
S["b11_delay_dashboard_filter"] = """SELECT prediction_run_id, claim_id, delay_probability, predicted_delayed, risk_level FROM drec
WHERE risk_level = 'High' AND contains(claim_id, '-2') AND prediction_run_id = 'RUN-20260428-000000' AND predicted_delayed = 1"""
S["b7_closed_claims_amount"] = """SELECT claim_id, statut_sinistre_claim, montant_indemnisation_claim, montant_estime_dommage_claim
FROM ml_claim WHERE NOT COALESCE(statut_sinistre_claim IN ('Ouvert', 'En_cours', 'En_cours_d_expertise'), false)"""
S["b8_cost_target_claims"] = """SELECT claim_id, statut_sinistre_claim, montant_indemnisation_claim FROM ml_claim
WHERE statut_sinistre_claim IN ('Clos_avec_indemnisation', 'Clos_sans_indemnisation', 'Refusé')"""
_RUN = "sha256('{0}-20260428-000000|' || claim_id) AS prediction_record_id, '{0}-20260428-000000' AS prediction_run_id, TIMESTAMP '2026-04-28 00:00:00' AS scored_at"
_WHO = "claim_id, client_id, contract_id, vehicle_id, date_sinistre_claim, statut_sinistre_claim, type_sinistre_claim"
_PM = "(SELECT COALESCE(month(max(date_sinistre_claim)), 4) FROM active)"
S["b14_cost_records"] = f"""SELECT {_RUN.format('COST')}, {_WHO}, type_couverture, claim_severity_bucket, predicted_cost, cost_risk_level,
  {_PM} AS prediction_month FROM cp"""
S["b14_fraud_records"] = f"""SELECT {_RUN.format('FRAUD')}, {_WHO}, claim_severity_bucket, fraud_probability, risk_level, recommended_action, predicted_fraud,
  estimated_investigation_hours, estimated_investigation_cost_tnd, COALESCE(montant_indemnisation_claim, 0.0) AS claim_amount_tnd,
  COALESCE(fraud_probability * COALESCE(montant_indemnisation_claim, 0.0), 0.0) AS expected_fraud_exposure_claim_tnd,
  COALESCE(CASE WHEN predicted_fraud = 1 THEN fraud_probability * COALESCE(montant_indemnisation_claim, 0.0) * 0.7 END, 0.0)
    AS expected_preventable_loss_claim_tnd, {_PM} AS prediction_month FROM fp"""
S["d22_cost_summary_record"] = f"""SELECT 'COST-20260428-000000' AS prediction_run_id, TIMESTAMP '2026-04-28 00:00:00' AS scored_at, total_active_claims,
  total_predicted_indemnisation_tnd AS total_predicted_cost, average_cost_per_claim, high_cost_rate,
  COALESCE(budget_deviation_risk, 0.0) AS budget_deviation_risk, cost_threshold_tnd, {_PM} AS projection_month FROM ({S["h3_h22_cost_kpis"]}) k"""
S["d22_fraud_summary_record"] = f"""SELECT 'FRAUD-20260428-000000' AS prediction_run_id, TIMESTAMP '2026-04-28 00:00:00' AS scored_at, 'unknown' AS model_name,
  threshold_used, total_scored_claims, flagged_for_investigation, total_investigation_hours, expected_fraud_exposure_total AS expected_fraud_exposure_total_tnd,
  expected_preventable_loss AS expected_preventable_loss_tnd, expected_review_cost AS expected_review_cost_tnd, expected_net_savings AS expected_net_savings_tnd,
  expected_roi, low_count AS low_risk_count, medium_count AS medium_risk_count, high_count AS high_risk_count, critical_count AS critical_risk_count,
  {_PM} AS projection_month FROM ({S["h5_h8_fraud_kpis"]}) k"""
S["h14_prediction_period"] = """SELECT COALESCE(year(max(date_sinistre_claim)), 2026) AS prediction_year,
  COALESCE(month(max(date_sinistre_claim)), 4) AS prediction_month FROM active"""


def oracle_sql() -> dict[str, str]:
    from . import sql_more  # noqa: F401  (registers more entries into S)
    prefix = WS(sql_more.EXTRA_CTES)
    return {k: prefix + v for k, v in S.items()}
