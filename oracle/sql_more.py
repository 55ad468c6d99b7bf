"""Oracle SQL for the queries in ``claimwise/catalog_more.py``."""

from __future__ import annotations

import re

from claimwise import contracts as K

from .sql import S

ACTIVE = "('Ouvert', 'En_cours', 'En_cours_d_expertise')"
KPIS = ["claim_volume", "total_indemnisation", "delay_rate", "fraud_rate", "avg_claim_amount"]


def _f(x: float) -> str:
    """A Python float as an exact DOUBLE literal."""
    return f"CAST({x!r} AS DOUBLE)"


def _interp(c: str) -> str:
    pv = f"last_value({c} IGNORE NULLS) OVER wb"
    pi = f"last_value(CASE WHEN {c} IS NOT NULL THEN idx END IGNORE NULLS) OVER wb"
    nv = f"first_value({c} IGNORE NULLS) OVER wf"
    ni = f"first_value(CASE WHEN {c} IS NOT NULL THEN idx END IGNORE NULLS) OVER wf"
    return (f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN ({pv}) IS NOT NULL AND ({nv}) IS NOT NULL "
            f"THEN ({pv}) + (({nv}) - ({pv})) * (idx - ({pi})) / (({ni}) - ({pi})) "
            f"WHEN ({pv}) IS NOT NULL THEN ({pv}) END AS {c}")


_SEAS = ", ".join(f"('{k}', {m}, {_f(float(v))})" for k, tab in (("claim_volume", K.SEASONAL_VOLUME),
                                                                 ("delay_rate", K.SEASONAL_DELAY),
                                                                 ("fraud_rate", K.SEASONAL_FRAUD))
                  for m, v in tab.items())
_CLAMP = ", ".join(f"('{k}', {_f(lo)}, {_f(hi)}, {'true' if k in ('delay_rate', 'fraud_rate') else 'false'})"
                   for k, (lo, hi) in K.FORECAST_CLAMPS.items())
_NOTES = " ".join(f"WHEN {m} THEN '{t}'" for m, t in K.SEASONAL_NOTE.items())

EXTRA_CTES: dict[str, str] = {
    "ms": f"""SELECT CAST(date_trunc('month', date_sinistre_claim) AS DATE) AS period,
  CAST(count(claim_id) AS DOUBLE) AS claim_volume, COALESCE(sum(montant_indemnisation_claim), 0.0) AS total_indemnisation,
  avg(CAST(is_delayed AS DOUBLE)) AS delay_rate, avg(CAST(est_frauduleux_claim AS DOUBLE)) AS fraud_rate,
  avg(montant_indemnisation_claim) AS avg_claim_amount
FROM ml_claim WHERE NOT COALESCE(statut_sinistre_claim IN {ACTIVE}, false) AND date_sinistre_claim IS NOT NULL
GROUP BY 1 HAVING CAST(date_trunc('month', date_sinistre_claim) AS DATE) < DATE '2026-04-01'""",
    "mgrid": """SELECT CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS DATE) AS period FROM ms""",
    "mg": """SELECT g.period, m.claim_volume, m.total_indemnisation, m.delay_rate, m.fraud_rate, m.avg_claim_amount,
  datediff('month', (SELECT min(period) FROM ms), g.period) AS idx FROM mgrid g LEFT JOIN ms m ON g.period = m.period""",
    "hist": "SELECT period, " + ", ".join(_interp(c) for c in KPIS) + """ FROM mg
WINDOW wb AS (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       wf AS (ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "lng": " UNION ALL ".join(f"SELECT '{c}' AS kpi, period, {c} AS value FROM hist" for c in KPIS),
    "bl": """SELECT kpi, avg(value) AS mean, stddev_samp(value) AS std, avg(value) FILTER (WHERE rn <= 3) AS last_3m_avg,
  CASE WHEN count(*) >= 12 THEN avg(value) FILTER (WHERE rn <= 12) ELSE avg(value) END AS last_12m_avg,
  count(*) AS n_months, max(period) AS last_period
FROM (SELECT *, row_number() OVER (PARTITION BY kpi ORDER BY period DESC) AS rn FROM lng) r GROUP BY kpi""",
    "anc": f"""SELECT greatest(CAST(date_trunc('month', (SELECT max(period) FROM hist)) AS DATE),
  CAST(date_trunc('month', CAST((SELECT max(date_sinistre_claim) FROM ml_claim WHERE statut_sinistre_claim IN {ACTIVE}) AS DATE)) AS DATE)) AS anchor""",
    "fgrid": f"SELECT CAST(anchor + INTERVAL (i) MONTH AS DATE) AS period FROM anc, range(1, {K.FORECAST_HORIZON + 1}) t(i)",
    "lastv": """SELECT kpi, month(period) AS mn, arg_max(value, period) AS value FROM lng WHERE value IS NOT NULL
GROUP BY kpi, month(period)""",
    "pf": "SELECT l.kpi, g.period, l.value FROM fgrid g JOIN lastv l ON month(g.period) = l.mn",
    "f1": "SELECT pf.kpi, pf.period, greatest(pf.value, 0.0) AS value, bl.last_12m_avg AS h12 FROM pf LEFT JOIN bl ON pf.kpi = bl.kpi",
    "f2": f"""SELECT kpi, period, h12, CASE WHEN kpi = 'claim_volume' AND h12 > 0
  AND avg(value) OVER (PARTITION BY kpi) > {_f(K.VOLUME_ANCHOR_FACTOR)} * h12
  THEN value * ({_f(K.VOLUME_SCALE_TARGET)} * h12) / avg(value) OVER (PARTITION BY kpi) ELSE value END AS value FROM f1""",
    "seas": f"SELECT * FROM (VALUES {_SEAS}) s(kpi, mn, factor)",
    "f3": """SELECT f2.kpi, f2.period, f2.h12, CASE WHEN s.factor IS NOT NULL
  THEN f2.value * (s.factor / avg(s.factor) OVER (PARTITION BY f2.kpi)) ELSE f2.value END AS value
FROM f2 LEFT JOIN seas s ON s.kpi = f2.kpi AND s.mn = month(f2.period)""",
    "clampt": f"SELECT * FROM (VALUES {_CLAMP}) c(kpi, lo, hi, always)",
    "f4": """SELECT f3.kpi, f3.period, CASE WHEN c.lo IS NOT NULL AND (c.always OR f3.h12 > 0) AND f3.h12 IS NOT NULL
  THEN least(greatest(f3.value, f3.h12 * c.lo), f3.h12 * c.hi) ELSE f3.value END AS value
FROM f3 LEFT JOIN clampt c ON f3.kpi = c.kpi""",
    "adj": """SELECT kpi, period, CASE WHEN kpi IN ('delay_rate', 'fraud_rate') THEN least(greatest(value, 0.0), 1.0)
  ELSE greatest(value, 0.0) END AS value FROM f4""",
    "fw": "SELECT period, " + ", ".join(f"max(value) FILTER (WHERE kpi = '{k}') AS {k}" for k in KPIS) + " FROM adj GROUP BY period",
    "blr": """SELECT max(last_12m_avg) FILTER (WHERE kpi = 'claim_volume') AS hist12_claim_volume,
  max(last_12m_avg) FILTER (WHERE kpi = 'total_indemnisation') AS hist12_total_indemnisation,
  max(last_3m_avg) FILTER (WHERE kpi = 'claim_volume') AS last3_claim_volume FROM bl""",
    "k1": f"""SELECT period, vol, hist12_claim_volume, hist12_total_indemnisation, last3_claim_volume,
  greatest(COALESCE(total_indemnisation, vol * 800.0), 0.0) AS cost,
  least(greatest(COALESCE(delay_rate, {_f(K.BASELINE_DELAY_RATE)}), 0.0), 1.0) AS dr,
  least(greatest(COALESCE(fraud_rate, {_f(K.BASELINE_FRAUD_RATE)}), 0.0), 1.0) AS fr, avg_claim_amount,
  CAST(least(greatest(round_even({_f(float(K.BASELINE_AGENTS))} * (vol / greatest(COALESCE(hist12_claim_volume, 100.0), 1.0)), 0),
    {_f(float(max(1, K.BASELINE_AGENTS - 7)))}), {_f(float(K.BASELINE_AGENTS + 10))}) AS INTEGER) AS agents
FROM (SELECT fw.*, greatest(COALESCE(claim_volume, 100.0), 0.0) AS vol FROM fw) w, blr""",
    "k2": """SELECT *, greatest(COALESCE(avg_claim_amount, cost / greatest(vol, 1.0)), 0.0) AS av,
  vol * dr AS delays, vol * fr AS cases FROM k1""",
    "k3": f"""SELECT *, cases * av AS exposure, agents * {_f(K.AGENT_MONTHLY_SALARY)} AS staffing,
  delays * {_f(K.DELAY_COST_PER_CLAIM)} AS delay_cost, cases * {_f(K.INVESTIGATION_COST_PER_CLAIM)} AS inv_cost FROM k2""",
    "k4": f"""SELECT *, delay_cost * {_f(K.EARLY_INTERVENTION_EFFICIENCY)} AS preventable,
  greatest(0.0, cases * av * {_f(K.FRAUD_RECOVERY_RATE)} - inv_cost) AS net_fraud FROM k3""",
    "k5": f"""SELECT *, preventable + net_fraud AS net,
  (cost - COALESCE(hist12_total_indemnisation, cost)) / greatest(COALESCE(hist12_total_indemnisation, cost), 1.0) * 100.0 AS budget,
  vol / greatest(agents * {K.AGENT_MONTHLY_CAPACITY}, 1) AS workload,
  (vol - COALESCE(last3_claim_volume, vol)) / greatest(COALESCE(last3_claim_volume, vol), 1.0) * 100.0 AS surge FROM k4""",
    "km": f"""SELECT *, net / greatest(inv_cost + agents * {_f(K.AGENT_INTERVENTION_COST)}, 1.0) * 100.0 AS roi,
  CASE WHEN dr >= {_f(K.DELAY_RATE_CRITICAL)} OR fr >= {_f(K.FRAUD_RATE_WARNING * 2)} THEN 'CRITICAL'
       WHEN dr >= {_f(K.DELAY_RATE_WARNING)} OR fr >= {_f(K.FRAUD_RATE_WARNING)} THEN 'HIGH'
       WHEN dr >= {_f(K.DELAY_RATE_WARNING * 0.65)} THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  surge > {_f(K.VOLUME_SURGE_THRESHOLD * 100)} AS is_surge_month, strftime(period, '%B %Y') AS month,
  strftime(period, '%Y-%m') AS period_label FROM k5""",
}

S["h11_j8_j9_monthly_kpi_series"] = """SELECT strftime(period, '%Y-%m') AS period, round_even(claim_volume, 4) AS claim_volume,
  round_even(total_indemnisation, 2) AS total_indemnisation, round_even(delay_rate, 6) AS delay_rate,
  round_even(fraud_rate, 6) AS fraud_rate, round_even(avg_claim_amount, 2) AS avg_claim_amount FROM hist"""
S["h12_kpi_baselines"] = """SELECT kpi, round_even(mean, 4) AS mean, round_even(std, 4) AS std,
  round_even(last_3m_avg, 4) AS last_3m_avg, round_even(last_12m_avg, 4) AS last_12m_avg, n_months,
  strftime(last_period, '%Y-%m') AS last_period FROM bl"""
S["j10_trailing_volume_means"] = """SELECT strftime(period, '%Y-%m') AS period,
  round_even(avg(claim_volume) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS trailing_3m,
  round_even(avg(claim_volume) OVER (ORDER BY period ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 4) AS trailing_12m FROM hist"""
S["k1_k2_k3_adjusted_point_forecasts"] = "SELECT kpi, strftime(period, '%Y-%m') AS period, round_even(value, 6) AS value FROM adj"

_B15 = _f(K.BUDGET_OVERSHOOT_PCT * 100)
_ALERT_COUNT = (f"(CAST(is_surge_month AS INTEGER) + CAST(dr >= {_f(K.DELAY_RATE_WARNING)} AS INTEGER) "
                f"+ CAST(fr >= {_f(K.FRAUD_RATE_WARNING)} AS INTEGER) + CAST(budget > {_B15} AS INTEGER))")
_MONTH_COLS = f"""period_label, month, CAST(year(period) AS INTEGER) AS year, CAST(month(period) AS INTEGER) AS month_number,
  COALESCE(CASE month(period) {_NOTES} END, '') AS seasonal_context,
  round_even(vol, 1) AS forecast_claim_volume, round_even(cost, 2) AS forecast_total_indemnisation_tnd,
  round_even(dr * 100, 1) AS forecast_delay_rate_pct, round_even(fr * 100, 2) AS forecast_fraud_rate_pct,
  round_even(av, 2) AS forecast_avg_claim_amount_tnd, round_even(delays, 1) AS kpi_expected_delayed_claims,
  round_even(cases, 1) AS kpi_expected_fraud_cases, round_even(exposure, 2) AS kpi_expected_fraud_exposure_tnd,
  agents AS kpi_recommended_agents, round_even(staffing, 2) AS kpi_staffing_cost_tnd,
  round_even(delay_cost, 2) AS kpi_total_delay_cost_tnd, round_even(preventable, 2) AS kpi_preventable_delay_cost_tnd,
  round_even(net_fraud, 2) AS kpi_net_fraud_savings_tnd, round_even(net, 2) AS kpi_net_savings_potential_tnd,
  round_even(roi, 1) AS kpi_intervention_roi_pct, round_even(budget, 1) AS kpi_budget_variance_pct,
  round_even(workload, 3) AS kpi_workload_index, risk_level, round_even(surge, 1) AS volume_surge_pct,
  is_surge_month, {_ALERT_COUNT} AS alert_count"""
S["k5_k6_k7_forecast_monthly_kpis"] = f"SELECT {_MONTH_COLS} FROM km"


def _pf(tmpl: str) -> str:
    return "'" + tmpl.replace("'", "''") + "'"


_MSG_SURGE = f"printf({_pf(K.MSG_VOLUME_SURGE)}, month, surge, greatest(0, agents - {K.BASELINE_AGENTS}))"
_MSG_DELAY = (f"CASE WHEN dr >= {_f(K.DELAY_RATE_CRITICAL)} THEN printf({_pf(K.MSG_DELAY_CRITICAL)}, dr * 100, month) "
              f"ELSE printf({_pf(K.MSG_DELAY_HIGH)}, dr * 100, month) END")
_MSG_FRAUD = f"printf({_pf(K.MSG_FRAUD)}, fr * 100, cases, month, CAST(greatest(1, ceil(cases / 5)) AS INTEGER))"
_MSG_BUDGET = f"printf({_pf(K.MSG_BUDGET)}, budget, month)"
S["k8_k9_forecast_alerts"] = f"""
SELECT period_label, month, risk_level, is_surge_month, 'HIGH' AS alert_level, 'VOLUME_SURGE' AS alert_type,
  {_MSG_SURGE} AS alert_message FROM km WHERE is_surge_month
UNION ALL SELECT period_label, month, risk_level, is_surge_month,
  CASE WHEN dr >= {_f(K.DELAY_RATE_CRITICAL)} THEN 'CRITICAL' ELSE 'HIGH' END, 'DELAY_RISK', {_MSG_DELAY}
  FROM km WHERE dr >= {_f(K.DELAY_RATE_WARNING)}
UNION ALL SELECT period_label, month, risk_level, is_surge_month, 'HIGH', 'FRAUD_RISK', {_MSG_FRAUD}
  FROM km WHERE fr >= {_f(K.FRAUD_RATE_WARNING)}
UNION ALL SELECT period_label, month, risk_level, is_surge_month, 'MEDIUM', 'BUDGET_ALERT', {_MSG_BUDGET}
  FROM km WHERE budget > {_B15}"""

_ALERT_LIST = (f"list_filter([CASE WHEN is_surge_month THEN {_MSG_SURGE} END, "
               f"CASE WHEN dr >= {_f(K.DELAY_RATE_WARNING)} THEN {_MSG_DELAY} END, "
               f"CASE WHEN fr >= {_f(K.FRAUD_RATE_WARNING)} THEN {_MSG_FRAUD} END, "
               f"CASE WHEN budget > {_B15} THEN {_MSG_BUDGET} END], lambda x: x IS NOT NULL)")
_REC_LIST = (f"list_filter([CASE WHEN net > 5000 THEN printf({_pf(K.REC_SAVINGS)}, CAST(trunc(net / 1000) AS BIGINT)) END, "
             f"CASE WHEN delays > 10 THEN printf({_pf(K.REC_DELAYS)}, CAST(trunc(delays) AS BIGINT)) END, "
             f"CASE WHEN cases > 3 THEN printf({_pf(K.REC_FRAUD)}, CAST(ceil(cases) AS BIGINT)) END, "
             f"CASE WHEN workload > 0.85 THEN printf({_pf(K.REC_WORKLOAD)}, workload * 100) END, "
             f"CASE WHEN budget < -10 THEN {_pf(K.REC_BACKLOG)} END], lambda x: x IS NOT NULL)")
S["k10_k12_forecast_monthly_flat"] = f"""SELECT {_MONTH_COLS},
  substring(array_to_string({_ALERT_LIST}, ' | '), 1, 255) AS alert_messages,
  array_to_string({_REC_LIST}, ' | ') AS recommendations_text FROM km"""

_KM_R = f"SELECT *, {_ALERT_COUNT} AS alert_count, round_even(vol, 1) AS rv, round_even(cost, 2) AS rc, " \
        "round_even(dr * 100, 1) AS rd, round_even(fr * 100, 2) AS rf, round_even(delays, 1) AS rdl, " \
        "round_even(exposure, 2) AS rex, round_even(net, 2) AS rn FROM km"
S["h13_k11_forecast_summary"] = f"""
SELECT horizon_months, first_p || ' → ' || last_p AS total_forecast_period, round_even(v, 0) AS total_expected_claims,
  round_even(c, 2) AS total_expected_cost_tnd, round_even(d, 1) AS avg_monthly_delay_rate_pct,
  round_even(f, 2) AS avg_monthly_fraud_rate_pct, round_even(dl, 0) AS total_expected_delays,
  round_even(ex, 2) AS total_fraud_exposure_tnd, round_even(sv, 2) AS total_net_savings_potential_tnd,
  round_even(ag, 1) AS avg_agents_needed_per_month, pv_m AS peak_volume_month, round_even(pv_v, 0) AS peak_volume_claims,
  pd_m AS peak_delay_month, round_even(pd_v, 1) AS peak_delay_rate_pct, pc_m AS peak_cost_month,
  round_even(pc_v, 2) AS peak_cost_tnd, COALESCE(array_to_string(hr, ' | '), '') AS high_risk_months,
  COALESCE(array_to_string(sg, ' | '), '') AS surge_expected_months, total_alerts, critical_alerts, high_alerts,
  COALESCE(NULLIF(concat_ws('  ',
    CASE WHEN len(sg) > 0 THEN printf({_pf(K.INS_SURGE)}, array_to_string(sg, ', ')) END,
    CASE WHEN len(hr) > 0 THEN printf({_pf(K.INS_HIGH_RISK)}, array_to_string(hr, ', ')) END,
    CASE WHEN d > {_f(K.DELAY_RATE_WARNING * 100)} THEN printf({_pf(K.INS_DELAY)}, d) END,
    CASE WHEN f > {_f(K.FRAUD_RATE_WARNING * 100)} THEN printf({_pf(K.INS_FRAUD)}, f) END,
    CASE WHEN sv > 30000 THEN printf({_pf(K.INS_SAVINGS)}, CAST(trunc(sv / 1000) AS BIGINT)) END), ''),
    {_pf(K.INS_STABLE)}) AS strategic_insight
FROM (SELECT count(*) AS horizon_months, min(period_label) AS first_p, max(period_label) AS last_p,
  CAST(sum(CAST(rv AS DECIMAL(28,6))) AS DOUBLE) AS v, CAST(sum(CAST(rc AS DECIMAL(28,6))) AS DOUBLE) AS c, CAST(sum(CAST(rd AS DECIMAL(28,6))) AS DOUBLE) / count(rd) AS d, CAST(sum(CAST(rf AS DECIMAL(28,6))) AS DOUBLE) / count(rf) AS f,
  CAST(sum(CAST(rdl AS DECIMAL(28,6))) AS DOUBLE) AS dl, CAST(sum(CAST(rex AS DECIMAL(28,6))) AS DOUBLE) AS ex, CAST(sum(CAST(rn AS DECIMAL(28,6))) AS DOUBLE) AS sv,
  avg(agents) AS ag,
  (list(month ORDER BY rv DESC, period))[1] AS pv_m, max(rv) AS pv_v,
  (list(month ORDER BY rd DESC, period))[1] AS pd_m, max(rd) AS pd_v,
  (list(month ORDER BY rc DESC, period))[1] AS pc_m, max(rc) AS pc_v,
  COALESCE(list(month ORDER BY period) FILTER (WHERE risk_level IN ('CRITICAL', 'HIGH')), []) AS hr,
  COALESCE(list(month ORDER BY period) FILTER (WHERE is_surge_month), []) AS sg,
  CAST(sum(alert_count) AS INTEGER) AS total_alerts,
  CAST(count_if(dr >= {_f(K.DELAY_RATE_CRITICAL)}) AS INTEGER) AS critical_alerts,
  CAST(sum(alert_count) - count_if(dr >= {_f(K.DELAY_RATE_CRITICAL)}) - count_if(budget > {_B15}) AS INTEGER) AS high_alerts
FROM ({_KM_R}) x) s"""

# ---------------------------------------------------------------------------
# login audit: plain per-user windows over the whole history
# ---------------------------------------------------------------------------

_W_USER = "PARTITION BY known_user_id ORDER BY created_at, event_id"
EXTRA_CTES.update({
    "ak": """SELECT e.*, u.user_id AS known_user_id FROM audit_events e
LEFT JOIN (SELECT * FROM users WHERE is_active) u ON e.login_attempted = u.login""",
    "ks": f"""SELECT *, sum(CASE WHEN event_type = 'LOGIN_SUCCESS' THEN 1 ELSE 0 END)
  OVER ({_W_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp,
  last_value(CASE WHEN event_type = 'LOGIN_SUCCESS' THEN ip_address END IGNORE NULLS)
  OVER ({_W_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_success_ip,
  last_value(CASE WHEN event_type = 'LOGIN_SUCCESS' THEN created_at END IGNORE NULLS)
  OVER ({_W_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_success_at
FROM ak WHERE known_user_id IS NOT NULL""",
    "kf": """SELECT *, CAST(least(COALESCE(sum(CASE WHEN event_type = 'LOGIN_FAILED' THEN 1 ELSE 0 END)
  OVER (PARTITION BY known_user_id, grp ORDER BY created_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0),
  10) + 1 AS INTEGER) AS consecutive_failures
FROM ks WHERE event_type = 'LOGIN_FAILED'""",
    "kfm": """SELECT *, CASE WHEN consecutive_failures >= 3 THEN 'ERROR' ELSE 'WARNING' END AS severity,
  CASE WHEN consecutive_failures >= 3
    THEN printf('User ''%s'' failed login %d times in a row — possible brute force', login_attempted, consecutive_failures)
    ELSE printf('Failed password attempt for user ''%s''', login_attempted) END AS message FROM kf""",
    "alog0": """
SELECT event_id, 0 AS seq, created_at, CAST(NULL AS BIGINT) AS user_id, login_attempted, 'LOGIN_FAILED' AS event_type,
  ip_address, CAST(NULL AS VARCHAR) AS previous_ip, 'WARNING' AS severity,
  printf('Login attempt with unknown user ''%s''', login_attempted) AS message, 1 AS consecutive_failures
FROM ak WHERE known_user_id IS NULL
UNION ALL SELECT event_id, 0, created_at, known_user_id, login_attempted, event_type, ip_address, NULL, severity, message,
  consecutive_failures FROM kfm
UNION ALL SELECT event_id, 1, created_at, known_user_id, login_attempted, 'ACCOUNT_LOCKED', ip_address, NULL, 'ERROR',
  printf('Account ''%s'' flagged: %d consecutive failed login attempts. Password reset recommended.', login_attempted,
         consecutive_failures), consecutive_failures FROM kfm WHERE consecutive_failures = 3
UNION ALL SELECT event_id, 0, created_at, known_user_id, login_attempted, 'IP_CHANGE', ip_address, prev_success_ip, 'WARNING',
  printf('User ''%s'' logged in from new IP %s (previous: %s)', login_attempted, ip_address, prev_success_ip), NULL
  FROM ks WHERE event_type = 'LOGIN_SUCCESS' AND prev_success_ip IS NOT NULL AND prev_success_ip <> ip_address
UNION ALL SELECT event_id, 1, created_at, known_user_id, login_attempted, 'LOGIN_SUCCESS', ip_address, NULL, 'INFO',
  printf('User ''%s'' logged in successfully', login_attempted), NULL FROM ks WHERE event_type = 'LOGIN_SUCCESS'""",
    "alog": """SELECT *, false AS is_resolved, CAST(NULL AS VARCHAR) AS resolved_by, CAST(NULL AS TIMESTAMP) AS resolved_at
FROM alog0""",
})

S["j12_g12_consecutive_failures"] = """SELECT event_id, known_user_id AS user_id, login_attempted, created_at,
  consecutive_failures, severity, message, prev_success_at AS last_success_at FROM kfm"""
S["j13_lockout_alerts"] = """SELECT event_id, created_at, user_id, login_attempted, ip_address, event_type, severity, message,
  consecutive_failures FROM alog WHERE event_type = 'ACCOUNT_LOCKED'"""
S["j14_ip_changes"] = """SELECT event_id, created_at, user_id, login_attempted, ip_address, previous_ip, event_type, severity,
  message FROM alog WHERE event_type = 'IP_CHANGE'"""
S["j15_unknown_logins"] = """SELECT event_id, created_at, user_id, login_attempted, ip_address, event_type, severity, message,
  consecutive_failures FROM alog WHERE user_id IS NULL"""
S["j12_audit_log_replay"] = "SELECT * FROM alog"
S["h18_audit_counters"] = """SELECT count_if(NOT is_resolved AND severity = 'ERROR') AS unresolved_errors,
  count_if(severity = 'ERROR') AS total_errors, count_if(severity = 'WARNING') AS total_warnings,
  count_if(severity = 'INFO') AS total_info,
  count_if(NOT is_resolved AND severity IN ('ERROR', 'WARNING')) AS unresolved_alerts FROM alog"""
S["b12_j7_audit_filter_tail"] = """SELECT event_id, seq, created_at, user_id, severity, message, consecutive_failures FROM alog
WHERE severity = 'ERROR' AND event_type = 'LOGIN_FAILED' ORDER BY created_at DESC, event_id DESC, seq DESC LIMIT 200"""
S["j16_resolve_locked_accounts"] = """
SELECT a.event_id, a.seq, a.user_id, a.event_type, a.severity, h.hit AS is_resolved,
  CASE WHEN h.hit THEN 'admin' END AS resolved_by, CASE WHEN h.hit THEN l.first_lock END AS resolved_at
FROM alog a LEFT JOIN (SELECT user_id, min(created_at) AS first_lock FROM alog WHERE event_type = 'ACCOUNT_LOCKED' GROUP BY user_id) l
  ON a.user_id = l.user_id,
LATERAL (SELECT l.first_lock IS NOT NULL AND a.event_type IN ('LOGIN_FAILED', 'ACCOUNT_LOCKED') AS hit) h"""
_ROLES = ", ".join(f"({i}, '{n}')" for i, n, _d in K.ROLES)
_PERM = ", ".join(f"({i}, '{r}:{a}')" for i, _n, r, a in K.PERMISSIONS)
_RP = ", ".join(f"({r}, {p})" for _i, r, p in K.ROLE_PERMISSIONS)
EXTRA_CTES["uperm"] = f"""
SELECT u.user_id, u.login, u.is_active, u.role_id, r.role_name, rp.permissions FROM users u
LEFT JOIN (SELECT * FROM (VALUES {_ROLES}) r(role_id, role_name)) r ON u.role_id = r.role_id
LEFT JOIN (SELECT role_id, string_agg(p, ',' ORDER BY permission_id) AS permissions
           FROM (VALUES {_RP}) x(role_id, permission_id) JOIN (VALUES {_PERM}) y(permission_id, p) USING (permission_id)
           GROUP BY role_id) rp ON u.role_id = rp.role_id"""
S["g9_audit_log_with_user_role"] = """SELECT a.event_id, a.seq, a.event_type, a.severity, a.user_id, u.login, u.role_name
FROM alog a LEFT JOIN uperm u ON a.user_id = u.user_id"""
S["g10_user_permissions"] = "SELECT * FROM uperm"
EXTRA_CTES["accounts"] = """SELECT user_id, 'user' || user_id AS login,
  'user' || (CASE WHEN user_id % 50 = 0 THEN user_id - 1 ELSE user_id END) || '@example.org' AS email,
  CASE WHEN user_id % 70 = 0 THEN 'name' || (user_id - 2) ELSE 'name' || user_id END AS username FROM users"""
S["g11_login_conflicts"] = " UNION ALL ".join(f"""SELECT a.user_id, '{k}' AS key, any_value(a.{k}) AS value, count(*) AS others, min(o.user_id) AS other
FROM accounts a JOIN accounts o ON a.{k} = o.{k} AND a.user_id <> o.user_id GROUP BY a.user_id""" for k in ("login", "email", "username"))
S["h19_user_counters"] = """SELECT count(*) AS total_users, count_if(is_active) AS active_users, count_if(NOT is_active) AS inactive_users
FROM users"""

# ---------------------------------------------------------------------------
# sources and sinks
# ---------------------------------------------------------------------------
from claimwise.functions.text import to_snake_case as _snake  # noqa: E402

from . import base as _B  # noqa: E402

_RAW_CLIENT_COLS = ["client_id", "nom", "genre", "age", "revenu_annuel", "score_credit", "gouvernorat",
                    "nb_retards_paiement", "nb_infractions_majeures", "points_permis_retires",
                    "participe_conduite_responsable", "driving_behavior", "risque_global"]


def _upl(h: str) -> str:
    s = _snake(h)
    if s not in _RAW_CLIENT_COLS:
        return f'CAST(NULL AS VARCHAR) AS "{h}"'
    v = _B.strip(s)
    return f'CASE WHEN {v} = \'\' THEN NULL ELSE {v} END AS "{h}"'


S["a3_a4_a5_a6_a7_upload_roundtrip"] = ("SELECT " + ", ".join(_upl(h) for h in K.UPLOAD_CONTRACTS["Clients"])
                                         + " FROM clients_raw")
S["a10_reject_row_isolation"] = """
SELECT *, CASE WHEN reject_reason IS NULL THEN 'loaded' ELSE 'quarantined' END AS outcome
FROM (SELECT claim_id, statut_sinistre_claim, sla_jours, date_cloture_claim, duree_traitement_heures,
  CASE WHEN date_cloture_claim IS NOT NULL AND duree_traitement_heures IS NULL THEN 'negative_duration'
  WHEN sla_jours IS NULL THEN 'missing_sla'
  WHEN NOT statut_sinistre_claim IN ('Refusé', 'Clos', 'Clos_avec_indemnisation', 'Clos_sans_indemnisation',
    'Ouvert', 'En_cours', 'En_cours_d_expertise') THEN 'non_canonical_status' END AS reject_reason FROM clean_claims) t"""

# batch loads: three batches stay, by the last digits of the id; no other load adds a row
_NID = _B.nid("client_id")
_PART = f"CAST(regexp_extract({_NID}, '(\\d+)$', 1) AS BIGINT) % 3"
_IN = lambda k: f"(SELECT count(*) FROM clients_raw WHERE dup = 0 AND {_PART} = {k})"
S["a8_a9_batch_load_outcomes"] = f"""SELECT step, load, status, n FROM (VALUES
  (1, 'first', 'loaded', {_IN(0)}), (2, 'second', 'loaded', {_IN(1)}), (3, 'keys repeat', 'rejected', 0), (4, 'again', 'repeated', 0),
  (5, 'keys in the table', 'rejected', 0), (6, 'third', 'loaded', {_IN(2)}), (7, 'third again', 'repeated', 0)) v(step, load, status, n)"""
S["a8_a9_batch_loaded_table"] = f"""SELECT * REPLACE ({_NID} AS client_id),
  CASE {_PART} WHEN 0 THEN 'b0' WHEN 1 THEN 'b1' ELSE 'by content' END AS batch_id FROM clients_raw WHERE dup = 0"""
S["a9_upload_into_table"] = f"""SELECT file, status, n, reason, (SELECT count(*) FROM clients_raw) AS rows_in_table FROM (VALUES
  ('broken', 'rejected', 0, 'Row has 4 columns but header has {len(K.UPLOAD_CONTRACTS["Clients"]) + 1}.'),
  ('whole', 'loaded', (SELECT count(*) FROM clients_raw), NULL), ('whole again', 'repeated', 0, NULL)) v(file, status, n, reason)"""

_PROFILE = ([(c, "text") for c in ("claim_id", "contract_id", "client_id", "vehicle_id")]
            + [("date_sinistre_claim", "datetime"), ("date_cloture_claim", "datetime"), ("type_sinistre_claim", "text"),
               ("statut_sinistre_claim", "text"), ("montant_estime_dommage_claim", "float"), ("montant_indemnisation_claim", "float"),
               ("est_frauduleux_claim", "integer"), ("sla_jours", "float"), ("l_partkey", "integer"), ("l_suppkey", "integer")]
            + [(c, "float") for c in ("l_extendedprice", "l_quantity", "l_discount", "l_tax")] + [("l_shipdate", "datetime")]
            + [("duree_traitement_jours", "float"), ("duree_traitement_heures", "float"), ("is_delayed", "integer"), ("claim_gap_amount", "float"),
               ("claim_gap_ratio", "float"), ("claim_severity_bucket", "text")])
_PROF_ROWS = " UNION ALL ".join(
    f"SELECT {i} AS ordinal, '{c}' AS column_name, '{k}' AS dtype_class, "
    + (f"(SELECT CAST(max(length({c})) AS INTEGER) FROM clean_claims)" if k == "text" else "CAST(NULL AS INTEGER)")
    + " AS max_length" for i, (c, k) in enumerate(_PROFILE))
S["a12_schema_profile"] = f"""SELECT *, CASE WHEN dtype_class = 'text' THEN
  CASE WHEN COALESCE(max_length, 0) <= 50 THEN 'NVARCHAR(50)' WHEN COALESCE(max_length, 0) <= 100 THEN 'NVARCHAR(100)'
       WHEN COALESCE(max_length, 0) <= 255 THEN 'NVARCHAR(255)' ELSE 'NVARCHAR(MAX)' END
  WHEN dtype_class = 'integer' THEN 'BIGINT' WHEN dtype_class = 'float' THEN 'FLOAT'
  WHEN dtype_class = 'datetime' THEN 'DATETIME2' ELSE 'BIT' END AS sql_type FROM ({_PROF_ROWS}) p"""
S["a14_pk_violations_raw_claims"] = f"""SELECT {_B.nid('claim_id')} AS claim_id, count(*) AS n FROM claims_raw
GROUP BY 1 HAVING count(*) > 1 OR {_B.nid('claim_id')} IS NULL"""
S["a16_dry_run_preview"] = """SELECT * FROM (SELECT * FROM clients_raw ORDER BY client_id, dup LIMIT 3) p,
  (SELECT count(*) AS total_rows FROM clients_raw) t"""
S["a19_table_stats"] = f"""SELECT statut_sinistre_claim, count(*) AS status_count, max(t.total_rows) AS total_rows,
  max(t.active_total) AS active_total, (SELECT count(*) FROM (DESCRIBE SELECT * FROM ml_claim)) AS n_columns,
  'vehicle_id, client_id, contract_id, claim_id, date_sinistre_claim, type_sinistre_claim, statut_sinistre_claim, '
  'montant_estime_dommage_claim, montant_indemnisation_claim, est_frauduleux_claim' AS first_columns FROM ml_claim,
  (SELECT count(*) AS total_rows, count_if(statut_sinistre_claim IN {ACTIVE}) AS active_total FROM ml_claim) t
GROUP BY statut_sinistre_claim"""
S["a20_delete_by_pattern"] = "SELECT * FROM clean_claims WHERE NOT claim_id LIKE 'CLM-1%' OR claim_id IS NULL"
S["b3_validate_and_cast"] = """SELECT contract_id, client_id, coalesce(try_strptime(date_debut_contrat, '%d/%m/%Y'), TRY_CAST(date_debut_contrat AS TIMESTAMP)) AS date_debut_contrat,
  CAST(date_fin_contrat AS TIMESTAMP) AS date_fin_contrat, type_couverture,
  CAST(prime_assurance_annuelle AS DOUBLE) AS prime_assurance_annuelle,
  CAST(nb_sinistres_precedents AS DOUBLE) AS nb_sinistres_precedents,
  CAST(delai_souscription_sinistre_jours AS DOUBLE) AS delai_souscription_sinistre_jours,
  CAST(NULL AS DOUBLE) AS policy_duration_days, CAST(NULL AS VARCHAR) AS policy_tenure_bucket FROM policies_raw"""


# The row text and the two sums, per column by type (s text or integer, d double, t timestamp)
def _fp_text(col: str, kind: str) -> str:
    if kind == "t":
        v = f"CAST(epoch_us({col}) AS VARCHAR)"
    elif kind == "d":
        frac = f"({col} - floor({col})) * 4503599627370496.0"
        v = (f"(CAST(CAST(floor({col}) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(floor({frac}) AS BIGINT) AS VARCHAR) || ':' || "
             f"CAST(CAST(floor(({frac} - floor({frac})) * 4503599627370496.0) AS BIGINT) AS VARCHAR))")
    else:
        v = f"CAST({col} AS VARCHAR)"
    return f"CASE WHEN {col} IS NULL THEN 'n' ELSE 'v' || CAST(length({v}) AS VARCHAR) || ':' || {v} END"


_FP_COLS = {
    "clients_raw": [(c, "s") for c in _RAW_CLIENT_COLS] + [("dup", "s")],
    "policies_raw": [("contract_id", "s"), ("client_id", "s"), ("date_debut_contrat", "s"), ("date_fin_contrat", "t"), ("type_couverture", "s"),
                     ("prime_assurance_annuelle", "d"), ("nb_sinistres_precedents", "s"), ("delai_souscription_sinistre_jours", "s")],
    "vehicles_raw": [("vehicle_id", "s"), ("contract_id", "s"), ("type_vehicule", "s"), ("marque", "s"), ("modele", "s"), ("annee_modele", "s"),
                     ("puissance_fiscale", "s"), ("kilometrage_actuel", "s"), ("valeur_vehicule", "d"), ("immatriculation", "s"), ("usage_vehicule", "s")],
    "claims_raw": [("claim_id", "s"), ("contract_id", "s"), ("client_id", "s"), ("vehicle_id", "s"), ("date_sinistre_claim", "t"),
                   ("date_cloture_claim", "t"), ("type_sinistre_claim", "s"), ("statut_sinistre_claim", "s"), ("montant_estime_dommage_claim", "d"),
                   ("montant_indemnisation_claim", "d"), ("est_frauduleux_claim", "s"), ("sla_jours", "s"), ("l_partkey", "s"), ("l_suppkey", "s"),
                   ("l_extendedprice", "d"), ("l_quantity", "d"), ("l_discount", "d"), ("l_tax", "d"), ("l_shipdate", "t")],
}
S["h17_table_fingerprints"] = "SELECT *, n || ':' || sum_low || ':' || sum_high AS fingerprint FROM (" + " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, count(*) AS n,
    CAST(coalesce(sum(CAST('0x' || substr(h, 1, 15) AS UBIGINT)), 0) AS VARCHAR) AS sum_low,
    CAST(coalesce(sum(CAST('0x' || substr(h, 17, 15) AS UBIGINT)), 0) AS VARCHAR) AS sum_high
    FROM (SELECT md5({' || '.join(_fp_text(c, k) for c, k in cols)}) AS h FROM {t}) x""" for t, cols in _FP_COLS.items()) + ") y"

# A table changed if the planted multiset of rows differs from the raw one; a layer if a table below it did
_PLANTED = {
    "clients_raw": "SELECT * REPLACE (CASE WHEN client_id = (SELECT min(client_id) FROM clients_raw) THEN 'planted' ELSE nom END AS nom) FROM clients_raw",
    "policies_raw": "SELECT * FROM policies_raw UNION ALL SELECT * FROM policies_raw WHERE contract_id = (SELECT min(contract_id) FROM policies_raw)",
    "vehicles_raw": "SELECT * FROM vehicles_raw WHERE vehicle_id <> (SELECT min(vehicle_id) FROM vehicles_raw)",
    "claims_raw": """SELECT * REPLACE (CASE WHEN claim_id = (SELECT min(claim_id) FROM claims_raw) THEN type_sinistre_claim ELSE statut_sinistre_claim END
      AS statut_sinistre_claim, CASE WHEN claim_id <> (SELECT min(claim_id) FROM claims_raw) THEN type_sinistre_claim END AS type_sinistre_claim)
      FROM claims_raw""",
}
_BELOW = {"stg_clean_clients": ["clients_raw"], "stg_clean_policies": ["policies_raw"], "stg_clean_vehicles": ["vehicles_raw"],
          "stg_clean_claims": ["claims_raw"], "dw_fact_claim": list(_PLANTED), "ml_claim": list(_PLANTED)}
_S2 = " UNION ALL ".join(
    f"""SELECT '{t}' AS planted, (SELECT count(*) FROM (SELECT * FROM {t} EXCEPT ALL ({q})) a) + (SELECT count(*) FROM (({q}) EXCEPT ALL SELECT * FROM {t}) b) > 0
    AS differs""" for t, q in _PLANTED.items())
_S2_NAMES = ", ".join([f"('{t}', 'table', '{t}')" for t in _PLANTED] + [f"('{n}', 'layer', '{t}')" for n, below in _BELOW.items() for t in below])
S["g15_s2_changed_tables"] = f"""SELECT p.planted, b.name, b.kind, bool_or(b.below = p.planted AND p.differs) AS changed
FROM ({_S2}) p, (VALUES {_S2_NAMES}) b(name, kind, below) GROUP BY p.planted, b.name, b.kind"""
S["g14_distinct_run_ids"] = "SELECT DISTINCT prediction_run_id FROM drec WHERE prediction_run_id IS NOT NULL"

# ---------------------------------------------------------------------------
# streaming results equal the batch definitions
# ---------------------------------------------------------------------------
# five landings by the claim date, every 7th part one later, every 11th sent again; late: 120 days or more behind the newest before
EXTRA_CTES.update({
    "landed": """SELECT c.*, CAST(a.first + r.more AS INTEGER) AS batch_id FROM (SELECT *, least(4, least(4,
  datediff('day', DATE '1995-01-01', CAST(date_sinistre_claim AS DATE)) // 480) + CAST(l_partkey % 7 = 0 AS INTEGER)) AS first FROM cl1) a
  JOIN (VALUES (0), (1)) r(more) ON r.more = 0 OR (a.l_partkey % 11 = 0 AND a.first < 4), LATERAL (SELECT a.* EXCLUDE (first)) c""",
    "marked": """SELECT l.*, coalesce(l.date_sinistre_claim <= t.top - INTERVAL 120 DAY, false) AS late FROM landed l LEFT JOIN (
  SELECT b.batch_id, max(e.date_sinistre_claim) AS top FROM (SELECT DISTINCT batch_id FROM landed) b JOIN landed e ON e.batch_id < b.batch_id
  GROUP BY b.batch_id) t ON l.batch_id = t.batch_id""",
})
S["s1_streaming_claim_ingest"] = "SELECT * FROM marked"
S["s5_streaming_dedup_claim_ids"] = "SELECT DISTINCT claim_id FROM marked WHERE NOT late"
S["s4_streaming_daily_claim_kpis"] = """SELECT strftime(CAST(date_sinistre_claim AS DATE), '%Y-%m-%d') AS day, count(*) AS claims,
  round_even(CAST(sum(CAST(montant_indemnisation_claim AS DECIMAL(28,6))) AS DOUBLE), 2) AS payout, CAST(sum(is_delayed) AS BIGINT) AS delayed
FROM (SELECT DISTINCT * EXCLUDE (batch_id) FROM marked WHERE NOT late) x GROUP BY 1"""
S["s3_streaming_login_monitor"] = """SELECT ks.event_id, ks.known_user_id AS user_id, ks.event_type, ks.ip_address,
  kf.consecutive_failures, CASE WHEN ks.event_type = 'LOGIN_SUCCESS' THEN ks.prev_success_ip END AS previous_success_ip
FROM ks LEFT JOIN kf ON ks.event_id = kf.event_id"""

# ---------------------------------------------------------------------------
# model evaluation
# ---------------------------------------------------------------------------
from claimwise.operators.evaluation import DELAY_THRESHOLDS, FRAUD_THRESHOLDS  # noqa: E402


def _scan_cte(label: str, prob: str, ths: list[float]) -> str:
    vals = ", ".join(f"({_f(t)})" for t in ths)
    return f"""SELECT threshold, n, tp, fp, tn, fn, sp,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
  CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS specificity,
  CASE WHEN n > 0 THEN (tp + tn) / n ELSE 0.0 END AS accuracy
FROM (SELECT th.threshold, count(*) AS n, count_if({prob} >= th.threshold AND {label} = 1) AS tp,
  count_if({prob} >= th.threshold AND {label} <> 1) AS fp, count_if({prob} < th.threshold AND {label} <> 1) AS tn,
  count_if({prob} < th.threshold AND {label} = 1) AS fn,
  COALESCE(sum(CASE WHEN {prob} >= th.threshold THEN {prob} END), 0.0) AS sp
  FROM scored, (VALUES {vals}) th(threshold) WHERE {label} IS NOT NULL GROUP BY th.threshold) c"""


EXTRA_CTES["fscan0"] = _scan_cte("est_frauduleux_claim", "fraud_probability", FRAUD_THRESHOLDS)
EXTRA_CTES["fscan"] = f"""SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1_score,
  tp + fp AS flagged_count, CASE WHEN n > 0 THEN (tp + fp) / n ELSE 0.0 END AS investigation_rate,
  {_f(K.BASE_INVESTIGATION_HOURS)} * (tp + fp) + {_f(K.MAX_INVESTIGATION_HOURS - K.BASE_INVESTIGATION_HOURS)} * sp AS estimated_investigation_hours,
  ({_f(K.BASE_INVESTIGATION_HOURS)} * (tp + fp) + {_f(K.MAX_INVESTIGATION_HOURS - K.BASE_INVESTIGATION_HOURS)} * sp) * {_f(K.AGENT_HOURLY_RATE)} AS review_cost,
  tp * a.avg_fraud_amount * {_f(K.PREVENTED_LOSS_RATIO)} AS prevented_loss, fn * a.avg_fraud_amount AS residual_loss
FROM fscan0, (SELECT COALESCE(avg(montant_indemnisation_claim), 0.0) AS avg_fraud_amount FROM scored WHERE est_frauduleux_claim = 1) a"""
EXTRA_CTES["fscan2"] = "SELECT * EXCLUDE (sp), prevented_loss - review_cost AS net_value FROM fscan"
EXTRA_CTES["dscan"] = _scan_cte("is_delayed", "delay_probability", DELAY_THRESHOLDS)


def _r(cols: list[str], d: int = 4) -> str:
    return ", ".join(f"round_even({c}, {d}) AS {c}" for c in cols)


_DBL = ["threshold", "precision", "recall", "specificity", "accuracy", "f1_score", "investigation_rate",
        "estimated_investigation_hours", "review_cost", "prevented_loss", "residual_loss", "net_value"]
S["m10_m11_fraud_threshold_scan"] = f"SELECT n, tp, fp, tn, fn, flagged_count, {_r(_DBL)} FROM fscan2"

_PF = (f"precision >= {_f(K.FRAUD_MIN_PRECISION)} AND recall >= {_f(K.FRAUD_MIN_RECALL)} "
       f"AND investigation_rate <= {_f(K.FRAUD_MAX_INVESTIGATION_RATE)}")
_BAL = f"recall >= {_f(K.FRAUD_BALANCED_MIN_RECALL)} AND precision >= {_f(K.FRAUD_BALANCED_MIN_PRECISION)}"
_OPC = "threshold, precision, recall, f1_score, net_value, investigation_rate"
S["m12_fraud_operating_points"] = f"""
SELECT 'precision_first' AS operating_point, NOT EXISTS (SELECT 1 FROM fscan2 WHERE {_PF}) AS used_fallback,
  {_r(_OPC.split(', '))} FROM (SELECT * FROM fscan2
  WHERE ({_PF}) OR NOT EXISTS (SELECT 1 FROM fscan2 WHERE {_PF})
  ORDER BY precision DESC, net_value DESC, f1_score DESC, threshold LIMIT 1) a
UNION ALL
SELECT 'balanced', NOT EXISTS (SELECT 1 FROM fscan2 WHERE {_BAL}), {_r(_OPC.split(', '))} FROM (SELECT * FROM fscan2
  WHERE ({_BAL}) OR NOT EXISTS (SELECT 1 FROM fscan2 WHERE {_BAL})
  ORDER BY net_value DESC, f1_score DESC, threshold LIMIT 1) b"""
S["m13_delay_quality_threshold"] = f"""SELECT {_r(['threshold', 'score', 'precision', 'recall', 'accuracy'], 6)} FROM (
  SELECT *, 0.45 * precision + 0.40 * accuracy + 0.15 * recall AS score FROM dscan
  WHERE recall >= {_f(K.DELAY_SCAN_RECALL_FLOOR)} ORDER BY score DESC, threshold LIMIT 1) x"""
S["m14_fraud_roc_pr_auc"] = """
SELECT round_even(sum(pos * (neg_below + 0.5 * neg)) / (max(P) * max(Nn)), 6) AS roc_auc,
  round_even(sum(pos / P * (tp_at / (tp_at + fp_at))), 6) AS average_precision, max(P) AS positives, max(Nn) AS negatives
FROM (SELECT *, COALESCE(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
  sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp_at,
  sum(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp_at
  FROM (SELECT fraud_probability AS s, count_if(est_frauduleux_claim = 1) AS pos, count_if(est_frauduleux_claim <> 1) AS neg
        FROM scored WHERE est_frauduleux_claim IS NOT NULL GROUP BY 1) g) w,
  (SELECT count_if(est_frauduleux_claim = 1) AS P, count_if(est_frauduleux_claim <> 1) AS Nn FROM scored
   WHERE est_frauduleux_claim IS NOT NULL) t"""
EXTRA_CTES["reg0"] = """SELECT montant_estime_dommage_claim AS p, montant_indemnisation_claim AS y FROM ml_claim
WHERE statut_sinistre_claim IN ('Clos_avec_indemnisation', 'Clos_sans_indemnisation', 'Refusé')
AND montant_indemnisation_claim IS NOT NULL AND montant_estime_dommage_claim IS NOT NULL"""
EXTRA_CTES["reg1"] = f"SELECT p, y, p - y AS e, avg(y) OVER () AS my, m.mid FROM reg0, (SELECT ({_B.qlist('y', [0.5])})[1] AS mid FROM reg0) m"
S["m15_cost_regression_metrics"] = f"""
SELECT count(*) AS n, round_even(avg(abs(e)), 4) AS mae, round_even(sqrt(avg(e * e)), 4) AS rmse,
  round_even(1 - sum(e * e) / sum((y - my) * (y - my)), 4) AS r2,
  round_even(({_B.qlist('abs(e)', [0.5])})[1], 4) AS median_ae,
  round_even(COALESCE(count_if(y > mid AND p > mid) / NULLIF(count_if(p > mid), 0), 0.0), 4) AS precision,
  round_even(count_if((y > mid) = (p > mid)) / count(*), 4) AS accuracy,
  round_even((SELECT (sum(rk) FILTER (WHERE y > mid) - count_if(y > mid) * (count_if(y > mid) + 1) / 2) / (count_if(y > mid) * count_if(y <= mid))
    FROM (SELECT y, mid, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rk FROM reg1) r), 4) AS auc
FROM reg1"""
S["m16_forecast_holdout_metrics"] = """
SELECT h.kpi, count(*) AS n, round_even(avg(abs(l.value - h.value)), 4) AS mae,
  round_even(avg(abs(l.value - h.value) / (abs(h.value) + 1e-9)) * 100, 4) AS mape_pct,
  round_even(sqrt(avg((l.value - h.value) * (l.value - h.value))), 4) AS rmse
FROM (SELECT *, row_number() OVER (PARTITION BY kpi ORDER BY period DESC) AS rn FROM lng) h
JOIN lng l ON l.kpi = h.kpi AND CAST(l.period + INTERVAL 12 MONTH AS DATE) = h.period
WHERE h.rn <= 3 AND h.value IS NOT NULL AND l.value IS NOT NULL GROUP BY h.kpi"""
S["h15_h16_fraud_label_profile"] = """
SELECT count(*) AS rows, count_if(est_frauduleux_claim = 1) AS positives,
  round_even(count_if(est_frauduleux_claim = 1) / count(*) * 100, 2) AS positive_rate_pct,
  round_even(avg(montant_indemnisation_claim), 2) AS avg_amount,
  round_even(avg(CASE WHEN est_frauduleux_claim = 1 THEN montant_indemnisation_claim END), 2) AS avg_amount_positive,
  round_even((count(*) - count_if(est_frauduleux_claim = 1)) / greatest(count_if(est_frauduleux_claim = 1), 1), 4) AS imbalance_ratio
FROM ml_claim WHERE est_frauduleux_claim IS NOT NULL"""

# M5, M9: the id's hash, 60 bits of its MD5 with the seed
_H = "CAST('0x' || substr(md5(claim_id || '|42'), 1, 15) AS BIGINT)"
S["m5_stratified_split"] = f"""SELECT claim_id, is_delayed, CASE WHEN rk <= n - (n * 20 + 99) // 100 THEN 'train' ELSE 'test' END AS part FROM (
  SELECT claim_id, is_delayed, row_number() OVER (PARTITION BY is_delayed ORDER BY {_H}, claim_id) AS rk, count(*) OVER (PARTITION BY is_delayed) AS n
  FROM ml_claim WHERE NOT COALESCE(statut_sinistre_claim IN {ACTIVE}, false) AND is_delayed IS NOT NULL) s"""
_EXCESS = """SELECT claim_id, greatest(duree_traitement_jours - sla_jours, 0.0) AS excess_delay_days FROM clean_claims
WHERE is_delayed = 1 AND duree_traitement_jours IS NOT NULL AND sla_jours IS NOT NULL AND duree_traitement_jours > sla_jours"""
# M2, M3: medians and kept categories of the fraud model's training rows
_NUM = ["montant_estime_dommage_claim", "montant_indemnisation_claim", "sla_jours", "claim_gap_amount", "claim_gap_ratio", "prime_assurance_annuelle",
        "nb_sinistres_precedents", "delai_souscription_sinistre_jours", "policy_duration_days", "age", "revenu_annuel", "score_credit",
        "nb_retards_paiement", "nb_infractions_majeures", "points_permis_retires", "driving_risk_score", "financial_stress_score",
        "responsible_behavior_score", "risque_global", "vehicle_age", "valeur_vehicule", "kilometrage_actuel", "mileage_per_year", "puissance_fiscale",
        "premium_to_value_ratio", "claim_year", "claim_month", "claim_quarter", "claim_dayofweek", "claim_hour"]
_CAT = ["type_sinistre_claim", "type_couverture", "policy_tenure_bucket", "age_group", "genre", "income_band", "credit_band", "type_vehicule", "marque",
        "modele", "usage_vehicule", "vehicle_value_band"]
EXTRA_CTES["ftrain"] = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY est_frauduleux_claim ORDER BY {_H}, claim_id) AS rk,
  count(*) OVER (PARTITION BY est_frauduleux_claim) AS n FROM ml_claim WHERE est_frauduleux_claim IS NOT NULL) t WHERE rk <= n - (n * 20 + 99) // 100"""
S["m2_m3_fill_values"] = " UNION ALL ".join(
    [f"""SELECT '{c}' AS feature, 'median' AS kind, 1 AS rank, CAST(NULL AS VARCHAR) AS value, COALESCE(({_B.qlist(f'CAST({c} AS DOUBLE)', [0.5])})[1], 0.0) AS median
FROM ftrain""" for c in _NUM]
    + [f"""SELECT '{c}', 'kept', CAST(r AS INTEGER), value, NULL FROM (SELECT {c} AS value, row_number() OVER (ORDER BY count(*) DESC, {c}) AS r FROM ftrain
WHERE {c} IS NOT NULL GROUP BY {c}) x WHERE r <= 11""" for c in _CAT])
S["g7_duration_labels"] = f"SELECT m.*, e.excess_delay_days FROM ml_claim m JOIN ({_EXCESS}) e ON m.claim_id = e.claim_id"
S["m9_duration_folds"] = f"""SELECT m.claim_id, e.excess_delay_days, CAST({_H.replace('claim_id', 'm.claim_id')} % 2 AS INTEGER) AS fold
FROM ml_claim m JOIN ({_EXCESS}) e ON m.claim_id = e.claim_id"""

# The documents taken apart
_DTOP = "claim_id, delay_probability, predicted_excess_days, delay_cost_at_risk_tnd, type_sinistre_claim, sla_jours"
_DSUM = ("decision_threshold, total_active_claims, predicted_delayed_count, predicted_on_time_count, predicted_delay_rate_pct, high_risk_count, "
         "medium_risk_count, low_risk_count, total_excess_days, avg_excess_days_per_delayed, total_amount_at_risk_tnd, cost_at_risk_tnd, "
         "estimated_delay_penalty_tnd, recommended_agents, staffing_cost_tnd")
S["a18_delay_document"] = f"""SELECT '2026-04-28 00:00:00' AS run_timestamp, 'surrogate' AS model_name, 'TND' AS currency, {_DSUM},
  high_risk_count AS n_high, medium_risk_count AS n_medium, low_risk_count AS n_low, t.* FROM ({S["h4_h10_delay_run_summary"]}) s,
  (SELECT CAST(row_number() OVER (ORDER BY delay_probability DESC, claim_id) - 1 AS INTEGER) AS pos, {_DTOP} FROM dp WHERE risk_level = 'High'
   ORDER BY delay_probability DESC, claim_id LIMIT 15) t"""
S["a18_fraud_document"] = f"""SELECT s.*, t.*, 'montant_indemnisation_claim' AS amount_column, (SELECT count(DISTINCT risk_level) FROM fp) AS n_tiers
FROM ({S["h5_h8_fraud_kpis"]}) s,
  (SELECT CAST(row_number() OVER (ORDER BY fraud_probability DESC, claim_id) - 1 AS INTEGER) AS pos, claim_id, fraud_probability, risk_level,
   recommended_action, client_id, contract_id, type_sinistre_claim, statut_sinistre_claim, predicted_fraud, montant_indemnisation_claim FROM fp
   ORDER BY fraud_probability DESC, claim_id LIMIT 20) t"""
_NAMES = re.findall(r"(?:forecast|kpi)_[a-z_]+", _MONTH_COLS)
S["a18_forecast_document"] = f"""SELECT 'TND' AS currency, t.n AS total_alerts, t.k AS n_flat, m.pos, m.period_label AS period, m.month, m.seasonal_context,
  m.risk_level, m.is_surge_month, {', '.join(f"m.{c} AS {c.split('_', 1)[1]}" for c in _NAMES)}, r.recommendations_text AS recommendations,
  a.alert_level, a.alert_type, a.alert_message
FROM (SELECT *, CAST(row_number() OVER (ORDER BY period_label) - 1 AS INTEGER) AS pos FROM ({S["k5_k6_k7_forecast_monthly_kpis"]}) x) m
LEFT JOIN ({S["k8_k9_forecast_alerts"]}) a ON a.period_label = m.period_label
JOIN ({S["k10_k12_forecast_monthly_flat"]}) r ON r.period_label = m.period_label,
(SELECT CAST(sum(alert_count) AS INTEGER) AS n, CAST(count(*) AS INTEGER) AS k FROM ({S["k5_k6_k7_forecast_monthly_kpis"]}) y) t"""
S["a2_a17_csv_sink_and_scan"] = "SELECT * FROM clean_policies"
S["g8_run_join_records_summary"] = """
SELECT d.prediction_run_id, d.risk_level, s.total_active_claims, s.recommended_agents, count(*) AS n
FROM drec d JOIN (SELECT 'RUN-20260428-000000' AS prediction_run_id, count(*) AS total_active_claims,
  CAST(greatest(1, ceil(count_if(risk_level = 'High') / 40.0 + (count_if(risk_level = 'Medium') + count_if(risk_level = 'Low')) / 80.0)) AS INTEGER) AS recommended_agents
  FROM dp) s ON d.prediction_run_id = s.prediction_run_id
GROUP BY 1, 2, 3, 4"""
S["h20_forecast_alert_counters"] = ("SELECT count(*) AS total_alerts, count_if(upper(alert_level) = 'CRITICAL') AS critical_alerts, "
                                    "count_if(upper(alert_level) = 'HIGH') AS high_alerts, "
                                    "count_if(upper(alert_level) = 'MEDIUM') AS medium_alerts, "
                                    "count_if(upper(alert_level) = 'LOW') AS low_alerts FROM ("
                                    + S["k8_k9_forecast_alerts"] + ") a")
S["j17_chart_arrays"] = """SELECT string_agg(strftime(period, '%Y-%m'), ',' ORDER BY period) AS periods,
  string_agg(CAST(CAST(round_even(claim_volume, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY period) AS volumes,
  string_agg(CAST(CAST(round_even(total_indemnisation, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY period) AS costs
FROM hist"""
