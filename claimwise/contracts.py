"""Contracts: column whitelists, id aliases, and the fixed business values.

Everything under a "FIXED VALUES" comment must equal the behaviour being
matched (token lists, lookup maps, band edges, business constants); they are
stated plainly, in natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — missing / boolean tokens (compared after trim + lower)
# ---------------------------------------------------------------------------
MISSING_TOKENS = [
    "", "nan", "none", "null", "n/a", "na",
    "non renseigne", "non renseigné", "non renseignee", "non renseignée",
    "-", "--", "?", "inconnu", "inconnue",
]
TRUE_TOKENS = ["1", "true", "vrai", "yes", "oui", "y", "t"]
FALSE_TOKENS = ["0", "false", "faux", "no", "non", "n", "f"]
# clean_text treats only these exact stripped strings as missing
TEXT_NULL_TOKENS = ["nan", "None", ""]
# normalize_id treats these upper-cased stripped strings as missing
ID_NULL_TOKENS = ["NAN", "NONE", ""]

# ---------------------------------------------------------------------------
# FIXED VALUES — accent removal map (26 characters), as (accented, plain)
# ---------------------------------------------------------------------------
ACCENT_FROM = "éèêëàâîïôùûüçÉÈÊËÀÂÎÏÔÙÛÜÇ"
ACCENT_TO = "eeeeaaiiouuucEEEEAAIIOUUUC"

# ---------------------------------------------------------------------------
# FIXED VALUES — claim status standardisation (key after lower, whitespace
# runs -> "_", é/è/ê -> e, à -> a, ç -> c)
# ---------------------------------------------------------------------------
STATUS_MAP = {
    "refuse": "Refusé",
    "refusee": "Refusé",
    "rejet": "Refusé",
    "rejetee": "Refusé",
    "clos": "Clos",
    "cloture": "Clos",
    "cloture_": "Clos",
    "clos_avec_indemnisation": "Clos_avec_indemnisation",
    "clos_avec_indemnisation_": "Clos_avec_indemnisation",
    "clos_avec_indemnisation.": "Clos_avec_indemnisation",
    "clos_avec_indemnisation__": "Clos_avec_indemnisation",
    "clos_sans_indemnisation": "Clos_sans_indemnisation",
    "clos_sans_indemnisation_": "Clos_sans_indemnisation",
    "ouvert": "Ouvert",
    "en_cours": "En_cours",
    "en_cours_dexpertise": "En_cours_d_expertise",
    "en_cours_expertise": "En_cours_d_expertise",
    "en_cours_d_expertise": "En_cours_d_expertise",
}
STATUS_ACCENT_FROM = "éèêàç"
STATUS_ACCENT_TO = "eeeac"

ACTIVE_STATUSES = ["Ouvert", "En_cours", "En_cours_d_expertise"]
COST_CLOSED_STATUSES = ["Clos_avec_indemnisation", "Clos_sans_indemnisation", "Refusé"]

# ---------------------------------------------------------------------------
# FIXED VALUES — gender and driving behaviour canonicalisation
# ---------------------------------------------------------------------------
GENDER_MAP = {
    "MASCULIN": "M", "HOMME": "M", "MALE": "M", "M": "M",
    "FEMININ": "F", "FÉMININ": "F", "FEMME": "F", "FEMALE": "F", "F": "F",
}
DRIVING_MAP = {
    "Aggressive": "Aggressif", "Agressif": "Aggressif", "Aggressif": "Aggressif",
    "Prudent": "Prudent", "Normal": "Normal",
}
DRIVING_ALLOWED = ["Prudent", "Normal", "Aggressif"]

# ---------------------------------------------------------------------------
# FIXED VALUES — fixed-edge bands (right-closed); edges are upper bounds
# ---------------------------------------------------------------------------
AGE_BANDS = [(24, "<25"), (34, "25-34"), (44, "35-44"), (54, "45-54"), (64, "55-64"), (120, "65+")]
AGE_BAND_LOW = 0  # pd.cut lower edge (exclusive)
CREDIT_BANDS = [(450, "poor"), (600, "fair"), (750, "good"), (None, "excellent")]
TENURE_BANDS = [(180, "<6m"), (365, "6-12m"), (730, "1-2y"), (1095, "2-3y"), (None, "3y+")]
QUINTILE_PROBS = [0.2, 0.4, 0.6, 0.8]
QUINTILE_LABELS = ["very_low", "low", "mid", "high", "very_high"]
SEVERITY_PROBS = [0.5, 0.8, 0.95]
SEVERITY_LABELS = ["low", "medium", "high", "very_high"]
CLIP_LOW, CLIP_HIGH = 0.01, 0.99

# ---------------------------------------------------------------------------
# FIXED VALUES — range bounds used to null out implausible values
# ---------------------------------------------------------------------------
AGE_MIN, AGE_MAX = 16, 100
CREDIT_MIN, CREDIT_MAX = 0, 1000
VEHICLE_MIN_YEAR = 1970
VEHICLE_MAX_KM = 3_000_000
VEHICLE_MAX_VALUE = 50_000_000
VEHICLE_MAX_POWER = 200
VEHICLE_MAX_KM_PER_YEAR = 300_000
VEHICLE_MAX_AGE = 100

# ---------------------------------------------------------------------------
# FIXED VALUES — business constants (TND)
# ---------------------------------------------------------------------------
AGENT_MONTHLY_SALARY = 3000.0
AGENT_MONTHLY_WORKING_HOURS = 160.0
AGENT_HOURLY_RATE = AGENT_MONTHLY_SALARY / AGENT_MONTHLY_WORKING_HOURS  # 18.75
AGENT_MONTHLY_CAPACITY = 80
PRIORITY_CAPACITY_FACTOR = 0.5
DELAY_COST_PER_CLAIM = 1200.0
BASE_INVESTIGATION_HOURS = 1.5
MAX_INVESTIGATION_HOURS = 7.5
PREVENTED_LOSS_RATIO = 0.70
COST_TIER_LOW = 5000.0
COST_TIER_MEDIUM = 15000.0
RECOVERY_RESERVE_RATE = 0.15
DELAY_MEDIUM_FACTOR = 0.6
FRAUD_HIGH_FACTOR = 0.7
FRAUD_MEDIUM_FACTOR = 0.4
DEFAULT_SLA_DAYS = 20.0
EXCESS_DAYS_MIN, EXCESS_DAYS_MAX = 1, 90
DURATION_DAYS_MIN, DURATION_DAYS_MAX = 1, 120
TOP_QUEUE_SIZE = 20
TOP_TIER_SIZE = 15
PAGE_SIZE = 20
AUDIT_TAIL = 200

FRAUD_ACTIONS = {
    "Critical": "Escalate: SIU review within 24h",
    "High": "Priority review within 48h",
    "Medium": "Desk review if capacity allows",
    "Low": "Straight-through processing",
}

# ---------------------------------------------------------------------------
# FIXED VALUES — forecast business rules
# ---------------------------------------------------------------------------
FORECAST_HORIZON = 6
BASELINE_AGENTS = 19
BASELINE_DELAY_RATE = 0.35
BASELINE_FRAUD_RATE = 0.10
VOLUME_ANCHOR_FACTOR = 1.5
VOLUME_SCALE_TARGET = 1.1
VOLUME_SURGE_THRESHOLD = 0.20
DELAY_RATE_WARNING = 0.25
DELAY_RATE_CRITICAL = 0.40
FRAUD_RATE_WARNING = 0.05
BUDGET_OVERSHOOT_PCT = 0.15
FRAUD_RECOVERY_RATE = 0.35
INVESTIGATION_COST_PER_CLAIM = 150.0
EARLY_INTERVENTION_EFFICIENCY = 0.40
AGENT_INTERVENTION_COST = 300.0
HOLDOUT_MONTHS = 3
MIN_MONTHS_REQUIRED = 12
SEASONAL_PERIOD = 12

# month -> multiplier
SEASONAL_VOLUME = {1: 0.85, 2: 0.75, 3: 0.88, 4: 1.05, 5: 1.10, 6: 1.25,
                   7: 1.40, 8: 1.35, 9: 1.20, 10: 1.10, 11: 1.00, 12: 0.90}
SEASONAL_DELAY = {1: 1.00, 2: 0.90, 3: 0.95, 4: 1.05, 5: 1.10, 6: 1.20,
                  7: 1.30, 8: 1.25, 9: 1.15, 10: 1.15, 11: 1.10, 12: 1.05}
SEASONAL_FRAUD = {1: 0.90, 2: 0.85, 3: 0.95, 4: 1.00, 5: 1.05, 6: 1.15,
                  7: 1.25, 8: 1.20, 9: 1.10, 10: 1.05, 11: 1.00, 12: 0.95}
SEASONAL_NOTE = {
    1: "Post-holiday: Moderate activity, stable claims",
    2: "Low season: Quietest month – good for staff training",
    3: "Pre-summer preparation: Activity starts rising",
    4: "Spring traffic surge: Road accidents increase",
    5: "May public holidays: Traffic spike risk",
    6: "Summer begins: Student drivers, vacation travel → surge",
    7: "Peak summer: Maximum vehicle usage – highest risk month",
    8: "Vacation peak: Cross-country travel → high claim risk",
    9: "Back-to-school: New young drivers, accident risk elevated",
    10: "Autumn rains begin: Road condition deterioration",
    11: "Rain season: Accident risk intensifies",
    12: "Year-end: Winter conditions, year-close review",
}
# per-KPI clamp vs trailing-12 mean: kpi -> (low factor, high factor)
FORECAST_CLAMPS = {
    "claim_volume": (0.60, 1.45),
    "total_indemnisation": (0.55, 1.50),
    "avg_claim_amount": (0.60, 1.40),
    "delay_rate": (0.65, 1.50),
    "fraud_rate": (0.65, 1.50),
}
# SARIMA candidates ((p,d,q),(P,D,Q,s)), tried in this order
SARIMA_CANDIDATES = [
    ((1, 1, 1), (1, 1, 1, 12)),
    ((0, 1, 1), (0, 1, 1, 12)),
    ((1, 1, 0), (1, 1, 0, 12)),
    ((2, 1, 2), (1, 0, 1, 12)),
    ((1, 1, 1), (0, 0, 0, 0)),
    ((0, 1, 1), (0, 0, 0, 0)),
    ((0, 1, 0), (0, 0, 0, 0)),
]
# KPI definitions for the monthly series: kpi -> (agg, column)
KPI_DEFINITIONS = [
    ("claim_volume", "count", "claim_id"),
    ("total_indemnisation", "sum", "montant_indemnisation_claim"),
    ("delay_rate", "mean", "is_delayed"),
    ("fraud_rate", "mean", "est_frauduleux_claim"),
    ("avg_claim_amount", "mean", "montant_indemnisation_claim"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — fraud threshold scan and operating points
# ---------------------------------------------------------------------------
FRAUD_MIN_PRECISION = 0.40
FRAUD_MIN_RECALL = 0.30
FRAUD_MAX_INVESTIGATION_RATE = 0.20
FRAUD_BALANCED_MIN_RECALL = 0.70
FRAUD_BALANCED_MIN_PRECISION = 0.20
DELAY_SCAN_RECALL_FLOOR = 0.20

# ---------------------------------------------------------------------------
# FIXED VALUES — id aliases, whitelists and drop lists
# ---------------------------------------------------------------------------
CLAIM_ID_ALIASES = ["claim_id", "claimid", "id_claim", "sinistre_id"]
CONTRACT_ID_ALIASES = ["contract_id", "contractid", "id_contract", "contrat_id"]
CLIENT_ID_ALIASES = ["client_id", "clientid", "id_client", "client"]
VEHICLE_ID_ALIASES = ["vehicle_id", "vehicleid", "id_vehicle", "vehicule_id"]

CLIENT_KEEP = [
    "client_id",
    "nom", "prenom", "genre", "age", "age_group",
    "niveau_professionnel", "revenu_annuel", "income_band",
    "score_credit", "credit_band",
    "gouvernorat", "ville",
    "nb_retards_paiement", "nb_infractions_majeures", "points_permis_retires",
    "participe_conduite_responsable", "entretien_regulier", "vehicule_peu_polluant",
    "engagement_securite_routiere", "changement_frequent_assureur",
    "incidents_paiement_assureur", "historique_dettes", "nombre_enfants",
    "driving_behavior", "num_contracts_target",
    "risque_comportemental", "risque_rse", "risque_financier", "risque_fraude", "risque_global",
    "driving_risk_score", "financial_stress_score", "responsible_behavior_score",
]
CLIENT_TEXT_COLS = ["nom", "prenom", "gouvernorat", "ville", "niveau_professionnel"]
CLIENT_COUNT_COLS = ["nb_retards_paiement", "nb_infractions_majeures", "points_permis_retires",
                     "incidents_paiement_assureur", "historique_dettes", "nombre_enfants",
                     "num_contracts_target"]
CLIENT_RISK_COLS = ["risque_comportemental", "risque_rse", "risque_financier", "risque_fraude", "risque_global"]
CLIENT_BOOL_COLS = ["participe_conduite_responsable", "entretien_regulier", "vehicule_peu_polluant",
                    "engagement_securite_routiere", "changement_frequent_assureur"]
RESPONSIBLE_FLAGS = ["participe_conduite_responsable", "entretien_regulier", "engagement_securite_routiere"]
FIN_STRESS_COLS = ["nb_retards_paiement", "incidents_paiement_assureur", "historique_dettes"]

DIM_CLIENT_COLS = [
    "client_id", "nom", "prenom", "genre", "age", "age_group",
    "niveau_professionnel", "revenu_annuel", "income_band",
    "score_credit", "credit_band", "gouvernorat", "ville",
    "driving_risk_score", "financial_stress_score", "responsible_behavior_score",
    "risque_comportemental", "risque_rse", "risque_financier", "risque_fraude", "risque_global",
]
DIM_POLICY_COLS = [
    "contract_id", "client_id", "date_debut_contrat", "date_fin_contrat", "type_couverture",
    "prime_assurance_annuelle", "nb_sinistres_precedents", "delai_souscription_sinistre_jours",
    "policy_duration_days", "policy_tenure_bucket",
]
DIM_VEHICLE_COLS = [
    "vehicle_id", "contract_id", "type_vehicule", "marque", "modele", "annee_modele", "vehicle_age",
    "puissance_fiscale", "kilometrage_actuel", "mileage_per_year", "valeur_vehicule",
    "vehicle_value_band", "usage_vehicule",
]
FACT_POLICY_COLS = ["contract_id", "client_id", "type_couverture", "prime_assurance_annuelle",
                    "nb_sinistres_precedents", "delai_souscription_sinistre_jours",
                    "policy_duration_days", "policy_tenure_bucket"]
FACT_CLIENT_COLS = ["client_id", "risque_global", "driving_risk_score", "financial_stress_score",
                    "responsible_behavior_score"]
FACT_VEHICLE_COLS = ["vehicle_id", "vehicle_age", "valeur_vehicule", "mileage_per_year",
                     "vehicle_value_band", "usage_vehicule", "type_vehicule"]
FACT_DROP_COLS = ["date_cloture_claim", "close_date_key", "duree_traitement_jours",
                  "duree_traitement_heures", "sla_jours", "is_delayed"]
ML_POLICY_COLS = ["contract_id", "type_couverture", "prime_assurance_annuelle", "nb_sinistres_precedents",
                  "delai_souscription_sinistre_jours", "policy_duration_days", "policy_tenure_bucket",
                  "date_debut_contrat"]
ML_CLIENT_COLS = [
    "client_id", "age", "age_group", "genre", "revenu_annuel", "income_band",
    "score_credit", "credit_band", "nb_retards_paiement", "nb_infractions_majeures", "points_permis_retires",
    "driving_risk_score", "financial_stress_score", "responsible_behavior_score",
    "risque_comportemental", "risque_rse", "risque_financier", "risque_fraude", "risque_global",
    "changement_frequent_assureur", "nombre_enfants",
]
ML_VEHICLE_COLS = ["vehicle_id", "type_vehicule", "marque", "modele", "usage_vehicule", "vehicle_age",
                   "valeur_vehicule", "vehicle_value_band", "kilometrage_actuel", "mileage_per_year",
                   "puissance_fiscale"]
ML_LEAKAGE_COLS = ["date_cloture_claim", "duree_traitement_jours", "duree_traitement_heures",
                   "description_sinistre_claim"]

# non-feature columns per model
DELAY_DROP_COLS = ["claim_id", "client_id", "contract_id", "vehicle_id", "date_sinistre_claim",
                   "est_frauduleux_claim", "claim_severity_bucket", "is_delayed", "duree_traitement_jours"]
FRAUD_DROP_COLS = ["claim_id", "client_id", "contract_id", "vehicle_id", "date_sinistre_claim",
                   "date_cloture_claim", "description_sinistre_claim", "duree_traitement_jours",
                   "duree_traitement_heures", "is_delayed", "claim_severity_bucket", "est_frauduleux_claim"]
COST_DROP_COLS = ["claim_id", "client_id", "contract_id", "vehicle_id", "date_sinistre_claim",
                  "montant_indemnisation_claim", "claim_cost", "claim_gap_amount", "claim_gap_ratio",
                  "claim_severity_bucket", "is_delayed", "est_frauduleux_claim"]
AMOUNT_COLUMNS = ["montant_indemnisation_claim", "montant_estime_dommage_claim"]
# FIXED VALUES — candidate amount columns of the fraud run, first present wins
FRAUD_AMOUNT_COLUMNS = ["montant_indemnisation_claim", "montant_indemnisation", "montant_estime_dommage_claim",
                        "montant_estime", "montant_sinistre"]

# ---------------------------------------------------------------------------
# FIXED VALUES — upload header contracts per raw table (checked
# case-insensitively; extra columns are ignored)
# ---------------------------------------------------------------------------
UPLOAD_CONTRACTS = {
    "Clients": [
        "Client_ID", "Nom", "Prénom", "Genre", "Age", "Niveau_Professionnel",
        "Revenu_Annuel", "Score_Credit", "Gouvernorat", "Ville",
        "Nb_Retards_Paiement", "Nb_Infractions_Majeures", "Points_Permis_Retires",
        "Participe_Conduite_Responsable", "Entretien_Regulier", "Vehicule_Peu_Polluant",
        "Engagement_Securite_Routiere", "Incidents_Paiement_Assureur", "Historique_Dettes",
        "Changement_Frequent_Assureur", "Nombre_Enfants", "Driving_Behavior",
        "Num_Contracts_Target", "Risque_Comportemental", "Risque_RSE",
        "Risque_Financier", "Risque_Fraude", "Risque_Global",
    ],
    "Vehicules": [
        "Vehicle_ID", "Contract_ID", "Type_Vehicule", "Marque", "Modele",
        "Annee_Modele", "Puissance_Fiscale", "Kilometrage_Actuel",
        "Valeur_Vehicule", "Immatriculation", "Usage_Vehicule",
    ],
    "Polices_Assurance": [
        "Contract_ID", "Client_ID", "Date_Debut_Contrat", "Date_Fin_Contrat",
        "Type_Couverture", "Prime_Assurance_Annuelle",
        "Nb_Sinistres_Precedents", "Delai_Souscription_Sinistre_Jours",
    ],
    "Sinistres": [
        "Claim_ID", "Contract_ID", "Client_ID", "Vehicle_ID",
        "Date_Sinistre_Claim", "Type_Sinistre_Claim", "Description_Sinistre_Claim",
        "Montant_Estime_Dommage_Claim", "Montant_Indemnisation_Claim",
        "Est_Frauduleux_Claim", "Statut_Sinistre_Claim",
        "Incoherence_Dommages", "Nature_Sinistre_Consistante",
        "Date_Debut_Contrat", "Date_Fin_Contrat", "Type_Couverture",
        "Date_Cloture_Claim", "Duree_Traitement_Jours",
        "Duree_Traitement_Heures", "SLA_Jours", "Is_Delayed",
    ],
    "addon_sinistres": [
        "Claim_ID", "Contract_ID", "Client_ID", "Vehicle_ID",
        "Date_Sinistre_Claim", "Type_Sinistre_Claim", "Description_Sinistre_Claim",
        "Montant_Estime_Dommage_Claim", "Montant_Indemnisation_Claim",
        "Est_Frauduleux_Claim", "Statut_Sinistre_Claim",
        "Incoherence_Dommages", "Nature_Sinistre_Consistante",
        "Date_Cloture_Claim", "Duree_Traitement_Jours",
        "Duree_Traitement_Heures", "SLA_Jours", "Is_Delayed",
    ],
}

# ---------------------------------------------------------------------------
# FIXED VALUES — forecast alert / recommendation / insight message templates
# (Java format_string syntax; the sentences are the published wording)
# ---------------------------------------------------------------------------
MSG_VOLUME_SURGE = ("Claim surge expected in %s (+%.0f%% vs recent avg). "
                    "Recommend %d additional agent(s) above baseline.")
MSG_DELAY_CRITICAL = ("Critical delay rate forecast: %.0f%% in %s. "
                      "Immediate SLA process review and fast-track queue activation required.")
MSG_DELAY_HIGH = ("High delay rate forecast: %.0f%% in %s. "
                  "Intensify SLA monitoring and assign senior handlers to flagged cases.")
MSG_FRAUD = "Elevated fraud rate forecast: %.1f%% (%.0f cases) in %s. Deploy %d fraud investigator(s)."
MSG_BUDGET = "Indemnisation costs forecast +%.0f%% above recent average in %s. Review reserve allocation."
REC_SAVINGS = "Early intervention this month could prevent up to %dK TND in losses."
REC_DELAYS = "Pre-assign %d high-risk claims to fast-track handlers."
REC_FRAUD = "Flag %d suspected fraud dossiers for proactive investigation."
REC_WORKLOAD = "Agent workload at %.0f%% capacity – consider temporary staffing."
REC_BACKLOG = "Claims activity lower than average – opportunity to accelerate pending backlog."
INS_SURGE = "Volume surges forecast in %s – proactive staffing strongly recommended."
INS_HIGH_RISK = "High-risk periods: %s. Escalate monitoring and resource allocation."
INS_DELAY = "Sustained delay rate of %.0f%% requires structural process optimisation across the horizon."
INS_FRAUD = "Elevated fraud index (%.1f%%) warrants enhanced investigation protocols."
INS_SAVINGS = "Proactive interventions could prevent up to %dK TND in losses over 6 months – ROI positive."
INS_STABLE = ("Operations appear stable over the forecast horizon. Maintain current protocols and leverage "
              "quiet periods for staff training.")

# ---------------------------------------------------------------------------
# FIXED VALUES — login audit messages (Java format_string syntax)
# ---------------------------------------------------------------------------
AUDIT_MAX_LOOKBACK = 10          # most recent failures inspected
AUDIT_ERROR_AT = 3               # consecutive failures that make an ERROR
AUDIT_LOCK_AT = 3                # exactly this run length emits ACCOUNT_LOCKED
MSG_UNKNOWN_LOGIN = "Login attempt with unknown user '%s'"
MSG_BRUTE_FORCE = "User '%s' failed login %d times in a row — possible brute force"
MSG_FAILED_PASSWORD = "Failed password attempt for user '%s'"
MSG_LOCKED = "Account '%s' flagged: %d consecutive failed login attempts. Password reset recommended."
MSG_IP_CHANGE = "User '%s' logged in from new IP %s (previous: %s)"
MSG_LOGIN_OK = "User '%s' logged in successfully"

# ---------------------------------------------------------------------------
# FIXED VALUES — role / permission seed rows
# ---------------------------------------------------------------------------
ROLES = [
    (1, "Manager", "Full access to all features, data upload, and reporting"),
    (2, "Business Analyst", "Read-only access to dashboards and reports"),
    (3, "Admin", "User and account management, platform administration"),
]
PERMISSIONS = [
    (1, "View Dashboard", "Dashboard", "View"),
    (2, "Generate Reports", "Dashboard", "Report"),
    (3, "View Delay Predictions", "DelayPredictions", "View"),
    (4, "Modify Delay Settings", "DelayPredictions", "Modify"),
    (5, "View Cost Predictions", "CostPredictions", "View"),
    (6, "Modify Cost Settings", "CostPredictions", "Modify"),
    (7, "View Fraud Predictions", "FraudPredictions", "View"),
    (8, "Modify Fraud Settings", "FraudPredictions", "Modify"),
    (9, "Investigate Fraud", "FraudPredictions", "Investigate"),
    (10, "View Forecast", "Forecast", "View"),
    (11, "Modify Forecast", "Forecast", "Modify"),
    (12, "Manage Users", "Admin", "ManageUsers"),
    (13, "View Audit Logs", "Admin", "ViewLogs"),
    (14, "Upload Data", "DataUpload", "Upload"),
]
ROLE_PERMISSIONS = [  # (role_permission_id, role_id, permission_id)
    (1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 4), (5, 1, 5), (6, 1, 6), (7, 1, 7), (8, 1, 8),
    (9, 1, 9), (10, 1, 10), (11, 1, 11), (12, 1, 14),
    (13, 2, 1), (14, 2, 2), (15, 2, 3), (16, 2, 5), (17, 2, 7), (18, 2, 10),
    (19, 3, 12), (20, 3, 13),
]
