"""Further registered queries (series / forecast, audit, sources & sinks)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .catalog import Ctx, query
from .functions import dates as D
from .functions import numeric as N
from .operators import forecast as FC
from .operators import series
from .plans import forecast_run
from .session import written

R = N.np_round


# ==========================================================================
# monthly series and forecast
# ==========================================================================

@query("h11_j8_j9_monthly_kpi_series")
def q_series(spark, sf_dir):
    h = forecast_run.monthly_history(Ctx(spark, sf_dir).joined)
    return h.select(D.period_label("period").alias("period"),
                    R(F.col("claim_volume"), 4).alias("claim_volume"),
                    R(F.col("total_indemnisation"), 2).alias("total_indemnisation"),
                    R(F.col("delay_rate"), 6).alias("delay_rate"),
                    R(F.col("fraud_rate"), 6).alias("fraud_rate"),
                    R(F.col("avg_claim_amount"), 2).alias("avg_claim_amount"))


@query("h12_kpi_baselines")
def q_baselines(spark, sf_dir):
    h = forecast_run.monthly_history(Ctx(spark, sf_dir).joined)
    b = series.baselines(series.to_long(h, series.KPI_NAMES))
    return b.select("kpi", R(F.col("mean"), 4).alias("mean"), R(F.col("std"), 4).alias("std"),
                    R(F.col("last_3m_avg"), 4).alias("last_3m_avg"),
                    R(F.col("last_12m_avg"), 4).alias("last_12m_avg"), "n_months",
                    D.period_label("last_period").alias("last_period"))


@query("j10_trailing_volume_means")
def q_trailing(spark, sf_dir):
    h = forecast_run.monthly_history(Ctx(spark, sf_dir).joined)
    h = series.trailing_mean(series.trailing_mean(h, "claim_volume", 3), "claim_volume", 12)
    return h.select(D.period_label("period").alias("period"),
                    R(F.col("claim_volume_trailing_3m"), 4).alias("trailing_3m"),
                    R(F.col("claim_volume_trailing_12m"), 4).alias("trailing_12m"))


@query("k1_k2_k3_adjusted_point_forecasts")
def q_adjusted(spark, sf_dir):
    r = forecast_run.run(Ctx(spark, sf_dir).joined)
    return r.adjusted.select("kpi", D.period_label("period").alias("period"), R(F.col("value"), 6).alias("value"))


@query("k5_k6_k7_forecast_monthly_kpis")
def q_monthly(spark, sf_dir):
    m = forecast_run.run(Ctx(spark, sf_dir).joined).monthly
    return m.drop("period", "alerts", "recommendations")


@query("k8_k9_forecast_alerts")
def q_alerts(spark, sf_dir):
    return FC.explode_alerts(forecast_run.run(Ctx(spark, sf_dir).joined).monthly)


@query("k10_k12_forecast_monthly_flat")
def q_flat(spark, sf_dir):
    m = forecast_run.run(Ctx(spark, sf_dir).joined).monthly
    return FC.flatten_month(m).drop("period")


@query("h13_k11_forecast_summary")
def q_fsummary(spark, sf_dir):
    return FC.portfolio_summary(forecast_run.run(Ctx(spark, sf_dir).joined).monthly)


# ==========================================================================
# login audit
# ==========================================================================

from .operators import audit as AU  # noqa: E402
from .sources import bindings as BND  # noqa: E402
from .sources.tables import Tables as _T  # noqa: E402


def _audit_inputs(spark, sf_dir):
    t = _T(spark, sf_dir)
    return BND.audit_events(t), BND.users(t)


def _scan(spark, sf_dir):
    ev, us = _audit_inputs(spark, sf_dir)
    res = AU.resolve_users(ev, us)
    return AU.segmented_login_scan(res.where(F.col("known_user_id").isNotNull()))


def _log(spark, sf_dir):
    ev, us = _audit_inputs(spark, sf_dir)
    return AU.audit_log(ev, us)


@query("j12_g12_consecutive_failures")
def q_consec(spark, sf_dir):
    f = AU.consecutive_failures(_scan(spark, sf_dir))
    return f.select("event_id", F.col("known_user_id").alias("user_id"), "login_attempted", "created_at",
                    "consecutive_failures", "severity", "message", F.col("prev_success_at").alias("last_success_at"))


@query("j13_lockout_alerts")
def q_lock(spark, sf_dir):
    return AU.lockouts(AU.consecutive_failures(_scan(spark, sf_dir)))


@query("j14_ip_changes")
def q_ipc(spark, sf_dir):
    return AU.ip_changes(_scan(spark, sf_dir))


@query("j15_unknown_logins")
def q_unknown(spark, sf_dir):
    ev, us = _audit_inputs(spark, sf_dir)
    return AU.unknown_logins(AU.resolve_users(ev, us))


@query("j12_audit_log_replay")
def q_log(spark, sf_dir):
    return _log(spark, sf_dir)


@query("h18_audit_counters")
def q_audit_counters(spark, sf_dir):
    return AU.audit_counters(_log(spark, sf_dir))


@query("b12_j7_audit_filter_tail")
def q_audit_tail(spark, sf_dir):
    return AU.log_tail(AU.filter_log(_log(spark, sf_dir), "ERROR", "LOGIN_FAILED")).select(
        "event_id", "seq", "created_at", "user_id", "severity", "message", "consecutive_failures")


@query("j16_resolve_locked_accounts")
def q_resolve(spark, sf_dir):
    """Every locked account is reset at its first lock: all of that user's
    unresolved LOGIN_FAILED / ACCOUNT_LOCKED rows are resolved.  The whole log after it."""
    log = _log(spark, sf_dir)
    locked = log.where(F.col("event_type") == "ACCOUNT_LOCKED").groupBy("user_id").agg(
        F.min("created_at").alias("resolved_at")).withColumn("resolved_by", F.lit("admin"))
    return AU.resolve_alerts(log, locked).select("event_id", "seq", "user_id", "event_type", "severity", "is_resolved", "resolved_by", "resolved_at")


@query("g9_audit_log_with_user_role")
def q_log_user(spark, sf_dir):
    ev, us = _audit_inputs(spark, sf_dir)
    log = AU.audit_log(ev, us)
    u = AU.user_permissions(us).select(F.col("user_id").alias("_uid"), "login", "role_name")
    return log.join(u, log.user_id == u._uid, "left").drop("_uid").select(
        "event_id", "seq", "event_type", "severity", "user_id", "login", "role_name")


@query("g10_user_permissions")
def q_perms(spark, sf_dir):
    _, us = _audit_inputs(spark, sf_dir)
    return AU.user_permissions(us)


@query("g11_login_conflicts")
def q_conflicts(spark, sf_dir):
    return AU.key_conflicts(BND.accounts(_T(spark, sf_dir)), ["login", "email", "username"])


@query("h19_user_counters")
def q_user_counts(spark, sf_dir):
    _, us = _audit_inputs(spark, sf_dir)
    return AU.user_counters(us)


# ==========================================================================
# sources and sinks
# ==========================================================================

from . import contracts as _K  # noqa: E402
from .functions import text as _TX  # noqa: E402
from .operators import align as _AL  # noqa: E402
from .plans import documents as DOC  # noqa: E402
from .plans import layers as _L  # noqa: E402
from .plans import runs as _RUNS  # noqa: E402
from .plans import warehouse as _W  # noqa: E402
from .sources import sinks as SK  # noqa: E402
from .session import scratch_path as _scratch, wide_rows as _wide  # noqa: E402
from .sources import upload as UP  # noqa: E402
from .sources.batches import BatchTable  # noqa: E402

UPLOAD_HEADERS = _K.UPLOAD_CONTRACTS["Clients"] + ["dup"]


def _upload_lines(spark, sf_dir):
    raw = BND.clients_raw(_T(spark, sf_dir))
    cols = []
    for h in UPLOAD_HEADERS:
        s = _TX.to_snake_case(h)
        cols.append((F.col(s).cast("string") if s in raw.columns else F.lit("")).alias(h))
    return UP.render_upload_lines(raw.select(*cols), UPLOAD_HEADERS)


def clients_upload_file(spark, sf_dir) -> str:
    """The raw clients as an upload file (contract headers, mixed delimiters,
    quoting; parts written by all tasks, the header in the first), once per
    input fingerprint; returns its folder."""
    m = _L.Materializer(spark, _L.layer_root(spark, sf_dir))
    path = m.path("upload_clients_csv")
    if not m._exists(path):
        _upload_lines(spark, sf_dir).write.mode("overwrite").text(path)
    return path


@query("a3_a4_a5_a6_a7_upload_roundtrip")
def q_upload(spark, sf_dir):
    res = UP.parse_upload(spark, clients_upload_file(spark, sf_dir), _K.UPLOAD_CONTRACTS["Clients"])
    if not res.ok:
        raise ValueError(res.error)
    return res.data.drop("line_no")


def _batch_loads(spark, sf_dir):
    """Clean-keyed clients loaded in three batches, with a batch that repeats keys and
    a repeated batch between them: (step, outcome) pairs and the table."""
    raw = BND.clients_raw(_T(spark, sf_dir)).withColumn("client_id", _TX.normalize_id("client_id"))
    number = F.regexp_extract("client_id", r"(\d+)$", 1).cast("long")
    part = lambda k: raw.where((F.col("dup") == 0) & (number % 3 == k))
    table = BatchTable(spark, _scratch(spark, "batch-loads"), raw.schema, pk=["client_id"])
    steps = [("first", part(0), "b0"), ("second", part(1), "b1"), ("keys repeat", part(2).unionByName(raw.where("dup = 1")), "b2"),
             ("again", part(0), "b0"), ("keys in the table", part(1), "b3"), ("third", part(2), None), ("third again", part(2), None)]
    return [(n, table.load(df, batch_id=b)) for n, df, b in steps], table


@query("a8_a9_batch_load_outcomes")
def q_loads(spark, sf_dir):
    """What became of each load: the table gains a batch whole, or nothing."""
    done, _ = _batch_loads(spark, sf_dir)
    return spark.createDataFrame([(i, n, r.status, r.rows) for i, (n, r) in enumerate(done, 1)], "step int, load string, status string, n long")


@query("a8_a9_batch_loaded_table")
def q_loaded(spark, sf_dir):
    """The table after those loads, row by row."""
    return _batch_loads(spark, sf_dir)[1].read().withColumn("batch_id", F.when(F.col("batch_id").isin("b0", "b1"), F.col("batch_id")).otherwise("by content"))


@query("a9_upload_into_table")
def q_upload_load(spark, sf_dir):
    """An upload file, a broken copy of it and the file again into one table: (file, status, n, reason)."""
    good, broken = clients_upload_file(spark, sf_dir), f"{_scratch(spark, 'upload-broken')}/file"
    _upload_lines(spark, sf_dir).unionByName(spark.createDataFrame([("one;field;too;few",)], "value string")).write.text(broken)
    names = _K.UPLOAD_CONTRACTS["Clients"]
    table = BatchTable(spark, _scratch(spark, "upload-table"), StructType([StructField(n, StringType()) for n in names]))
    rows = []
    for label, path in (("broken", broken), ("whole", good), ("whole again", good)):
        r = UP.load_upload(spark, path, names, table)
        rows.append((label, r.status, r.rows, re.sub(r"^Row \d+", "Row", r.reason) if r.reason else None))
    held = table.read().count()
    return spark.createDataFrame([(*r, held) for r in rows], "file string, status string, n long, reason string, rows_in_table long")


REJECT_RULES = {
    "negative_duration": lambda: F.col("date_cloture_claim").isNotNull() & F.col("duree_traitement_heures").isNull(),
    "missing_sla": lambda: F.col("sla_jours").isNull(),
    "non_canonical_status": lambda: ~F.col("statut_sinistre_claim").isin(
        "Refusé", "Clos", "Clos_avec_indemnisation", "Clos_sans_indemnisation", *_K.ACTIVE_STATUSES),
}


@query("a10_reject_row_isolation")
def q_rejects(spark, sf_dir):
    """Claims ingested with their bad rows set aside: every row, its outcome and the first rule that it broke."""
    c = Ctx(spark, sf_dir).cl.claims.select("claim_id", "statut_sinistre_claim", "sla_jours", "date_cloture_claim", "duree_traitement_heures")
    table = BatchTable(spark, _scratch(spark, "reject-rows"), c.schema, pk=["claim_id"])
    done = table.load(c, rules={n: r() for n, r in REJECT_RULES.items()}, reject="rows")
    if done.status != "loaded":
        raise ValueError(done.reason)
    return table.read().drop("batch_id").withColumns({"outcome": F.lit("loaded"), "reject_reason": F.lit(None).cast("string")}) \
                .unionByName(table.quarantine().withColumn("outcome", F.lit("quarantined")))


@query("a12_schema_profile")
def q_profile(spark, sf_dir):
    return SK.schema_profile(Ctx(spark, sf_dir).cl.claims)


@query("a14_pk_violations_raw_claims")
def q_pk(spark, sf_dir):
    r = BND.claims_raw(_T(spark, sf_dir)).withColumn("claim_id", _TX.normalize_id("claim_id"))
    return SK.pk_violations(r, ["claim_id"])


@query("a16_dry_run_preview")
def q_preview(spark, sf_dir):
    return SK.preview(BND.clients_raw(_T(spark, sf_dir)), ["client_id", "dup"])


# the documents are written, read back by their schema and taken apart again

def _document(spark, doc, name):
    path = f"{_scratch(spark, name)}/document"
    DOC.write_document(doc, path)
    return DOC.read_document(spark, path, doc.schema)


@query("a18_delay_document")
def q_doc_delay(spark, sf_dir):
    """One row per claim listed in the delay document, with the summary and the tier counts beside it."""
    d = _document(spark, DOC.delay_document(_RUNS.delay_predictions(Ctx(spark, sf_dir).scored)), "doc-delay")
    tiers = [F.coalesce(F.col("risk_distribution")[t], F.lit(0)).alias(f"n_{t.lower()}") for t in ("High", "Medium", "Low")]
    return d.select("run_timestamp", "model_name", "decision_threshold", "currency", "summary.*", *tiers, F.posexplode("top_high_risk_claims").alias("pos", "c")) \
            .select("*", *[F.col(f"c.{f}").alias(f) for f in DOC.DELAY_TOP]).drop("c")


@query("a18_fraud_document")
def q_doc_fraud(spark, sf_dir):
    d = _document(spark, DOC.fraud_document(_RUNS.fraud_predictions(Ctx(spark, sf_dir).scored)), "doc-fraud")
    s = d.select("summary.*", F.posexplode("top_suspicious_claims").alias("pos", "c"))
    return s.select(*[c for c in s.columns if c not in ("c", "risk_distribution", "assumptions")], F.col("assumptions.amount_column").alias("amount_column"),
                    F.size("risk_distribution").alias("n_tiers"), *[F.col(f"c.{f}").alias(f) for f in DOC.FRAUD_TOP])


@query("a18_forecast_document")
def q_doc_forecast(spark, sf_dir):
    """One row per month and alert of the nested details (months without one keep a row)."""
    d = _document(spark, DOC.forecast_document(forecast_run.run(Ctx(spark, sf_dir).joined).monthly), "doc-forecast")
    m = d.select("currency", F.col("summary.total_alerts").alias("total_alerts"), F.size("flat_table").alias("n_flat"),
                 F.posexplode("monthly_details").alias("pos", "m"))
    return m.select("currency", "total_alerts", "n_flat", "pos", "m.period", "m.month", "m.seasonal_context", "m.risk_level", "m.is_surge_month",
                    "m.forecast.*", "m.business_kpis.*", F.array_join("m.recommendations", " | ").alias("recommendations"),
                    F.explode_outer("m.alerts").alias("a")) \
            .select("*", F.col("a.level").alias("alert_level"), F.col("a.type").alias("alert_type"), F.col("a.message").alias("alert_message")).drop("a")


@query("a19_table_stats")
def q_stats(spark, sf_dir):
    return SK.table_stats(Ctx(spark, sf_dir).features(), "statut_sinistre_claim", _K.ACTIVE_STATUSES)


@query("a20_delete_by_pattern")
def q_delete(spark, sf_dir):
    """The claims that stay when the batch of ids like CLM-1… is deleted, all columns."""
    return SK.delete_by_pattern(Ctx(spark, sf_dir).cl.claims, "claim_id", "CLM-1%")


@query("b3_validate_and_cast")
def q_validate(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    return _AL.validate_and_cast(BND.policies_raw(ctx.t), ctx.cl.policies.schema)


@query("g14_distinct_run_ids")
def q_runs(spark, sf_dir):
    rec = _RUNS.delay_records(_RUNS.delay_predictions(Ctx(spark, sf_dir).scored))
    return SK.distinct_runs(rec)


@query("h17_table_fingerprints")
def q_fp(spark, sf_dir):
    t = _T(spark, sf_dir)
    return _L.table_prints({n: f(t) for n, f in _L.RAW.items()})


def planted_changes(raw: dict) -> dict:
    """One change a table, none of which moves the row count and a plain XOR alike: a value
    replaced, a row repeated, a row lost, a value moved next to a null.  Each
    hits the rows with the smallest id."""
    first = lambda df, key: df.join(F.broadcast(df.agg(F.min(key).alias("_first"))), F.col(key) == F.col("_first"), "left")
    hit = F.col("_first").isNotNull()
    cli, pol, veh, cla = (raw[n] for n in ("clients_raw", "policies_raw", "vehicles_raw", "claims_raw"))
    moved = first(cla, "claim_id").withColumns({"statut_sinistre_claim": F.when(hit, F.col("type_sinistre_claim")).otherwise(F.col("statut_sinistre_claim")),
                                                "type_sinistre_claim": F.when(~hit | hit.isNull(), F.col("type_sinistre_claim"))})
    return {"clients_raw": first(cli, "client_id").withColumn("nom", F.when(hit, F.lit("planted")).otherwise(F.col("nom"))).drop("_first"),
            "policies_raw": pol.unionByName(first(pol, "contract_id").where(hit).drop("_first")),
            "vehicles_raw": first(veh, "vehicle_id").where(~hit).drop("_first"),
            "claims_raw": moved.drop("_first")}


@query("g15_s2_changed_tables")
def q_changed(spark, sf_dir):
    """For a planted change in each raw table: the tables that the diff of the fingerprints
    reports, and the layers whose key changes, which a refresh (S2) rebuilds."""
    t = _T(spark, sf_dir)
    raw = {n: f(t) for n, f in _L.RAW.items()}
    prints = {r["table_name"]: r["fingerprint"] for r in _L.table_prints(raw).collect()}
    planted = {r["table_name"]: r["fingerprint"] for r in _L.table_prints(planted_changes(raw)).collect()}
    saved, rows = _L.layer_keys(prints), []
    for n in raw:
        now = _L.layer_keys(prints | {n: planted[n]})
        rows += [(n, name, "table" if name in raw else "layer", key != saved[name]) for name, key in now.items()]
    return spark.createDataFrame(rows, "planted string, name string, kind string, changed boolean")


# ==========================================================================
# streaming (S1, S3–S5): run to completion (availableNow), read the sink
# ==========================================================================

from .streaming import jobs as ST  # noqa: E402


ARRIVALS = 5                     # landings of a replay
SPAN_DAYS = 480                  # event time that one of them covers


def claim_arrivals(t) -> list:
    """The line items in five landings by the order's date: every 7th part comes one
    landing late, every 11th comes again with the next."""
    o = t.orders.select("o_orderkey", "o_orderdate")
    place = F.least(F.lit(ARRIVALS - 1), F.floor(F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")) / SPAN_DAYS))
    moved = F.col("l_partkey") % 7 == 0
    first = F.least(F.lit(ARRIVALS - 1), place + moved.cast("int"))
    again = F.when((F.col("l_partkey") % 11 == 0) & (first < ARRIVALS - 1), F.array(first, first + 1)).otherwise(F.array(first))
    rows = t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("_at", F.explode(again))
    rows = written(rows.select(*t.lineitem.columns, "_at"), "claim-arrivals", codec="zstd")      # one join for all landings
    return [rows.where(F.col("_at") == k).select(*t.lineitem.columns) for k in range(ARRIVALS)]


def _replayed(spark, sf_dir, *sinks: str) -> str:
    """The wanted sinks of the claim streams after a replay of the five landings, the ingest
    and the jobs of those sinks after each (once per input)."""
    root = f"{_L.layer_root(spark, sf_dir)}/stream_claims-{'-'.join(sinks)}"
    m = _L.Materializer(spark, root)
    if not m._exists(m.path("done")):
        t, place = _T(spark, sf_dir), f"{root}/{uuid.uuid4().hex[:12]}"
        at = lambda n: f"{place}/{n}"
        jobs = {"stg": lambda: ST.ingest_claims(spark, at("landing"), t.orders, at("stg"), at("ck_stg"), BND.claims_raw_from),
                "ids": lambda: ST.dedup_claims(spark, at("stg"), at("ids"), at("ck_ids")),
                "rows": lambda: ST.dedup_claims(spark, at("stg"), at("rows"), at("ck_rows"), whole_rows=True, keep=ST.KPI_COLUMNS),
                "days": lambda: ST.daily_claim_kpis(spark, at("rows"), at("days"), at("ck_days"))}
        ST.replay(claim_arrivals(t), at("landing"), [job for sink, job in jobs.items() if sink in sinks])
        m(spark.createDataFrame([(place,)], "place string"), "done")
    return spark.read.parquet(m.path("done")).first()["place"]


@query("s1_streaming_claim_ingest")
def q_s1(spark, sf_dir):
    """All landed rows, cleaned, with their batch and whether they came late."""
    return spark.read.parquet(f"{_replayed(spark, sf_dir, 'stg')}/stg")


@query("s5_streaming_dedup_claim_ids")
def q_s5(spark, sf_dir):
    return spark.read.parquet(f"{_replayed(spark, sf_dir, 'stg', 'ids')}/ids").select("claim_id")


@query("s4_streaming_daily_claim_kpis")
def q_s4(spark, sf_dir):
    latest = ST.latest_per_key(spark.read.parquet(f"{_replayed(spark, sf_dir, 'stg', 'rows', 'days')}/days"), ["window_start"])
    return latest.select(F.date_format(F.col("window_start").cast("timestamp_ntz"), "yyyy-MM-dd").alias("day"),
                         "claims", R(F.col("payout"), 2).alias("payout"), "delayed")


@query("s3_streaming_login_monitor")
def q_s3(spark, sf_dir):
    """The events in six landings by day, monitored batch by batch."""
    place, t = _scratch(spark, "stream-logins"), _T(spark, sf_dir)
    day = F.floor((F.dayofmonth("ts") - 1) / 6)
    users = BND.users(t)
    sink, landing = f"{place}/sink", f"{place}/landing"

    def monitor():
        ev = BND.audit_events_from(ST.file_stream(spark, landing, "*.parquet"))
        ST.login_monitor(AU.resolve_users(ev, users), sink, f"{place}/checkpoint")

    ST.replay([t.events.where(day == k) for k in range(6)], landing, [monitor])
    return spark.read.parquet(sink).select("event_id", "user_id", "event_type", "ip_address", "consecutive_failures",
                                           F.col("previous_ip").alias("previous_success_ip"))


# ==========================================================================
# model evaluation on scored claims
# ==========================================================================

from .operators import evaluation as EV  # noqa: E402


def _r4(df):
    return EV.round_cols(df, 4)


@query("m10_m11_fraud_threshold_scan")
def q_fscan(spark, sf_dir):
    s = EV.fraud_business_scan(Ctx(spark, sf_dir).scored)
    return _r4(s.drop("flagged_p", "avg_fraud_amount"))


@query("m12_fraud_operating_points")
def q_ops(spark, sf_dir):
    return _r4(EV.operating_points(EV.fraud_business_scan(Ctx(spark, sf_dir).scored)))


@query("m13_delay_quality_threshold")
def q_dq(spark, sf_dir):
    scan = EV.confusion_scan(Ctx(spark, sf_dir).scored, "is_delayed", "delay_probability", EV.DELAY_THRESHOLDS)
    return EV.round_cols(EV.quality_threshold(scan), 6)


@query("m14_fraud_roc_pr_auc")
def q_auc(spark, sf_dir):
    return EV.round_cols(EV.roc_pr_auc(Ctx(spark, sf_dir).scored, "est_frauduleux_claim", "fraud_probability"), 6)


@query("m15_cost_regression_metrics")
def q_reg(spark, sf_dir):
    from .operators.scoring import cost_target_claims
    d = cost_target_claims(Ctx(spark, sf_dir).joined)
    return _r4(EV.regression_metrics(d, "montant_indemnisation_claim", "montant_estime_dommage_claim"))


@query("m16_forecast_holdout_metrics")
def q_fmetrics(spark, sf_dir):
    """3-month hold-out of each KPI series scored against the seasonal-naive
    forecast (value of the same month one year earlier)."""
    from pyspark.sql import Window
    long = series.to_long(forecast_run.monthly_history(Ctx(spark, sf_dir).joined), series.KPI_NAMES)
    rn = F.row_number().over(Window.partitionBy("kpi").orderBy(F.col("period").desc()))
    hold = long.withColumn("_rn", rn).where(F.col("_rn") <= 3).select("kpi", "period", F.col("value").alias("actual"))
    lag = long.select("kpi", F.add_months("period", 12).alias("period"), F.col("value").alias("forecast"))
    pairs = hold.join(lag, ["kpi", "period"]).where(F.col("actual").isNotNull() & F.col("forecast").isNotNull())
    return _r4(EV.forecast_metrics(pairs))


@query("h15_h16_fraud_label_profile")
def q_lprof(spark, sf_dir):
    return EV.label_profile(Ctx(spark, sf_dir).joined, "est_frauduleux_claim", "montant_indemnisation_claim")


# ==========================================================================
# Spark ML training / scoring (M1–M9, M17–M19, M22, M23) — rows-only checks
# ==========================================================================

from .models import training as TR  # noqa: E402
from .operators.scoring import active_claims as _active, closed_claims as _closed  # noqa: E402
from .operators.scoring import cost_target_claims as _cost_target  # noqa: E402

_TRAINED: dict = {}


def trained(spark, sf_dir, kind: str):
    """Train once per input fingerprint; the winner is persisted (M23) and
    the comparison table written next to it."""
    root = _L.layer_root(spark, sf_dir)
    key = (spark.sparkContext.applicationId, root, kind)
    if key in _TRAINED:
        return _TRAINED[key]
    c = Ctx(spark, sf_dir)
    if kind == "delay":
        tr = TR.train_classifier(c.features(_closed(c.cl.claims)), "is_delayed", "claim_id", TR.DELAY_DROP, "auc")
    elif kind == "fraud":
        tr = TR.train_classifier(c.features(), "est_frauduleux_claim", "claim_id", TR.FRAUD_DROP, "fraud", scale=True,
                                 cap=TR.CATEGORY_CAP)
    else:
        tr = TR.train_regressor(c.features(_cost_target(c.cl.claims)), "claim_id", TR.COST_DROP)
    path = f"{root}/models/{kind}"
    picked = {} if kind == "cost" else TR.picked_threshold(
        tr, "is_delayed" if kind == "delay" else "est_frauduleux_claim",
        amount="montant_indemnisation_claim" if kind == "fraud" else None)
    TR.save_model(tr, path, {"kind": kind} | picked)
    tr.comparison.write.mode("overwrite").parquet(f"{path}/comparison")
    _TRAINED[key] = (tr, path)
    return _TRAINED[key]


@query("m2_m3_fill_values")
def q_fill(spark, sf_dir):
    """What the fraud model's training rows fill and keep: each numeric feature's median, each
    categorical feature's kept values by rank."""
    c, label = Ctx(spark, sf_dir), "est_frauduleux_claim"
    d = c.features().where(F.col(label).isNotNull())
    num, cat = TR.feature_columns(d, TR.FRAUD_DROP, label)
    own = _W.unjoined(c.layers(*_L.CLEAN).clean, num + cat)
    train, _ = TR.train_test(d.select(*dict.fromkeys(["claim_id", label, "contract_id", "client_id", "vehicle_id", *own])), "claim_id", label)
    # the dimensions' features are counted at the dimensions' rows, so that no wide rows are joined
    cl, rows = c.layers(*_L.CLEAN).clean, []
    for part, cols in _W.ml_parts(cl, train, num + cat, c.ratio_bounds, lambda df: written(df, "fill-part", codec="zstd")):
        rows += [(f, "median", 1, None, v) for f, v in TR.medians(part, [x for x in num if x in cols], "_rows").items()]
        rows += [(f, "kept", i, v, None) for f, values in TR.cap_categories(part, [x for x in cat if x in cols], TR.CATEGORY_CAP, "_rows").items() for i, v in enumerate(values, 1)]
    return spark.createDataFrame(rows, "feature string, kind string, rank int, value string, median double")


@query("m5_stratified_split")
def q_split(spark, sf_dir):
    """The delay model's split: which closed claim trains and which tests."""
    d = _closed(Ctx(spark, sf_dir).joined).where(F.col("is_delayed").isNotNull())
    return TR.stratified_split(d.select("claim_id", "is_delayed"), "claim_id", "is_delayed")


@query("g7_duration_labels")
def q_duration(spark, sf_dir):
    """The duration model's table: features with the excess delay of the clean claims."""
    c = Ctx(spark, sf_dir)
    return TR.duration_labels(c.features, c.cl.claims)


@query("m9_duration_folds")
def q_folds(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return TR.with_folds(TR.duration_labels(c.features, c.cl.claims), "claim_id", TR.DURATION_FOLDS).select("claim_id", "excess_delay_days", "fold")


@query("m9_duration_search_scores")
def q_duration_search(spark, sf_dir):
    """Every sampled parameter set and fold with its error; no rows below the least number of labels."""
    c = Ctx(spark, sf_dir)
    found = TR.tune_duration_regressor(TR.duration_labels(c.features, c.cl.claims), "claim_id", TR.DELAY_DROP)
    return found.scores if found else spark.createDataFrame([], "draw int, max_depth int, max_iter int, fold int, n long, rmse double")


@query("m1_m6_m22_delay_model_comparison")
def q_m_delay(spark, sf_dir):
    tr, path = trained(spark, sf_dir, "delay")
    return spark.read.parquet(f"{path}/comparison")


@query("m7_fraud_model_comparison")
def q_m_fraud(spark, sf_dir):
    tr, path = trained(spark, sf_dir, "fraud")
    return spark.read.parquet(f"{path}/comparison")


@query("m8_cost_model_comparison")
def q_m_cost(spark, sf_dir):
    tr, path = trained(spark, sf_dir, "cost")
    return spark.read.parquet(f"{path}/comparison")


@query("m17_fraud_feature_importances")
def q_m_imp(spark, sf_dir):
    tr, _ = trained(spark, sf_dir, "fraud")
    return TR.feature_importances(tr)


@query("m18_m19_m23_fraud_scoring_active_claims")
def q_m_score(spark, sf_dir):
    """Reload the persisted model (M23), resolve its threshold from the
    metadata (M19) and score the active claims (M18) into fraud tiers."""
    from .operators import scoring as SC
    tr, path = trained(spark, sf_dir, "fraud")
    model, _meta = TR.load_model(spark, path)
    thr = TR.resolve_threshold(spark.read.text(f"{path}/metadata").withColumnRenamed("value", "metadata"),
                               _RUNS.FRAUD_THRESHOLD).first()[0]
    c = Ctx(spark, sf_dir)
    act = TR.apply_caps(c.features(_active(c.cl.claims)), tr.caps)
    with _wide(spark):
        scored = written(TR.score(model, act, "fraud_probability").select("claim_id", "fraud_probability"), "active-scores", codec="zstd")
    tiers = SC.fraud_tiers(scored, thr)
    return tiers.select("claim_id", "fraud_probability", "predicted_fraud", "risk_level", "recommended_action")


# ==========================================================================
# grouped time-series fits (M20, M21) — rows-only checks
# ==========================================================================

from .models import timeseries as TS  # noqa: E402


@query("m20_m21_series_model_selection")
def q_ts_select(spark, sf_dir):
    long = series.to_long(forecast_run.monthly_history(Ctx(spark, sf_dir).joined), series.KPI_NAMES)
    return TS.select_models(TS.fit_candidates(long))


@query("m20_k5_forecast_with_fitted_models")
def q_ts_forecast(spark, sf_dir):
    run = forecast_run.run(Ctx(spark, sf_dir).joined, forecaster=TS.arima_forecaster)
    return run.monthly.drop("period", "alerts", "recommendations")


# ==========================================================================
# remaining sinks / reads: A2 + A17, G8, H20, J17
# ==========================================================================

@query("a2_a17_csv_sink_and_scan")
def q_csv(spark, sf_dir):
    """Clean policies written with the CSV sink, read back with a typed scan."""
    pol = Ctx(spark, sf_dir).cl.policies
    m = _L.Materializer(spark, _L.layer_root(spark, sf_dir))
    path = m.path("csv_policies")
    if not m._exists(path):
        SK.write_csv(pol, path)
    return SK.read_csv(spark, path, pol.schema)


@query("g8_run_join_records_summary")
def q_run_join(spark, sf_dir):
    """Prediction records joined to their run summary on the run id."""
    from .operators import scoring as SC
    pred = _RUNS.delay_predictions(Ctx(spark, sf_dir).scored)
    rec = _RUNS.delay_records(pred)
    summ = SC.delay_run_summary(pred, _RUNS.DELAY_THRESHOLD, "montant_indemnisation_claim") \
        .withColumn("prediction_run_id", F.lit(_RUNS.run_id("RUN")))
    j = rec.join(F.broadcast(summ.select("prediction_run_id", "total_active_claims", "recommended_agents")),
                 "prediction_run_id")
    return j.groupBy("prediction_run_id", "risk_level", "total_active_claims", "recommended_agents") \
            .agg(F.count(F.lit(1)).alias("n"))


@query("h20_forecast_alert_counters")
def q_alert_counts(spark, sf_dir):
    a = FC.explode_alerts(forecast_run.run(Ctx(spark, sf_dir).joined).monthly)
    lvl = F.upper(F.col("alert_level"))
    return a.agg(F.count(F.lit(1)).alias("total_alerts"),
                 *[F.count_if(lvl == v).alias(f"{v.lower()}_alerts") for v in ("CRITICAL", "HIGH", "MEDIUM", "LOW")])


@query("j17_chart_arrays")
def q_chart(spark, sf_dir):
    """Ordered chart series (period / claim volume / payout) as text arrays."""
    h = forecast_run.monthly_history(Ctx(spark, sf_dir).joined)
    s = h.agg(F.array_sort(F.collect_list(F.struct("period", "claim_volume", "total_indemnisation"))).alias("a"))
    return s.select(
        F.array_join(F.transform("a", lambda x: F.date_format(x["period"], "yyyy-MM")), ",").alias("periods"),
        F.array_join(F.transform("a", lambda x: F.rint(x["claim_volume"]).cast("long").cast("string")), ",").alias("volumes"),
        F.array_join(F.transform("a", lambda x: F.rint(x["total_indemnisation"]).cast("long").cast("string")), ",").alias("costs"))
