"""Login-audit analytics (G9–G12, H18–H19, J7, J12–J16, B12): replaying an
event log of login attempts into the audit log the login controller writes.

Per-user sequential state (failures since the last success, the previous
success IP, the last success time) is computed with a two-level segmented
scan, so one very active user is never a single task:

1. the attempts are range-partitioned by (user, time, id); a range is a segment,
   so segments hold about equally many rows and a hot user, or a bot's single
   hour, spans as many of them as its rows fill.  Windows run inside (user, segment)
   only, and their result is written once;
2. each (user, segment) is summarised to one row (failures, trailing failures
   after its last success, last success IP / time); a window over the user's
   summaries — at most one a segment — yields each segment's carry-in;
3. the carry is joined back on (user, segment) and combined with the local
   running values.

State from before (a stream's earlier batches) comes in as one more summary row
per user, ahead of the first segment, and goes out the same way.

The result equals a per-user window over the whole history (checked against
a plain SQL window in the oracle) for any segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import contracts as K
from ..session import written

ORDER = ["created_at", "event_id"]


def resolve_users(events: DataFrame, users: DataFrame) -> DataFrame:
    """Match each attempt to an *active* user by login (J15 splits off the
    rest).  ``known_user_id`` is null for unknown / inactive logins."""
    act = users.where(F.col("is_active")).select(F.col("login").alias("_login"),
                                                 F.col("user_id").alias("known_user_id"))
    return events.join(act, events.login_attempted == act._login, "left").drop("_login")


LOGIN_STATE = ("known_user_id long, fails long, last_ip string, last_success_at timestamp_ntz, has_success boolean, "
               "last_seen timestamp_ntz")


def _segments(events: DataFrame) -> DataFrame:
    """The attempts with their running values inside (user, segment), written once."""
    u = "known_user_id"
    succ = F.col("event_type") == "LOGIN_SUCCESS"
    ev = events.repartitionByRange(u, *ORDER).withColumns({
        "_seg": F.spark_partition_id(), "_s": succ.cast("int"), "_f": (F.col("event_type") == "LOGIN_FAILED").cast("int")})
    wl = Window.partitionBy(u, "_seg").orderBy(*ORDER)
    before = wl.rowsBetween(Window.unboundedPreceding, -1)
    upto = wl.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ev = ev.withColumns({"_fcum": F.sum("_f").over(upto), "_sbefore": F.coalesce(F.sum("_s").over(before), F.lit(0))})
    ev = ev.withColumns({
        "_f_at_last_s": F.last(F.when(succ, F.col("_fcum")), ignorenulls=True).over(before),
        "_ip_local": F.last(F.when(succ, F.col("ip_address")), ignorenulls=True).over(before),
        "_ts_local": F.last(F.when(succ, F.col("created_at")), ignorenulls=True).over(before),
    })
    return written(ev, "login-segments")


def _summaries(ev: DataFrame, state: DataFrame | None) -> DataFrame:
    """One row per (known user, segment), the state's as segment -1."""
    succ = F.col("_s") == 1
    summ = ev.where(F.col("known_user_id").isNotNull()).groupBy("known_user_id", "_seg").agg(
        F.sum("_f").alias("_nf"),
        F.max("_s").alias("_hs"),
        (F.sum("_f") - F.coalesce(F.max(F.when(succ, F.col("_fcum"))), F.lit(0))).alias("_trail"),
        F.max_by(F.when(succ, F.col("ip_address")), F.when(succ, F.struct(*ORDER))).alias("_lip"),
        F.max(F.when(succ, F.col("created_at"))).alias("_lts"),
        F.max("created_at").alias("_seen"),
    )
    if state is None:
        return summ
    return summ.unionByName(state.select(
        "known_user_id", F.lit(-1).alias("_seg"), F.col("fails").alias("_nf"), F.col("has_success").cast("int").alias("_hs"),
        F.when(F.col("has_success"), F.col("fails")).otherwise(F.lit(0)).alias("_trail"), F.col("last_ip").alias("_lip"),
        F.col("last_success_at").alias("_lts"), F.col("last_seen").alias("_seen")))


def login_scan(events: DataFrame, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(scan, state after).  The scan adds, per attempt of a known user (ordered by
    created_at, event_id): ``fails_since_success`` (failures after the last earlier
    success, or since the start), ``prev_success_ip`` and ``prev_success_at`` (last
    earlier success) — what J12, J14 and G12 need.  Rows of unknown users pass."""
    u = "known_user_id"
    ev = _segments(events)
    summ = _summaries(ev, state)
    wc = Window.partitionBy(u).orderBy("_seg")
    cb = wc.rowsBetween(Window.unboundedPreceding, -1)
    cu = wc.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    has = F.col("_hs") == 1
    summ = summ.withColumn("_sincl", F.sum("_nf").over(cu))
    carried = summ.withColumns({
        "_sbef": F.coalesce(F.sum("_nf").over(cb), F.lit(0)),
        "_s_at_l": F.last(F.when(has, F.col("_sincl")), ignorenulls=True).over(cb),
        "_tr_at_l": F.last(F.when(has, F.col("_trail")), ignorenulls=True).over(cb),
        "_cip": F.last(F.when(has, F.col("_lip")), ignorenulls=True).over(cb),
        "_cts": F.last(F.when(has, F.col("_lts")), ignorenulls=True).over(cb),
    })
    carry = carried.select(u, "_seg", F.when(F.col("_s_at_l").isNull(), F.col("_sbef"))
                           .otherwise(F.col("_tr_at_l") + F.col("_sbef") - F.col("_s_at_l")).alias("_carry"),
                           "_cip", "_cts")
    scan = ev.join(carry, [u, "_seg"], "left")
    local_before = F.col("_fcum") - F.col("_f")
    since = F.when(F.col("_sbefore") > 0, local_before - F.col("_f_at_last_s")) \
             .otherwise(F.col("_carry") + local_before)
    scan = scan.withColumns({
        "fails_since_success": since.cast("long"),
        "prev_success_ip": F.coalesce(F.col("_ip_local"), F.col("_cip")),
        "prev_success_at": F.coalesce(F.col("_ts_local"), F.col("_cts")),
    }).drop("_seg", "_s", "_f", "_fcum", "_sbefore", "_f_at_last_s", "_ip_local", "_ts_local", "_carry", "_cip", "_cts")
    last = F.max_by(F.struct("_trail", "_sincl", "_lip", "_lts"), F.when(has, F.col("_seg")))
    after = summ.groupBy(u).agg(F.sum("_nf").alias("_all"), last.alias("_l"), F.max("_hs").alias("_hs"), F.max("_seen").alias("last_seen"))
    after = after.select(u, F.when(has, F.col("_l._trail") + F.col("_all") - F.col("_l._sincl")).otherwise(F.col("_all")).alias("fails"),
                         F.when(has, F.col("_l._lip")).alias("last_ip"), F.when(has, F.col("_l._lts")).alias("last_success_at"),
                         has.alias("has_success"), "last_seen")
    return scan, after


def segmented_login_scan(known: DataFrame) -> DataFrame:
    return login_scan(known)[0]


def consecutive_failures(scan: DataFrame) -> DataFrame:
    """Run length at each failure = min(failures since last success, 10)
    + 1 (so at most 11); ERROR from 3, else WARNING."""
    f = scan.where(F.col("event_type") == "LOGIN_FAILED")
    n = (F.least(F.col("fails_since_success"), F.lit(K.AUDIT_MAX_LOOKBACK)) + 1).cast("int")
    f = f.withColumn("consecutive_failures", n)
    return f.withColumns({
        "severity": F.when(F.col("consecutive_failures") >= K.AUDIT_ERROR_AT, "ERROR").otherwise("WARNING"),
        "message": F.when(F.col("consecutive_failures") >= K.AUDIT_ERROR_AT,
                          F.format_string(K.MSG_BRUTE_FORCE, F.col("login_attempted"), F.col("consecutive_failures")))
                    .otherwise(F.format_string(K.MSG_FAILED_PASSWORD, F.col("login_attempted"))),
    })


def lockouts(failures: DataFrame) -> DataFrame:
    """An ACCOUNT_LOCKED alert exactly when the run length reaches 3."""
    return failures.where(F.col("consecutive_failures") == K.AUDIT_LOCK_AT).select(
        "event_id", "created_at", F.col("known_user_id").alias("user_id"), "login_attempted", "ip_address",
        F.lit("ACCOUNT_LOCKED").alias("event_type"), F.lit("ERROR").alias("severity"),
        F.format_string(K.MSG_LOCKED, F.col("login_attempted"), F.col("consecutive_failures")).alias("message"),
        "consecutive_failures")


def ip_changes(scan: DataFrame) -> DataFrame:
    """A success from an IP other than the previous success's IP."""
    s = scan.where((F.col("event_type") == "LOGIN_SUCCESS") & F.col("prev_success_ip").isNotNull()
                   & (F.col("prev_success_ip") != F.col("ip_address")))
    return s.select("event_id", "created_at", F.col("known_user_id").alias("user_id"), "login_attempted",
                    "ip_address", F.col("prev_success_ip").alias("previous_ip"),
                    F.lit("IP_CHANGE").alias("event_type"), F.lit("WARNING").alias("severity"),
                    F.format_string(K.MSG_IP_CHANGE, F.col("login_attempted"), F.col("ip_address"),
                                    F.col("prev_success_ip")).alias("message"))


def unknown_logins(resolved: DataFrame) -> DataFrame:
    """Attempts with no matching active user -> WARNING, run length 1."""
    return resolved.where(F.col("known_user_id").isNull()).select(
        "event_id", "created_at", F.lit(None).cast("long").alias("user_id"), "login_attempted", "ip_address",
        F.lit("LOGIN_FAILED").alias("event_type"), F.lit("WARNING").alias("severity"),
        F.format_string(K.MSG_UNKNOWN_LOGIN, F.col("login_attempted")).alias("message"),
        F.lit(1).alias("consecutive_failures"))


def audit_log(events: DataFrame, users: DataFrame) -> DataFrame:
    """The replayed audit log: one row per written audit entry, with a
    sequence number ``seq`` inside each source event (IP_CHANGE before
    LOGIN_SUCCESS, LOGIN_FAILED before ACCOUNT_LOCKED).  The events are scanned
    once; each explodes into the entries that it writes."""
    scan, _ = login_scan(resolve_users(events, users))
    login, ip, prev = F.col("login_attempted"), F.col("ip_address"), F.col("prev_success_ip")
    known = F.col("known_user_id").isNotNull()
    failed, success = known & (F.col("event_type") == "LOGIN_FAILED"), known & (F.col("event_type") == "LOGIN_SUCCESS")
    n = (F.least(F.col("fails_since_success"), F.lit(K.AUDIT_MAX_LOOKBACK)) + 1).cast("int")
    no_n, no_ip = F.lit(None).cast("int"), F.lit(None).cast("string")

    def entry(when, seq, kind, severity, message, count=no_n, previous=no_ip):
        return F.when(when, F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("event_type"), severity.alias("severity"), message.alias("message"),
                                     count.alias("consecutive_failures"), previous.alias("previous_ip")))

    error, warning, info = F.lit("ERROR"), F.lit("WARNING"), F.lit("INFO")
    many = n >= K.AUDIT_ERROR_AT
    entries = F.array(
        entry(~known, 0, "LOGIN_FAILED", warning, F.format_string(K.MSG_UNKNOWN_LOGIN, login), F.lit(1)),
        entry(failed, 0, "LOGIN_FAILED", F.when(many, error).otherwise(warning),
              F.when(many, F.format_string(K.MSG_BRUTE_FORCE, login, n)).otherwise(F.format_string(K.MSG_FAILED_PASSWORD, login)), n),
        entry(failed & (n == K.AUDIT_LOCK_AT), 1, "ACCOUNT_LOCKED", error, F.format_string(K.MSG_LOCKED, login, n), n),
        entry(success & prev.isNotNull() & (prev != ip), 0, "IP_CHANGE", warning, F.format_string(K.MSG_IP_CHANGE, login, ip, prev), previous=prev),
        entry(success, 1, "LOGIN_SUCCESS", info, F.format_string(K.MSG_LOGIN_OK, login)))
    rows = scan.select("event_id", "created_at", F.col("known_user_id").alias("user_id"), "login_attempted", "ip_address",
                       F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("_e"))
    return rows.select("event_id", "_e.seq", "created_at", "user_id", "login_attempted", "_e.event_type", "ip_address", "_e.previous_ip",
                       "_e.severity", "_e.message", "_e.consecutive_failures", F.lit(False).alias("is_resolved"),
                       F.lit(None).cast("string").alias("resolved_by"), F.lit(None).cast("timestamp_ntz").alias("resolved_at"))


def audit_counters(log: DataFrame) -> DataFrame:
    """The dashboard counters in one aggregate."""
    sev = F.col("severity")
    return log.agg(
        F.count_if(~F.col("is_resolved") & (sev == "ERROR")).alias("unresolved_errors"),
        F.count_if(sev == "ERROR").alias("total_errors"),
        F.count_if(sev == "WARNING").alias("total_warnings"),
        F.count_if(sev == "INFO").alias("total_info"),
        F.count_if(~F.col("is_resolved") & sev.isin("ERROR", "WARNING")).alias("unresolved_alerts"),
    )


def filter_log(log: DataFrame, severity: str | None = None, event_type: str | None = None) -> DataFrame:
    """Optional severity / event-type filters."""
    if severity:
        log = log.where(F.col("severity") == severity)
    if event_type:
        log = log.where(F.col("event_type") == event_type)
    return log


def log_tail(log: DataFrame, n: int = K.AUDIT_TAIL) -> DataFrame:
    """Newest n entries (TakeOrderedAndProject: n rows per task)."""
    return log.orderBy(F.col("created_at").desc(), F.col("event_id").desc(), F.col("seq").desc()).limit(n)


def resolve_alerts(log: DataFrame, resolved: DataFrame) -> DataFrame:
    """Resolving a user clears all their unresolved LOGIN_FAILED /
    ACCOUNT_LOCKED rows.  ``resolved``: (user_id, resolved_by, resolved_at)."""
    r = resolved.select(F.col("user_id").alias("_ru"), F.col("resolved_by").alias("_rb"),
                        F.col("resolved_at").alias("_ra"))
    j = log.join(r, log.user_id == r._ru, "left")
    hit = F.col("_ru").isNotNull() & ~F.col("is_resolved") & F.col("event_type").isin("LOGIN_FAILED", "ACCOUNT_LOCKED")
    return j.withColumns({
        "is_resolved": F.when(hit, F.lit(True)).otherwise(F.col("is_resolved")),
        "resolved_by": F.when(hit, F.col("_rb")).otherwise(F.col("resolved_by")),
        "resolved_at": F.when(hit, F.col("_ra")).otherwise(F.col("resolved_at")),
    }).drop("_ru", "_rb", "_ra")


# --------------------------------------------------------------------------
# users, roles, permissions
# --------------------------------------------------------------------------

def roles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.ROLES, "role_id int, role_name string, description string")


def permissions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.PERMISSIONS, "permission_id int, permission_name string, resource string, action string")


def role_permissions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.ROLE_PERMISSIONS, "role_permission_id int, role_id int, permission_id int")


def user_permissions(users: DataFrame) -> DataFrame:
    """User ⟕ role ⟕ role_permission ⟕ permission -> "Resource:Action,…"
    (sorted by permission id).  The three seed tables are fixed-size
    (3 / 20 / 14 rows) and broadcast."""
    spark = users.sparkSession
    rp = role_permissions(spark).join(F.broadcast(permissions(spark)), "permission_id") \
        .groupBy("role_id").agg(F.array_sort(F.collect_list(F.struct("permission_id", F.concat_ws(":", "resource", "action").alias("p")))).alias("_ps"))
    rp = rp.select("role_id", F.array_join(F.transform("_ps", lambda s: s["p"]), ",").alias("permissions"))
    r = roles(spark).join(rp, "role_id", "left")
    return users.join(F.broadcast(r), "role_id", "left").select(
        "user_id", "login", "is_active", "role_id", "role_name", "permissions")


def user_counters(users: DataFrame) -> DataFrame:
    """Total / active / inactive users."""
    return users.agg(F.count(F.lit(1)).alias("total_users"),
                     F.count_if(F.col("is_active")).alias("active_users"),
                     F.count_if(~F.col("is_active")).alias("inactive_users"))


def key_conflicts(users: DataFrame, keys: list[str], id_col: str = "user_id") -> DataFrame:
    """(id, key, value, others, other): for each alternative key (login,
    email, username) the users whose value another user has in the same key,
    compared without case and outer blanks; ``other`` is the smallest other id.
    A user is no conflict of its own and an empty value conflicts with nothing.
    The keys are exploded into one equi-aggregate (no OR join), and a value's ids
    collapse to a count and two ids before they are joined back, so users that share
    a value are never paired out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.lower(F.trim(F.col(k))).alias("value")) for k in keys])
    long = users.select(F.col(id_col).alias("id"), F.explode(pairs).alias("s")).select("id", "s.key", "s.value").where("value != ''").distinct()
    shared = long.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last")).where("n > 1")
    # the smallest other id: the first one, and for the first itself the next, which only it needs
    after = long.join(shared.select("key", "value", F.col("first").alias("_f")), ["key", "value"]).where("id > _f") \
                .groupBy("key", "value").agg(F.min("id").alias("second"))
    return long.join(shared.join(after, ["key", "value"]), ["key", "value"]).select(
        F.col("id").alias(id_col), "key", "value", (F.col("n") - 1).alias("others"),
        F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("other"))
