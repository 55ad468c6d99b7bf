"""Streams over several batches: late and repeated rows, state that is forgotten, a hot user."""

import datetime as dt
import random
from types import SimpleNamespace

from claimwise import catalog_more as M
from claimwise.catalog import all_queries
from claimwise.operators import audit as AU
from claimwise.streaming import jobs as ST
from pyspark.sql import functions as F

EVENT = "event_id long, created_at timestamp_ntz, known_user_id long, login_attempted string, event_type string, ip_address string"


def attempts(n, seed=1, users=7, hot=0.4):
    rng, start, out = random.Random(seed), dt.datetime(2024, 1, 1), []
    for i in range(n):
        u = 1 if rng.random() < hot else rng.randint(2, users)
        out.append((i, start + dt.timedelta(minutes=i // 3), u, f"user{u}", rng.choice(["LOGIN_FAILED", "LOGIN_FAILED", "LOGIN_SUCCESS"]), f"10.0.0.{rng.randint(0, 2)}"))
    return out


def by_hand(rows, ttl=None):
    """What the monitor reports, one attempt after the other; with (ttl, batch ends) state is dropped at the end of a batch."""
    state, out = {}, {}
    for i, at, u, _, kind, ip in rows:
        fails, last, _ = state.get(u, (0, None, None))
        if kind == "LOGIN_FAILED":
            out[i] = (min(fails, 10) + 1, None)
            state[u] = (fails + 1, last, at)
        else:
            out[i] = (None, last)
            state[u] = (0, ip, at)
        if ttl and i in ttl[1]:
            newest = max(s[2] for s in state.values())
            state = {k: s for k, s in state.items() if s[2] > newest - ttl[0]}
    return out, state


def monitored(spark, tmp_path, parts, **kw):
    landing, sink = str(tmp_path / "landing"), str(tmp_path / "sink")
    ST.replay([spark.createDataFrame(p, EVENT).repartition(3) for p in parts], landing,
              [lambda: ST.login_monitor(ST.file_stream(spark, landing, "*.parquet"), sink, str(tmp_path / "ck"), **kw)])
    got = spark.read.parquet(sink).collect()
    assert len({r["event_id"] for r in got}) == len(got)
    return {r["event_id"]: (r["consecutive_failures"], r["previous_ip"]) for r in got}, ST.login_state(spark, sink).collect()


def test_monitor_over_batches_equals_one_pass(spark, tmp_path):
    rows = attempts(900)
    parts = [rows[:1], rows[1:200], rows[200:210], rows[210:700], rows[700:]]
    got, state = monitored(spark, tmp_path, parts)
    want, left = by_hand(rows)
    assert got == want
    assert {r["known_user_id"]: (r["fails"], r["last_ip"]) for r in state} == {u: s[:2] for u, s in left.items()}


def test_monitor_forgets_users(spark, tmp_path):
    rows = attempts(60, users=3)
    quiet = [(1000, dt.datetime(2024, 1, 1, 0, 30), 99, "user99", "LOGIN_FAILED", "10.0.0.9")]
    later = [(2000 + i, r[1] + dt.timedelta(days=2), *r[2:]) for i, r in enumerate(rows)]
    back = [(3000, dt.datetime(2024, 1, 3, 1, 0), 99, "user99", "LOGIN_FAILED", "10.0.0.9")]
    parts = [sorted(rows + quiet, key=lambda r: (r[1], r[0])), later, back]
    got, state = monitored(spark, tmp_path, parts, ttl="1 day")
    want, left = by_hand([r for p in parts for r in p], (dt.timedelta(days=1), {p[-1][0] for p in parts}))
    assert got == want and got[3000] == (1, None)          # its first failure is forgotten
    assert {r["known_user_id"] for r in state} == set(left)


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    rows = [attempts(300)[i:i + 100] for i in (0, 100, 200)]
    got, _ = monitored(spark, tmp_path, rows)
    before = ST.login_state(spark, str(tmp_path / "sink")).collect()
    ST.login_writer(str(tmp_path / "sink"))(spark.createDataFrame(rows[2], EVENT), 2)
    again = {r["event_id"]: (r["consecutive_failures"], r["previous_ip"]) for r in spark.read.parquet(str(tmp_path / "sink")).collect()}
    assert again == got and sorted(before) == sorted(ST.login_state(spark, str(tmp_path / "sink")).collect())


def test_a_hot_user_fills_many_segments(spark):
    # one user, all attempts in one hour: an hour's rows must not meet in one task
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(microseconds=i * 1000), 5, "user5", "LOGIN_SUCCESS" if i % 97 == 0 else "LOGIN_FAILED", "10.0.0.1") for i in range(6000)]
    ev = spark.createDataFrame(rows, EVENT)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["n"] for r in AU._segments(ev).groupBy("_seg").agg(F.count(F.lit(1)).alias("n")).collect()]
        scan = AU.segmented_login_scan(ev)
        got = {r["event_id"]: r["fails_since_success"] for r in scan.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 8 and max(sizes) < 2 * 6000 / 8
    assert all(got[i] == ((i - 1) % 97 if i else 0) for i in got)


def test_audit_log_scans_events_once(spark):
    ev = spark.createDataFrame(attempts(100), EVENT).withColumnRenamed("known_user_id", "user_id")
    us = spark.createDataFrame([(u, f"user{u}", u != 3) for u in range(1, 7)], "user_id long, login string, is_active boolean")
    log = AU.audit_log(ev, us)
    plan = log._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 3 and "Union" not in plan
    assert log.where("user_id is null").count() == sum(r[2] in (3, 7) for r in attempts(100))


# ---- claims

CLAIM = "claim_id string, date_sinistre_claim timestamp_ntz, montant_indemnisation_claim double, is_delayed int"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_late_rows_are_kept_apart_and_decided_once(spark, tmp_path):
    sink = str(tmp_path / "stg")
    write = ST.late_marking_writer(sink, "date_sinistre_claim", "10 days")
    batches = [[("a", day(0), 1.0, 0), ("b", day(30), 1.0, 0)], [("c", day(19), 1.0, 0), ("d", day(20), 1.0, 0), ("e", day(21), 1.0, 0), ("n", None, 1.0, 0)],
               [], [("f", day(60), 1.0, 0), ("g", day(1), 1.0, 0)], [("h", day(51), 1.0, 0), ("i", day(50), 1.0, 0)]]
    for k, rows in enumerate(batches):
        write(spark.createDataFrame(rows, CLAIM), k)
    late = lambda: {r["claim_id"] for r in spark.read.parquet(sink).where("late").collect()}
    assert late() == {"c", "d", "g", "i"} and spark.read.parquet(sink).count() == 10
    write(spark.createDataFrame(batches[1], CLAIM), 1)          # run again after later ones
    assert late() == {"c", "d", "g", "i"} and spark.read.parquet(sink).count() == 10


def test_five_batches_with_late_and_repeated_rows_equal_batch(spark, tmp_path):
    rng, claims = random.Random(3), []
    for k in range(5):
        claims.append([(f"c{k}-{i}", day(40 * k + rng.randint(0, 39)), float(i), i % 2) for i in range(60)])
    for k in range(1, 5):       # repeated rows of the batch before, and some that come far too late
        claims[k] += rng.sample(claims[k - 1][:60], 15)
        claims[k] += [(f"late{k}-{i}", day(40 * (k - 1) - 50 + i), 1.0, 0) for i in range(3)]
    sink, at = str(tmp_path / "stg"), lambda n: str(tmp_path / n)
    write, progress = ST.late_marking_writer(sink, "date_sinistre_claim", "30 days"), []
    for k, rows in enumerate(claims):
        write(spark.createDataFrame(rows, CLAIM).repartition(3), k)
        ST.dedup_claims(spark, sink, at("ids"), at("ck1"), watermark="31 days")
        ST.dedup_claims(spark, sink, at("rows"), at("ck2"), whole_rows=True, watermark="31 days")
        q = ST.daily_claim_kpis(spark, at("rows"), at("days"), at("ck3"), watermark="31 days")
        progress.append([p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1])
    top, want, late = None, {}, 0
    for rows in claims:
        for r in rows:
            if top is not None and r[1] <= top - dt.timedelta(days=30):
                late += 1
            else:
                want[r] = r
        top = max([r[1] for r in rows] + ([top] if top else []))
    assert late >= 12 and spark.read.parquet(sink).where("late").count() == late
    ids = [r["claim_id"] for r in spark.read.parquet(at("ids")).collect()]
    assert sorted(ids) == sorted({r[0] for r in want})
    days = {}
    for r in want:
        n, s, d = days.get(r[1], (0, 0.0, 0))
        days[r[1]] = (n + 1, s + r[2], d + r[3])
    got = ST.latest_per_key(spark.read.parquet(at("days")), ["window_start"]).collect()
    assert {g["window_start"].replace(tzinfo=None): (g["claims"], g["payout"], g["delayed"]) for g in got} == days
    # state is forgotten: the last batches hold no more days than the span of the watermark and a batch
    assert max(progress) <= 31 + 2 * 40 + 1 and progress[-1] < len(days)


def test_the_landings_are_joined_once_and_a_query_runs_only_its_own_jobs(spark, tmp_path, monkeypatch):
    all_queries()
    day = dt.datetime(1995, 1, 1)
    orders = spark.createDataFrame([(1, day), (2, day + dt.timedelta(days=500)), (3, day + dt.timedelta(days=9000))], "o_orderkey long, o_orderdate timestamp_ntz")
    lines = spark.createDataFrame([(1, 5), (1, 7), (2, 11), (3, 77), (9, 5)], "l_orderkey long, l_partkey long")
    landed = M.claim_arrivals(SimpleNamespace(orders=orders, lineitem=lines))
    assert all("Join" not in rows._jdf.queryExecution().optimizedPlan().toString() for rows in landed)
    assert [sorted(map(tuple, rows.collect())) for rows in landed] == [[(1, 5)], [(1, 7), (2, 11)], [(2, 11)], [], [(3, 77)]]

    ran = []
    monkeypatch.setattr(M, "claim_arrivals", lambda t: [])
    monkeypatch.setattr(M._L, "layer_root", lambda spark, sf_dir: str(tmp_path / "root"))
    monkeypatch.setattr(M.ST, "replay", lambda arrivals, landing, jobs: ran.append(len(jobs)))
    for sinks in (("stg",), ("stg", "ids"), ("stg", "rows", "days")):
        M._replayed(spark, "/root/testdata/sf0.001", *sinks)
    assert ran == [1, 2, 3]


def test_a_dedup_of_whole_rows_hands_on_only_what_its_reader_wants(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    rows = [("c1", day(1), False, 1.0, 0, "x"), ("c1", day(1), False, 1.0, 0, "x"), ("c1", day(1), False, 1.0, 0, "y"), ("c2", day(2), False, 5.0, 1, "x"), ("c3", day(2), True, 7.0, 1, "x")]
    spark.createDataFrame(rows, "claim_id string, date_sinistre_claim timestamp_ntz, late boolean, montant_indemnisation_claim double, is_delayed int, note string") \
         .write.parquet(at("stg"))
    ST.dedup_claims(spark, at("stg"), at("rows"), at("ck"), whole_rows=True, keep=ST.KPI_COLUMNS)
    got = spark.read.parquet(at("rows"))
    assert set(got.columns) == {"claim_id", *ST.KPI_COLUMNS, "batch_id"}
    assert sorted(got.toPandas()["montant_indemnisation_claim"]) == [1.0, 1.0, 5.0]        # rows that differ in a column not kept both stay
    ST.daily_claim_kpis(spark, at("rows"), at("days"), at("ck2"))
    days = spark.read.parquet(at("days")).collect()
    assert sorted((r["claims"], r["payout"], r["delayed"]) for r in days) == [(1, 5.0, 1), (2, 2.0, 0)]
