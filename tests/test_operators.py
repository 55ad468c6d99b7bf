"""Operator behaviour: segmented scan invariance, upload parser, sinks,
skew-safe top-k, plan shape."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from claimwise.operators import audit as AU
from claimwise.operators import scoring
from claimwise.sources import sinks as SK
from claimwise.sources import upload as UP


def _events(spark, seq, user="user1", uid=1):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=37 * i), uid, user,
             "LOGIN_SUCCESS" if s == "S" else "LOGIN_FAILED", f"10.0.0.{i % 2}") for i, s in enumerate(seq)]
    return spark.createDataFrame(rows, "event_id long, created_at timestamp_ntz, user_id long, "
                                       "login_attempted string, event_type string, ip_address string")


def test_run_length_and_lockout(spark):
    ev = _events(spark, "SFFFFSF")
    users = spark.createDataFrame([(1, "user1", True, 1)], "user_id long, login string, is_active boolean, role_id int")
    known = AU.resolve_users(ev, users)
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    for segments in (1, 3, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(segments))
        f = AU.consecutive_failures(AU.segmented_login_scan(known)).orderBy("event_id").collect()
        assert [r.consecutive_failures for r in f] == [1, 2, 3, 4, 1]
    spark.conf.set("spark.sql.shuffle.partitions", keep)
    locks = AU.lockouts(AU.consecutive_failures(AU.segmented_login_scan(known))).collect()
    assert [r.event_id for r in locks] == [3]


def test_run_length_caps_at_eleven(spark):
    ev = _events(spark, "S" + "F" * 14)
    users = spark.createDataFrame([(1, "user1", True, 1)], "user_id long, login string, is_active boolean, role_id int")
    f = AU.consecutive_failures(AU.segmented_login_scan(AU.resolve_users(ev, users))).orderBy("event_id")
    assert [r.consecutive_failures for r in f.collect()][-4:] == [11, 11, 11, 11]


def test_unknown_login(spark):
    ev = _events(spark, "FS", user="ghost", uid=9)
    users = spark.createDataFrame([(1, "user1", True, 1)], "user_id long, login string, is_active boolean, role_id int")
    u = AU.unknown_logins(AU.resolve_users(ev, users)).collect()
    assert len(u) == 2 and all(r.consecutive_failures == 1 and r.severity == "WARNING" for r in u)


def _write(spark, lines):
    d = tempfile.mkdtemp(prefix="upload-")
    p = os.path.join(d, "f.csv")
    with open(p, "w") as fh:
        fh.write("\n".join(lines) + "\n")
    return p


def test_upload_parser_quotes_and_delimiters(spark):
    p = _write(spark, ['Client_ID;nom,Extra', ' c1 ;"Ben ""Ali"", fils";x', '', 'c2,"a;b";y'])
    res = UP.parse_upload(spark, p, ["Client_ID", "Nom"])
    assert res.ok
    got = sorted(tuple(r) for r in res.data.select("Client_ID", "Nom").collect())
    assert got == [("c1", 'Ben "Ali", fils'), ("c2", "a;b")]


def test_upload_parser_rejects_bad_arity_and_missing_header(spark):
    p = _write(spark, ["a,b", "1,2", "1,2,3"])
    res = UP.parse_upload(spark, p, ["a", "b"])
    assert not res.ok and res.error == "Row 3 has 3 columns but header has 2."
    res = UP.parse_upload(spark, _write(spark, ["a,b", "1,2"]), ["a", "C"])
    assert not res.ok and res.missing == ["C"]


def test_upload_line_parsing(spark):
    cases = {'""""': ['"'], 'ab""cd': ["abcd"], 'a,"b,c': ["a", "b,c"], '"a;b";c': ["a;b", "c"], "": [""], ",": ["", ""], ' x ," y "': ["x", "y"],
             '"a""b",c': ['a"b', "c"], '""x"y,z': ["xy,z"], 'a;;b,': ["a", "", "b", ""]}
    df = spark.createDataFrame([(k,) for k in cases], "line string").select("line", UP.split_fields(F.col("line")).alias("f"))
    assert {r["line"]: r["f"] for r in df.collect()} == cases
    assert {k: UP.parse_line_py(k) for k in cases} == cases


def test_validate_and_cast_reads_day_first_dates(spark):
    from claimwise.operators import align
    from pyspark.sql.types import StructType
    new = spark.createDataFrame([("05/03/2024", "7"), ("2024-03-05", "x"), ("soon", None)], "d string, n string")
    target = StructType.fromDDL("d date, n int, extra string")
    got = align.validate_and_cast(new, target).collect()
    assert [(str(r["d"]), r["n"], r["extra"]) for r in got] == [("2024-03-05", 7, None), ("2024-03-05", None, None), ("None", None, None)]


def test_feature_names_and_caps(spark):
    """The one decisive category is named, also when every category stays."""
    from claimwise.models import training as TR
    rows = [(i, f"c{i % 30}", "b" if i % 4 == 0 else "a", float(i % 7), 1.0 if i % 4 == 0 else 0.0) for i in range(600)]
    df = spark.createDataFrame(rows, "claim_id int, city string, lo string, x double, y double")
    for cap, scale in ((None, False), (TR.CATEGORY_CAP, True)):
        tr = TR.train_classifier(df, "y", "claim_id", ["claim_id"], scale=scale, cap=cap)
        top = TR.feature_importances(tr, 1).first()
        assert top["feature"] in ("lo=b", "lo=a") and top["importance"] > 0.3
        cities = [n for n in tr.names if n.startswith("city=")]
        assert len([n for n in cities if n != "city=" + TR.OTHER]) >= (30 if cap is None else 11)
        got = TR.picked_threshold(tr, "y", amount="x")["results"][tr.best_name]["optimized_threshold"]
        assert 0.1 <= got["operating_points"]["precision_first"]["threshold"] <= 0.9
    meta = spark.createDataFrame([('{"best_model": "gbt", "results": {"gbt": {"optimized_threshold": {"operating_points": '
                                   '{"precision_first": {"threshold": 0.7}}, "recommended_threshold": 0.4}}}}',)], "metadata string")
    assert TR.resolve_threshold(meta, 0.5).first()[0] == 0.7


def test_quality_threshold_falls_back(spark):
    from claimwise.operators import evaluation as EV
    scan = EV.confusion_scan(spark.createDataFrame([(1, 0.1), (0, 0.2)], "y int, p double"), "y", "p", [0.5, 0.7])
    assert EV.quality_threshold(scan).first()["threshold"] == 0.5


def test_load_table_modes_and_pk(spark):
    root = tempfile.mkdtemp(prefix="load-")
    path = os.path.join(root, "t")
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "id long, v double")
    assert SK.load_table(df, path, "replace", pk=["id"])["mode"] == "overwrite"
    assert spark.read.parquet(path).where(F.col("v").isNull()).count() == 1       # A13
    assert SK.load_table(df, path, "append")["mode"] == "append"
    assert spark.read.parquet(path).count() == 4
    assert SK.load_table(df.select(*reversed(df.columns)), path, "append")["mode"] == "append"    # another order of columns
    other = spark.createDataFrame([(3,)], "id long")
    assert SK.load_table(other, path, "append")["mode"] == "overwrite"             # schema change recreates
    with pytest.raises(ValueError):
        SK.load_table(spark.createDataFrame([(1,), (1,)], "id long"), path, pk=["id"])
    assert SK.load_table(spark.createDataFrame([], "id long"), path)["written"] is False


def test_precision_at_k_matches_sort(spark):
    import random
    rnd = random.Random(7)
    vals = [round(rnd.random(), 2) for _ in range(997)]
    df = spark.createDataFrame([(v,) for v in vals], "p double")
    r = scoring.precision_capture_at_k(df, 0.10, "p").first()
    m = -(-len(vals) // 10)
    top = sorted(vals, reverse=True)[:m]
    assert r.top_n == m
    assert r.precision_at_k_pct == pytest.approx(sum(top) / m * 100, abs=1e-4)
    assert r.capture_at_k_pct == pytest.approx(sum(top) / sum(vals) * 100, abs=1e-4)


def test_keep_first_is_partial_aggregate_and_total_order(spark):
    from claimwise.operators.dedup import keep_first
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("j", 5, "z")], "k string, o int, v string")
    out = keep_first(df, ["k"], ["o"])
    assert sorted(tuple(r) for r in out.collect()) == [("j", 5, "z"), ("k", 1, "a")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_schema_profile_storage_types(spark):
    df = spark.createDataFrame([("a" * 60, 1, 2.0, True)], "s string, i long, d double, b boolean")
    got = {r.column_name: r.sql_type for r in SK.schema_profile(df).collect()}
    assert got == {"s": "NVARCHAR(100)", "i": "BIGINT", "d": "FLOAT", "b": "BIT"}


def test_distributed_quantiles_equal_percentile(spark):
    import random
    from claimwise.operators import stats
    rnd = random.Random(3)
    rows = [(float(rnd.randint(0, 50)), rnd.random() * 1e4 if rnd.random() > 0.1 else None) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double")
    specs = {"a": (F.col("a"), [0.01, 0.5, 0.99]), "b": (F.col("b"), [0.2, 0.4, 0.6, 0.8]),
             "none": (F.col("b") * F.lit(None).cast("double"), [0.5])}
    plain = df.agg(*[F.percentile(c.cast("double"), F.array(*[F.lit(p) for p in ps])).alias(stats.QCOL.format(n))
                     for n, (c, ps) in specs.items()]).first().asDict()
    assert plain == stats.quantile_row(df, specs).first().asDict()


def test_running_sums_do_not_rest_on_exchange_reuse(spark):
    from claimwise.operators.prefix import running_sums
    n = 1_000_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("v"), F.lit(1).alias("c"), F.concat(F.lit("p"), "id").alias("payload"),
                               (F.col("id") % 3).alias("k"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        bad = running_sums(df, "v", ["c"]).where("cum_c != v + 1")
        assert bad.count() == 0
        keyed = running_sums(df, "v", ["c"], key=["k"])
        top = keyed.groupBy("k").agg(F.max("cum_c").alias("m"), F.count_distinct("cum_c").alias("d"), F.count(F.lit(1)).alias("n"))
        assert all(r["m"] == r["d"] == r["n"] for r in top.collect())
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_running_sums_with_ties_nulls_and_a_hot_value(spark):
    from claimwise.operators.prefix import running_sums
    rows = [(None, 2)] + [(5, 1)] * 50 + [(i % 40, 1) for i in range(200)]
    df = spark.createDataFrame(rows, "v int, c int")
    grouped = df.groupBy("v").agg(F.sum("c").alias("c"))
    got = {r["v"]: r["cum_c"] for r in running_sums(grouped, "v", ["c"]).collect()}
    total = 0
    for v in [None, *range(40)]:
        total += sum(c for x, c in rows if x == v)
        assert got[v] == total
    assert running_sums(grouped.where("false"), "v", ["c"]).count() == 0


def test_documents_keep_their_order_and_nulls(spark, tmp_path):
    import json
    from claimwise.plans import documents as DOC
    rows = spark.createDataFrame([(f"c{i:02}", i % 4 / 4, None if i == 3 else "x") for i in range(40)], "claim_id string, p double, note string").repartition(7)
    doc = DOC.top_claims(rows, "p", 12, ["claim_id", "p", "note", "absent"], "top")
    DOC.write_document(doc, str(tmp_path / "d"))
    (text,) = [r[0] for r in spark.read.text(str(tmp_path / "d")).collect()]
    top = json.loads(text)["top"]
    assert [t["claim_id"] for t in top] == [f"c{i:02}" for i in range(3, 40, 4)] + ["c02", "c06"] and top[0]["note"] is None
    assert DOC.read_document(spark, str(tmp_path / "d"), doc.schema).first()["top"][0]["p"] == 0.75
    assert DOC.top_claims(rows.where("false"), "p", 3, ["claim_id"], "top").first()["top"] == []


def test_small_helpers(spark):
    from claimwise.operators import stats
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (10.0,)], "v double")
    assert sorted(r.v for r in stats.median_fill(df, ["v"], "exact").collect()) == [1.0, 3.0, 3.0, 10.0]
    assert [r.above for r in stats.median_split(df.dropna(), "v", "above", "exact").orderBy("v").collect()] == [0, 0, 1]
    lt = spark.createDataFrame([(0.0,), (2.0,), (10.0,)], "x double")
    assert [r[0] for r in lt.select(scoring.duration_from_log_target(F.col("x"))).collect()] == [1, 6, 120]


def test_ensure_database(spark):
    assert SK.ensure_database(spark, "claimwise_test_db") is False
    assert SK.ensure_database(spark, "claimwise_test_db") is True


def test_duration_regressor_tuning(spark):
    """M9: cross-validated excess-duration model on log1p target; skipped
    below the row floor."""
    import random
    from claimwise.models import training as TR
    rnd = random.Random(5)
    rows = []
    for i in range(420):
        sla = float(rnd.randint(5, 40))
        excess = rnd.random() * 30 + 1
        rows.append((f"c{i}", 1, sla + excess, sla, rnd.random() * 1e4, rnd.choice(["Vol", "Accident"])))
    claims = spark.createDataFrame(rows, "claim_id string, is_delayed int, duree_traitement_jours double, "
                                         "sla_jours double, montant_indemnisation_claim double, type_sinistre_claim string")
    more = spark.createDataFrame([("x1", 0, 9.0, 5.0, 1.0, "Vol"), ("x2", 1, None, 5.0, 1.0, "Vol"), ("x3", 1, 4.0, 5.0, 1.0, "Vol")], claims.schema)
    ml = claims.unionByName(more).drop("duree_traitement_jours")
    df = TR.duration_labels(ml, claims.unionByName(more))
    assert df.count() == 420 and df.where("excess_delay_days <= 0").count() == 0
    assert TR.tune_duration_regressor(df.limit(100), "claim_id", ["claim_id"]) is None
    found = TR.tune_duration_regressor(df, "claim_id", ["claim_id"], draws=2, folds=3)
    scores = found.scores.collect()
    assert len(scores) == 6 and all(sum(r["n"] for r in scores if r["draw"] == d) == 420 for d in (0, 1))
    means = {d: sum(r["rmse"] for r in scores if r["draw"] == d) for d in (0, 1)}
    best = next(r for r in scores if r["draw"] == min(means, key=means.get))
    assert found.params == {"maxDepth": best["max_depth"], "maxIter": best["max_iter"]}
    d = TR.apply_caps(df, {"type_sinistre_claim": ["Vol", "Accident"]}, False)
    assert found.best.transform(d).count() == 420


@pytest.mark.parametrize("n", [1, 4, 5, 99, 20_000])
def test_split_meets_each_labels_quota(spark, n):
    from claimwise.models import training as TR
    df = spark.range(n).select(F.concat(F.lit("c"), "id").alias("claim_id"), F.when(F.col("id") % 7 == 0, 1).when(F.col("id") % 7 < 6, 0).alias("y"))
    got = TR.stratified_split(df.repartition(5), "claim_id", "y")
    per = {r["y"]: (r["train"], r["n"]) for r in got.groupBy("y").agg(F.count_if(F.col("part") == "train").alias("train"), F.count("*").alias("n")).collect()}
    assert sum(k for _, k in per.values()) == n and all(t == k - -(-k * 20 // 100) for t, k in per.values())
    again = TR.stratified_split(df.repartition(3), "claim_id", "y")
    assert got.exceptAll(again).count() == 0


def test_conflicts_on_several_keys(spark):
    from claimwise.operators import audit as AU
    rows = [(1, "ann", "a@x", "n1"), (2, "ANN ", "b@x", "n2"), (3, "cid", "A@X", "n1"), (4, "dee", "", None), (5, "eve", "", None), (6, "fay", "fay", "fay")]
    rows += [(i, f"l{i}", "shared@x", f"u{i}") for i in range(10, 40)]
    got = {(r[0], r[1]): tuple(r[2:]) for r in AU.key_conflicts(spark.createDataFrame(rows, "user_id long, login string, email string, username string"),
                                                                ["login", "email", "username"]).collect()}
    want = {(1, "login"): ("ann", 1, 2), (2, "login"): ("ann", 1, 1), (1, "email"): ("a@x", 1, 3), (3, "email"): ("a@x", 1, 1),
            (1, "username"): ("n1", 1, 3), (3, "username"): ("n1", 1, 1)}
    want |= {(i, "email"): ("shared@x", 29, 11 if i == 10 else 10) for i in range(10, 40)}
    assert got == want


def test_runs_without_active_claims_fail(spark):
    from claimwise.plans import runs
    df = spark.createDataFrame([("c", "Clos", 1.0, 0.5, 0.5, 10.0)], "claim_id string, statut_sinistre_claim string, montant_indemnisation_claim double, "
                                                                    "delay_probability double, fraud_probability double, predicted_cost double")
    for run in (runs.delay_predictions, runs.cost_predictions):
        with pytest.raises(ValueError, match="No active claims"):
            run(df)
    assert runs.fraud_predictions(df).count() == 1


def test_anchor_falls_back_to_last_month(spark):
    import datetime
    from claimwise.operators import forecast as FC
    d = datetime.date
    rows = spark.createDataFrame([(None, None), (d(2024, 3, 9), None), (d(2024, 3, 9), d(2024, 5, 2))], "a date, b date")
    got = [r[0] for r in rows.select(FC.anchor_month(F.col("a"), F.col("b"), F.lit(d(2026, 1, 15)))).collect()]
    assert got == [d(2025, 12, 1), d(2024, 3, 1), d(2024, 5, 1)]


def test_quantiles_stay_in_ranges_at_200_partitions(spark):
    """Many distinct values, 200 shuffle partitions: no range holds the column, and only few ranges are read again."""
    from claimwise.operators import prefix, stats
    keep = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = 1_000_000
        df = spark.range(n).select(F.pmod(F.col("id") * 7919, F.lit(n)).cast("double").alias("v"))
        b = prefix.bucketed(df, ["v"], "test-ranges")
        sizes = [r["count"] for r in b.groupBy("_b").count().collect()]
        assert len(sizes) == 200 and max(sizes) < 4 * n / 200
        row = stats.quantile_row(df, {"v": (F.col("v"), [0.0, 0.01, 0.5, 0.99, 1.0])}).first()[0]
        assert row == pytest.approx([0.0, 9999.99, 499999.5, 989999.01, 999999.0])
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_records_follow_their_contract(spark):
    from claimwise.operators import align
    from claimwise.plans import runs
    df = spark.createDataFrame([("c", None, 2)], "claim_id string, x double, more int")
    got = align.default_filled(df, [("x", "double", 0.5), ("claim_id", "string", None), ("absent", "string", "unknown"), ("gone", "int", None)])
    assert got.columns == ["x", "claim_id", "absent", "gone"] and tuple(got.first()) == (0.5, "c", "unknown", None)
    pred = spark.createDataFrame([("c1", 0.95, 1), ("c2", None, 0)], "claim_id string, fraud_probability double, predicted_fraud int") \
                .withColumn("date_sinistre_claim", F.lit("2024-05-06").cast("timestamp_ntz"))
    rec = {r["claim_id"]: r for r in runs.fraud_records(pred).collect()}          # no amount column
    assert [c for c, _, _ in runs.FRAUD_RECORD] == list(rec["c1"].asDict()) and rec["c1"]["prediction_month"] == 5
    assert rec["c1"]["claim_amount_tnd"] == 0.0 and rec["c2"]["expected_preventable_loss_claim_tnd"] == 0.0 and rec["c2"]["fraud_probability"] is None


def test_dashboard_filters_are_optional(spark):
    rows = [("c-1", "High", "r1", 1), ("c-2", "High", "r2", 0), ("d-1", "Low", "r1", 0)]
    df = spark.createDataFrame(rows, "claim_id string, risk_level string, prediction_run_id string, flagged int")
    ids = lambda **kw: sorted(r["claim_id"] for r in scoring.dashboard_filter(df, **kw).collect())
    assert ids() == ["c-1", "c-2", "d-1"] and ids(risk="High") == ["c-1", "c-2"] and ids(claim_text="-1") == ["c-1", "d-1"]
    assert ids(run_id="r1", flag_col="flagged", flag=0) == ["d-1"] and ids(flag_col="flagged") == ["c-1", "c-2", "d-1"]


def test_precision_at_k_with_ties_and_no_rows(spark):
    for scores, k in (([0.9, 0.5, 0.5, 0.5, 0.1, None], 0.5), ([0.2] * 10, 0.25), ([1.0], 0.01)):
        df = spark.createDataFrame([(s,) for s in scores], "p double")
        have = sorted((s for s in scores if s is not None), reverse=True)
        m = -int(-len(have) * k // 1)
        r = scoring.precision_capture_at_k(df.repartition(3), k, "p").first()
        assert r["top_n"] == m
        assert r["precision_at_k_pct"] == pytest.approx(sum(have[:m]) / m * 100, abs=1e-4)
        assert r["capture_at_k_pct"] == pytest.approx(sum(have[:m]) / sum(have) * 100, abs=1e-4)
    assert tuple(scoring.precision_capture_at_k(spark.createDataFrame([], "p double"), 0.1, "p").first()) == (0.1, 0, None, None)
