"""Texts are parsed once a row, and threshold scans carry a few sums a row, not some for every threshold."""

import math
import random

from claimwise import contracts as K
from claimwise.operators import evaluation as EV
from claimwise.plans import clean
from pyspark.sql import functions as F

from tests.test_scale import plan


def test_a_clients_texts_are_parsed_once(spark):
    values = ["12,5 km", " OUI", "non", "-3", "", "--", "n/a", None, "9" * 400, "abc", "1 234", "+.5x7", "NaN", "inf"]
    cols = ["age", "revenu_annuel", "score_credit", *K.CLIENT_COUNT_COLS, *K.CLIENT_RISK_COLS]
    raw = spark.createDataFrame([(f"c{i}", *[v] * len(cols)) for i, v in enumerate(values)], ", ".join(f"{c} string" for c in ["client_id", *cols]))
    staged = []
    clean.clean_clients(raw, stage=lambda df: staged.append(df) or df)
    for c in ("revenu_annuel", K.CLIENT_COUNT_COLS[0], K.CLIENT_RISK_COLS[0]):
        assert plan(staged[0].select(c)).count("regexp_extract(") == 1
    got = {r["client_id"]: r for r in staged[0].collect()}
    risk = [got[f"C{i}"][K.CLIENT_RISK_COLS[0]] for i in range(len(values))]
    assert risk == [12.5, 1.0, 0.0, -3.0, None, None, None, None, None, None, 1234.0, 0.5, None, None]
    assert [got[f"C{i}"]["revenu_annuel"] for i in (0, 3, 10)] == [12.5, None, 1234.0]
    assert [got[f"C{i}"][K.CLIENT_COUNT_COLS[0]] for i in (0, 1, 3, 11)] == [12, 1, None, 0]


def test_a_claims_texts_are_parsed_once(spark):
    values = ["4,0", " 1 2 ", "-1", "x", "", None, "Infinity", "NaN"]
    raw = spark.createDataFrame([(f"c{i}", "p", "k", "v", s) for i, s in enumerate(values)],
                                "claim_id string, contract_id string, client_id string, vehicle_id string, sla_jours string")
    out = clean.clean_claim_rows(raw)
    assert out.columns[:5] == raw.columns
    assert plan(out.select("sla_jours", "duree_traitement_jours")).count("regexp_replace(regexp_replace(") == 1
    got = {r["claim_id"]: r["sla_jours"] for r in out.collect()}
    assert [got[f"C{i}"] for i in range(len(values))] == [4.0, 12.0, None, None, None, None, None, None]


def test_a_threshold_scan_sums_bins_and_counts_every_row(spark):
    rnd, grid = random.Random(3), [0.5, 0.1, 0.9, 0.3]
    odd = [None, math.nan, math.inf, -math.inf, *grid, 0.0]
    rows = [(rnd.choice([0, 1, None]), rnd.choice(odd) if rnd.random() < 0.4 else rnd.random()) for _ in range(600)]
    df = spark.createDataFrame(rows, "y int, p double").repartition(3)
    scan = EV.confusion_scan(df, "y", "p", grid)
    rows_read = [line for line in plan(scan).splitlines() if "Aggregate [" in line][-1]
    assert rows_read.count("count(") + rows_read.count("sum(") <= 4
    high = lambda p, t: math.isnan(p) or p >= t
    for r in scan.collect():
        known = [(y, p) for y, p in rows if y is not None]
        tp, fp, tn, fn = (sum(1 for y, p in known if p is not None and y == a and high(p, r["threshold"]) == b) for a, b in ((1, True), (0, True), (0, False), (1, False)))
        assert (r["n"], r["tp"], r["fp"], r["tn"], r["fn"]) == (len(known), tp, fp, tn, fn) and math.isnan(r["flagged_p"])
    finite = df.where("p is not null and not isnan(p) and abs(p) <= 1")
    for r in EV.confusion_scan(finite, "y", "p", grid).collect():
        want = finite.where(F.col("y").isNotNull() & (F.col("p") >= r["threshold"])).agg(F.sum("p")).first()[0]
        assert abs(r["flagged_p"] - want) < 1e-9
    empty = EV.confusion_scan(df.where("false"), "y", "p", grid).first()
    assert (empty["n"], empty["tp"], empty["flagged_p"], empty["f1_score"]) == (0, 0, 0.0, 0.0)
