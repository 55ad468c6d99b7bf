"""What a query builds, shuffles and joins: only what it reads."""

import datetime as dt
import math
import random

import pytest
from claimwise.operators import stats
from claimwise.plans import clean
from claimwise.plans import layers as L
from claimwise.plans import warehouse as W
from claimwise.sources import bindings, sinks
from claimwise.sources.tables import Tables
from pyspark.sql import functions as F

from tests.test_layers import GRAPH, table


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_the_wanted_layers_are_hashed_and_built(spark, tmp_path):
    root, asked = str(tmp_path / "home"), []
    raw = {"a": table(spark, [1, 2]), "b": table(spark, [5])}

    def prints(names):
        asked.append(sorted(names))
        return {r["table_name"]: r["fingerprint"] for r in L.table_prints({n: raw[n] for n in names}).collect()}

    r = L.refresh(spark, raw, root, graph=GRAPH, wanted=["left"], prints=prints)
    assert (r.built, list(r.tables), asked) == (["left"], ["left"], [["a"]])
    r = L.refresh(spark, raw, root, graph=GRAPH, wanted=["right"], prints=prints)
    assert (r.built, asked[-1]) == (["right"], ["b"])
    assert {"left", "right"} <= set(L.read_state(spark, root))          # what was not asked for keeps its state
    r = L.refresh(spark, raw, root, graph=GRAPH)
    assert (r.changed, r.built, r.tables["top"].first()["v"]) == ([], ["both", "top"], 35)


LINES = ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double, "
         "l_tax double, l_shipdate timestamp_ntz, l_returnflag string, l_linestatus string, l_comment string")


def test_prints_of_the_sources_need_no_join_and_see_every_bound_column(spark, tmp_path):
    day = dt.datetime(1996, 1, 2)
    line = {"l_orderkey": 1, "l_linenumber": 1, "l_partkey": 2, "l_suppkey": 3, "l_extendedprice": 10.0, "l_quantity": 4.0, "l_discount": 0.1,
            "l_tax": None, "l_shipdate": day, "l_returnflag": "N", "l_linestatus": "O", "l_comment": "x"}

    def prints(name, rows, orders=((1, 7, day),)):
        d = tmp_path / name
        spark.createDataFrame([tuple(r.values()) for r in rows], LINES).write.parquet(f"{d}/lineitem.parquet")
        spark.createDataFrame(list(orders), "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{d}/orders.parquet")
        return L.source_prints(Tables(spark, str(d)), ["claims_raw"])["claims_raw"]

    first = prints("first", [line])
    assert prints("unbound", [line | {"l_comment": "y"}]) == first
    other = [prints("twice", [line, line]), prints("flag", [line | {"l_returnflag": "O", "l_linestatus": "N"}]),
             prints("null", [line | {"l_discount": None, "l_tax": 0.1}]), prints("order", [line], ((1, 8, day),))]
    assert len({first, *other}) == 5


def layer(spark) -> W.CleanLayer:
    day = dt.datetime(2024, 1, 2)
    claims = [("c1", "p1", "k9", "v1", "Ouvert", 10.0, day), ("c2", "p2", "k2", "v9", "Clos", 20.0, day), ("c3", None, "k1", None, None, None, None)]
    return W.CleanLayer(
        claims=spark.createDataFrame(claims, "claim_id string, contract_id string, client_id string, vehicle_id string, statut_sinistre_claim string, "
                                             "montant_indemnisation_claim double, date_sinistre_claim timestamp_ntz"),
        policies=spark.createDataFrame([("p1", "k1", "Basic", 100.0), ("p3", "k3", "Gold", 5.0)], "contract_id string, client_id string, type_couverture string, prime_assurance_annuelle double"),
        clients=spark.createDataFrame([("k1", 1.5), ("k2", 2.5)], "client_id string, risque_global double"),
        vehicles=spark.createDataFrame([("v1", 50.0)], "vehicle_id string, valeur_vehicule double"))


def test_the_joined_view_has_the_rows_of_the_feature_table(spark):
    ml, view = W.ml_claim(layer(spark)), W.ml_claim(layer(spark), ratio=False)
    assert set(ml.columns) - set(view.columns) == {"premium_to_value_ratio"}
    assert sorted(map(str, ml.select(view.columns).collect())) == sorted(map(str, view.collect()))


def test_the_joined_view_leaves_out_joins_that_a_reader_needs_none_of(spark):
    view = W.ml_claim(layer(spark), ratio=False)
    assert "Join" not in plan(view.groupBy("statut_sinistre_claim").agg(F.sum("montant_indemnisation_claim")))
    assert plan(view.select("claim_id", "type_couverture")).count("Join") == 1      # the policies only


def test_the_ratios_bounds_come_from_one_staged_column(spark):
    for build, ratio in ((W.fact_claim, "loss_ratio"), (W.ml_claim, "premium_to_value_ratio")):
        handed = []

        def stage(df, handed=handed):
            handed.append(df.columns)
            return spark.createDataFrame(df.collect(), df.schema)

        out, plain = build(layer(spark), stage=stage), build(layer(spark))
        assert handed == [[ratio]]
        assert out.columns == plain.columns and sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))


def test_bounds_are_constants_and_the_dedup_carries_no_derived_column(spark):
    rows = [("c1", "p", "k", "v", 100.0, 90.0), ("c1", "p", "k", "v", 100.0, 80.0), ("c2", "p", "k", "v", 50.0, None), (None, "p", "k", "v", 10.0, 1000.0)]
    raw = spark.createDataFrame(rows, "claim_id string, contract_id string, client_id string, vehicle_id string, "
                                      "montant_estime_dommage_claim double, montant_indemnisation_claim double")
    out = clean.clean_claims(raw, ["montant_indemnisation_claim"])
    text = plan(out)
    assert "Join" not in text
    assert not any("claim_gap" in line or "severity" in line or "duree_" in line for line in text.splitlines() if line.strip(" +-:").startswith("Aggregate"))
    got = {r["claim_id"]: r for r in out.collect()}
    assert set(got) == {"C1", "C2"} and abs(got["C1"]["montant_indemnisation_claim"] - 80.2) < 1e-9      # clipped at 1 % of all rows
    assert abs(got["C1"]["claim_gap_amount"] + 19.8) < 0.3 and got["C2"]["claim_gap_ratio"] is None
    empty = stats.attach_quantiles(raw.where("false"), {"x": (F.col("montant_indemnisation_claim"), [0.5])})
    assert dict(empty.dtypes)["__q_x"] == "array<double>"


@pytest.mark.parametrize(("bins", "depth"), [(4096, 6), (8, 3), (2, 40)])
def test_quantiles_by_cutting_ranges_equal_percentile(spark, monkeypatch, bins, depth):
    rnd = random.Random(7)
    odd = [math.inf, -math.inf, math.nan, 1.7e308, -1.7e308, 5e-324, 0.0]
    rows = [(float(rnd.randint(0, 9)), math.exp(rnd.gauss(0, 40)) if rnd.random() > 0.1 else None, rnd.choice([*odd, rnd.random()]), 7.0) for _ in range(2000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(3)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    want = df.agg(*[F.percentile(c, F.array(*[F.lit(p) for p in probs])).alias(c) for c in df.columns]).first().asDict()
    monkeypatch.setattr(stats, "BINS", bins)
    monkeypatch.setattr(stats, "DEPTH", depth)
    monkeypatch.setattr(stats, "FEW", 0)
    got = stats.distributed_quantiles(df, {c: (F.col(c), probs) for c in df.columns} | {"none": (F.lit(None).cast("double"), [0.5])})
    assert {c: str(got[c]) for c in want} == {c: str(v) for c, v in want.items()} and got["none"] is None


def test_only_few_values_are_shuffled_for_quantiles(spark, monkeypatch):
    df, seen = spark.range(50_000).select((F.col("id") * 7919 % 50_021).cast("double").alias("v")), []
    cut = stats.bucketed
    monkeypatch.setattr(stats, "bucketed", lambda df, *a: seen.append(cut(df, *a)) or seen[-1])
    monkeypatch.setattr(stats, "FEW", 1000)
    got = stats.distributed_quantiles(df, {"v": (F.col("v"), [0.5])})
    assert got["v"][0] == df.agg(F.percentile("v", F.lit(0.5))).first()[0]
    assert sum(d.count() for d in seen) <= 1000


def lines(spark, folder, rows, orders):
    spark.createDataFrame(rows, LINES).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{folder}/orders.parquet")
    return Tables(spark, str(folder))


def test_claims_joined_by_their_order_are_not_shuffled_again_for_the_dedup(spark, tmp_path):
    day = dt.datetime(1996, 1, 2)
    rows = [(k % 40 if k % 9 else None, k % 3 if k % 7 else None, k % 5, 1, float(k % 11), 1.0, 0.01 * (k % 10), 0.0, day, "N", "OF"[k % 2], "x") for k in range(400)]
    t = lines(spark, tmp_path, rows, [(k, k % 4, day) for k in [*range(30), 3, 3, -1]])
    out = clean.clean_claims(bindings.claims_raw_keyed(t), bindings.CLAIM_ORDER_COLS, within=bindings.CLAIM_WITHIN)
    plain = clean.clean_claims(bindings.claims_raw(t), bindings.CLAIM_ORDER_COLS)
    assert out.columns == plain.columns and "l_orderkey" not in out.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))
    text = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert text.count("Exchange hashpartitioning") == 2      # the join's two sides


def test_the_statistics_stage_only_what_they_read(spark, tmp_path):
    day, staged = dt.datetime(1996, 1, 2), []
    t = lines(spark, tmp_path, [(1, 1, 1, 1, 10.0, 1.0, 0.1, 0.0, day, "N", "O", "x")], [(1, 1, day)])
    clean.clean_claims(bindings.claims_raw_keyed(t), bindings.CLAIM_ORDER_COLS, stage=lambda df: staged.append(sorted(df.columns)) or df, within=bindings.CLAIM_WITHIN).collect()
    assert staged == [["montant_estime_dommage_claim", "montant_indemnisation_claim"]]


def test_quick_prints_tell_tables_apart(spark):
    rows = lambda *r: sinks.quick_print(spark.createDataFrame(list(r), "a double, b double, s string").repartition(2), "t").first()["fingerprint"]
    one, two = (1.0, None, "x"), (None, 1.0, "x")
    kinds = [rows(one), rows(two), rows(one, one), rows(one, two), rows((1.0, None, None)), rows((1.0, None, "")), rows((None, None, "x"))]
    assert len(set(kinds)) == 7 and rows(one, two) == rows(two, one)
    assert sinks.quick_print(spark.range(3).where("false"), "t").first()["fingerprint"].startswith("0:")
