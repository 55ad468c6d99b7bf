"""S2 refresh over a layer graph, and the multiset hash (H17) it rests on."""

import pytest
from claimwise.plans import layers as L
from claimwise.sources import manifest
from claimwise.sources import sinks as SK
from pyspark.sql import functions as F

SCHEMA = "k int, a double, b double, s string"


def prints(spark, *tables):
    return [SK.fingerprint(spark.createDataFrame(rows, SCHEMA).repartition(3), "t").first()["fingerprint"] for rows in tables]


def test_multiset_hash_sees_what_an_xor_misses(spark):
    one, five = (1, 1.0, None, "x"), (5, 5.0, None, "x")
    assert len(set(prints(spark, [one, one], [five, five], [one], [one, one, one], [], [one, five]))) == 6
    # a value that moves to its null neighbour, a null against an empty text, digits in the last place
    assert len(set(prints(spark, [(1, 2.0, None, "x")], [(1, None, 2.0, "x")], [(1, 2.0, None, None)], [(1, 2.0, None, "")],
                          [(1, 2.0000000000000004, None, "x")], [(1, float("nan"), None, "x")], [(1, float("inf"), None, "x")]))) == 7
    # rows in any order
    assert len(set(prints(spark, [one, five, one], [five, one, one]))) == 1
    # values do not run into each other
    two = [spark.createDataFrame([r], "a string, b string") for r in (("1", "2"), ("12", ""), ("", "12"), ("1v1:2", None))]
    assert len({SK.fingerprint(d, "t").first()["fingerprint"] for d in two}) == 4


def test_hash_is_free_of_the_session_time_zone(spark):
    df = spark.sql("select timestamp_ntz'2024-03-31 02:30:00.123456' as n, timestamp'2024-01-01 00:00:00+00:00' as z, date'2020-02-29' as d, "
                   "1.5BD as m, array(1, null) as a, binary('x') as b, true as t")
    before, zone = SK.fingerprint(df, "t").first(), spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
        assert SK.fingerprint(df, "t").first() == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def table(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v int")


GRAPH = {
    "left": L.Layer(("a",), lambda t, stage: stage(t["a"]).select((F.col("v") * 10).alias("v"))),
    "right": L.Layer(("b",), lambda t, stage: t["b"]),
    "both": L.Layer(("left", "right"), lambda t, stage: t["left"].unionByName(t["right"])),
    "top": L.Layer(("both",), lambda t, stage: t["both"].agg(F.sum("v").alias("v"))),
}


def total(r):
    return r.tables["top"].first()["v"]


def test_a_change_rebuilds_its_dependants_only(spark, tmp_path):
    root = f"file://{tmp_path}/home"          # a path only the file system of its scheme reads
    go = lambda a, b, **kw: L.refresh(spark, {"a": table(spark, a), "b": table(spark, b)}, root, graph=GRAPH, **kw)
    r = go([1, 2], [5])
    assert (r.changed, r.built, total(r)) == (["a", "b"], list(GRAPH), 35)
    r = go([2, 1], [5])                       # the same rows
    assert (r.changed, r.built, total(r)) == ([], [], 35)
    r = go([1, 2, 2], [5])
    assert (r.changed, r.built, total(r)) == (["a"], ["left", "both", "top"], 55)
    r = go([1, 2, 2], [6])
    assert (r.changed, r.built, total(r)) == (["b"], ["right", "both", "top"], 56)
    r = go([1, 2], [5])                       # back: the old layers are still there
    assert (r.changed, r.built, total(r)) == (["a", "b"], [], 35)
    r = go([1, 2], [5], force=["b"])
    assert (r.changed, r.built, total(r)) == ([], ["right", "both", "top"], 35)
    forced = L.read_state(spark, root)["right"][1]
    r = go([1, 2], [5])                       # what was forced is what readers keep
    assert r.built == [] and L.read_state(spark, root)["right"][1] == forced
    assert go([1, 2], [5], force=True).built == list(GRAPH)
    assert len(manifest.versions(spark, f"{root}/state")) == 6      # the calls that changed nothing wrote no state


def test_a_failed_build_leaves_the_old_state(spark, tmp_path):
    root = str(tmp_path / "home")
    raw = lambda b: {"a": table(spark, [1]), "b": table(spark, b)}
    L.refresh(spark, raw([5]), root, graph=GRAPH)
    before = L.read_state(spark, root)
    broken = GRAPH | {"both": L.Layer(("left", "right"), lambda t, stage: t["left"].select(F.raise_error(F.lit("no")).alias("v")))}
    with pytest.raises(Exception, match="no"):
        L.refresh(spark, raw([7]), root, graph=broken)
    assert L.read_state(spark, root) == before
    r = L.refresh(spark, raw([7]), root, graph=GRAPH)          # the change is seen again
    assert (r.changed, total(r)) == (["b"], 17) and "both" in r.built


def test_dependants_in_build_order():
    assert L.dependants(["policies_raw"]) == ["stg_clean_policies", "dw_fact_claim", "ml_claim"]
    assert L.dependants(["right", "top"], GRAPH) == ["right", "both", "top"]


def test_same_files_are_not_hashed_again(spark, tmp_path, monkeypatch):
    sf = "/root/testdata/sf0.001"
    home = spark.conf.get("claimwise.layers.root")
    first = L.build_layers(spark, sf, home)
    monkeypatch.setattr(L, "_CACHE", {})
    monkeypatch.setattr(L, "refresh", None)                    # known files go by the written list
    assert L.build_layers(spark, sf, home).ml_claim.count() == first.ml_claim.count()
