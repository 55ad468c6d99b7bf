"""Features of chosen claims, joined as far as they are read."""

from claimwise.models import training as TR
from claimwise.plans import warehouse as W
from pyspark.sql import functions as F

from tests.test_scale import layer, plan


def test_features_of_some_claims_are_their_rows_of_the_feature_table(spark):
    cl = layer(spark)
    ml, some = W.ml_claim(cl), cl.claims.where("claim_id <> 'c2'")
    got = W.ml_claim(cl, rows=some)
    assert got.columns == ml.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, ml.where("claim_id <> 'c2'").collect()))
    assert "Join" not in plan(got.groupBy("statut_sinistre_claim").count())


def test_labels_go_before_the_feature_joins(spark):
    cl = layer(spark)
    cl.claims = cl.claims.withColumns({"is_delayed": F.when(F.col("claim_id") != "c3", 1), "duree_traitement_jours": F.lit(9.0), "sla_jours": F.when(F.col("claim_id") == "c1", 4.0).otherwise(9.5)})
    table = TR.duration_labels(W.ml_claim(cl), cl.claims)
    got = TR.duration_labels(lambda rows: W.ml_claim(cl, rows=rows), cl.claims)
    assert got.columns == table.columns
    assert list(map(str, got.collect())) == list(map(str, table.collect())) and got.first()["excess_delay_days"] == 5.0
    assert "Join" not in plan(got.select("claim_id", "excess_delay_days"))


def test_fill_values_come_from_the_tables_that_hold_the_features(spark):
    cl = layer(spark)
    more = spark.createDataFrame([("c4", "p1", "k1", "v1", "Clos", 7.0), ("c5", "p1", "k2", None, "Clos", 9.0), ("c6", "p3", None, "v1", "Clos", None)],
                                 "claim_id string, contract_id string, client_id string, vehicle_id string, statut_sinistre_claim string, montant_indemnisation_claim double")
    cl.claims = cl.claims.unionByName(more, allowMissingColumns=True)
    ml, bounds = W.ml_claim(cl), W.ratio_bounds(cl)
    num, cat = TR.feature_columns(ml, ["claim_id", "contract_id", "client_id", "vehicle_id"], "none")
    rows = ml.select("claim_id", "contract_id", "client_id", "vehicle_id", *W.unjoined(cl, num + cat))
    parts = W.ml_parts(cl, rows, num + cat, bounds, lambda df: df)
    assert sorted(c for _, cols in parts for c in cols) == sorted(num + cat) and len(parts) == 5
    assert {c: v for p, cols in parts for c, v in TR.medians(p, [c for c in num if c in cols], "_rows").items()} == TR.medians(ml, num)
    assert {c: v for p, cols in parts for c, v in TR.cap_categories(p, [c for c in cat if c in cols], 3, "_rows").items()} == TR.cap_categories(ml, cat, 3)
