"""Atomic batch loads: nothing of a failed load is ever seen, nothing is loaded twice."""

import pytest
from claimwise.sources import batches as B
from claimwise.sources import manifest, upload
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

SCHEMA = StructType().add("id", StringType()).add("v", DoubleType())


def rows(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in values], "id string, v double")


@pytest.fixture
def table(spark, tmp_path):
    return B.BatchTable(spark, f"file://{tmp_path}/t", SCHEMA, pk=["id"])


def held(table):
    return sorted((r["id"], r["v"], r["batch_id"]) for r in table.read().collect())


def test_batches_append_and_repeat_once(spark, table):
    assert held(table) == []
    assert table.load(rows(spark, ("a", 1.0), ("b", float("inf"))), "one") == B.Loaded("loaded", 2)
    assert table.load(rows(spark, ("a", 1.0), ("b", float("inf"))), "one") == B.Loaded("repeated")
    assert table.load(rows(spark, ("c", 3.0))).rows == 1                     # known by its content
    assert table.load(rows(spark, ("c", 3.0)).repartition(4)).status == "repeated"
    got = held(table)
    assert [(i, v) for i, v, _ in got] == [("a", 1.0), ("b", None), ("c", 3.0)] and got[0][2] == "one"
    assert table.load(rows(spark)).status == "empty"


def test_key_rules(spark, table):
    table.load(rows(spark, ("a", 1.0)), "one")
    before = held(table)
    for bad in (rows(spark, ("b", 1.0), ("b", 2.0)), rows(spark, ("b", 1.0), (None, 2.0)), rows(spark, ("a", 9.0)),
                spark.createDataFrame([("z",)], "id string")):
        r = table.load(bad, "two")
        assert r.status == "rejected" and r.reason and r.rows == 0
    assert held(table) == before


def test_a_job_that_dies_leaves_the_table(spark, table):
    table.load(rows(spark, ("a", 1.0)), "one")
    broken = rows(spark, ("b", 1.0), ("c", 2.0)).withColumn("v", F.when(F.col("id") == "c", F.raise_error(F.lit("disk full"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="disk full"):
        table.load(broken, "two")
    assert held(table) == [("a", 1.0, "one")]
    assert table.load(rows(spark, ("b", 1.0), ("c", 2.0)), "two").rows == 2          # the same id can load later
    # between staging and the swap
    keep = manifest.publish
    try:
        manifest.publish = lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost"))
        with pytest.raises(RuntimeError, match="driver lost"):
            table.load(rows(spark, ("d", 4.0)), "three")
    finally:
        manifest.publish = keep
    assert len(held(table)) == 3


def test_row_rules(spark, table):
    rules = {"no value": F.col("v").isNull(), "negative": F.col("v") < 0}
    batch = rows(spark, ("a", 1.0), ("b", None), ("c", -1.0))
    assert table.load(batch, "one", rules).status == "rejected" and held(table) == []
    assert table.load(batch, "one", rules, reject="rows") == B.Loaded("loaded", 1, 2)
    assert sorted((r["id"], r["reject_reason"]) for r in table.quarantine().collect()) == [("b", "no value"), ("c", "negative")]


def test_upload_is_all_or_nothing(spark, tmp_path):
    t = B.BatchTable(spark, str(tmp_path / "u"), StructType().add("Id", StringType()).add("Name", StringType()))
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text('name;ID\n"x;y",1\nz;2\n')
    bad.write_text("name;id\na;3\nb\n")
    r = upload.load_upload(spark, str(bad), ["Id", "Name"], t)
    assert (r.status, r.reason) == ("rejected", "Row 3 has 1 columns but header has 2.") and t.read().count() == 0
    assert upload.load_upload(spark, str(good), ["Id", "Name"], t).rows == 2
    assert upload.load_upload(spark, str(good), ["Id", "Name"], t).status == "repeated"
    assert sorted((x["Id"], x["Name"]) for x in t.read().collect()) == [("1", "x;y"), ("2", "z")]


def test_line_numbers_over_splits_and_files(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    want, n = [], 0
    for k in (2, 0, 1):
        (folder / f"part-{k}").write_text("".join(f"{k}:{i}\n" for i in range(300 * (k + 1))))
    for k in range(3):
        want += [(n + i + 1, f"{k}:{i}") for i in range(300 * (k + 1))]
        n = len(want)
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        got = sorted(map(tuple, upload.numbered_lines(spark, str(folder)).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    assert got == want
