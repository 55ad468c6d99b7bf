"""Operator 8 [native]: licence scan by a trained paragraph classifier.

Paragraphs are the lines of a text.  Features are word unigrams and bigrams
(``[a-z0-9]+`` of the lower-cased text).  A sparse multinomial logistic regression (lasso) over the
families and the class ``unknown`` is trained on a small table: the fixed template paragraphs, their
sentences and halves, ordinary sentences with the same words, and at most
``SAMPLE`` paragraphs that no template matches, those with the smallest seeded hash of
(doc_id, line number) among all lines of ``SAMPLE`` documents (smallest seeded hash
of doc_id, at most ``LONGEST`` code points).  One bit of the line's hash says whether
it trains or calibrates.  A second, one-dimensional regression on held-out windows of the
templates and held-out paragraphs calibrates the margin between the best family
and ``unknown`` to a probability.  A prediction counts when the paragraph's
bigrams also match a template of the family.

Everything is DataFrame work: one projection over the documents, without a
shuffle.  A paragraph without any word of a weighted feature has the constant
score of the class ``unknown`` and leaves after one array intersection; the
weights (a feature and class table bounded by the templates) are literals.

Defined cases.  Null or empty text has no paragraphs; null doc_ids and repeated
rows are scanned like others; with an empty table the templates still train;
other columns are not read.
"""

from __future__ import annotations

import json
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, written
from .license_templates import ORDINARY, TEMPLATES

SAMPLE = 2000            # ordinary paragraphs for the fit, and as many to calibrate
LONGEST = 20_000         # code points of a document whose paragraphs the fit may take
CONFIRM = 0.6            # share of the smaller bigram set that a template must have in common
KNOWN_AT = 0.5           # calibrated probability from which a family is predicted


def words(p: Column) -> Column:
    return F.filter(F.split(F.lower(p), "[^a-z0-9]+"), lambda w: w != "")


def _plain_words(p: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", p.lower()) if w]


def bigrams(w: Column) -> Column:
    n = F.size(w)
    return F.when(n > 1, F.array_distinct(F.zip_with(F.slice(w, F.lit(1), n - 1), F.slice(w, F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b)))) \
            .otherwise(F.expr("cast(array() as array<string>)"))


def grams(w: Column) -> Column:
    return F.array_distinct(F.concat(w, bigrams(w)))


def _table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small fixed table as literals."""
    one = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names, strict=True)]) for r in rows]))
    return spark.range(1, numPartitions=1).select(one.alias("r")).select("r.*")


def _labelled(spark: SparkSession) -> DataFrame:
    """(family, w) of the templates, their sentences and halves, and the ordinary sentences."""
    t = _table(spark, TEMPLATES, ["family", "p"])
    whole = t.select("family", words(F.col("p")).alias("w"))
    half = F.ceil(F.size("w") / 2).cast("int")
    long = whole.where(F.size("w") >= 16)
    halves = long.select("family", F.slice("w", F.lit(1), half).alias("w")).unionByName(long.select("family", F.slice("w", half, half).alias("w")))
    plain = _table(spark, [("unknown", s) for s in ORDINARY], ["family", "p"]).select("family", words(F.col("p")).alias("w"))
    return whole.unionByName(halves).unionByName(plain)


def _template_sets(spark: SparkSession) -> list[tuple[str, list[str]]]:
    """Family and bigrams of each template (bounded by the fixed table)."""
    t = _table(spark, [(i, f, p) for i, (f, p) in enumerate(TEMPLATES)], ["i", "family", "p"])
    return [(r["family"], r["b"]) for r in t.select("i", "family", bigrams(words(F.col("p"))).alias("b")).orderBy("i").collect()]


def _list(values: list) -> Column:
    """A fixed list as one constant of the plan: a text that Spark folds into an array, not a node per value."""
    text = F.split(F.lit("\n".join(v if isinstance(v, str) else repr(float(v)) for v in values)), "\n")
    return text if all(isinstance(v, str) for v in values) else text.cast("array<double>")


def _template_list(templates: list[tuple[str, list[str]]]) -> Column:
    """array<struct<f, t>>: family and bigrams of the templates that have any, as one constant."""
    return F.from_json(F.lit(json.dumps([{"f": f, "t": t} for f, t in templates if t])), "array<struct<f:string,t:array<string>>>")


def _share(b: Column, template: Column) -> Column:
    """How much of the smaller bigram set both have."""
    return F.size(F.array_intersect(b, template)) / F.greatest(F.lit(1), F.least(F.size(b), F.size(template)))


class Licences:
    """The fitted classifier: feature weights, intercepts, calibration, templates."""

    def __init__(self, families: list[str], weights: dict[str, list[float]], bias: list[float], slope: float, offset: float,
                 templates: list[tuple[str, list[str]]], usual: set[str]):
        self.families, self.weights, self.bias, self.slope, self.offset = families, weights, bias, slope, offset
        self.templates = templates
        # a paragraph with a weighted feature holds one of these words
        self.triggers = sorted({max((w for w in g.split(" ") if w not in usual), key=len) for g in weights})

    def logits(self, w: Column) -> Column:
        """Scores of all classes for the words of a paragraph."""
        names, k = _list(list(self.weights)), len(self.families)
        rows = _list([x for v in self.weights.values() for x in v])          # one after the other
        row = lambda g: F.slice(rows, (F.array_position(names, g).cast("int") - 1) * k + 1, F.lit(k))
        return F.aggregate(F.array_intersect(grams(w), names), _list(self.bias), lambda acc, g: F.zip_with(acc, row(g), lambda a, b: a + b))

    def margin(self, scores: Column) -> Column:
        u = self.families.index("unknown")
        others = F.array(*[scores[i] for i in range(len(self.families)) if i != u])
        return F.array_max(others) - scores[u]

    def known(self, scores: Column) -> Column:
        return 1 / (1 + F.exp(-(self.margin(scores) * self.slope + self.offset)))

    def best(self, scores: Column) -> Column:
        u = self.families.index("unknown")
        pairs = F.array(*[F.struct(scores[i].alias("s"), F.lit(f).alias("f")) for i, f in enumerate(self.families) if i != u])
        return F.array_max(pairs)["f"]

    def confirmed(self, b: Column, family: Column) -> Column:
        """Whether a template of the family has enough of the bigrams ``b``."""
        return F.exists(_template_list(self.templates), lambda t: (t["f"] == family) & (_share(b, t["t"]) >= CONFIRM))


def fit(docs: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Licences:
    """The classifier trained on the templates and a bounded sample of the documents' paragraphs."""
    spark = docs.sparkSession
    templates = _template_sets(spark)
    # the sample is picked by id first, so that no task gathers texts; its paragraphs are small and written by all tasks
    key = F.xxhash64("doc_id", F.lit(5))
    ids = docs.where("doc_id is not null").select("doc_id", key.alias("h")).orderBy("h").limit(sample).select("doc_id").distinct()
    picked = docs.join(F.broadcast(ids), "doc_id").where(F.length("text").between(1, longest))
    lines = picked.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "p")) \
                  .select(F.xxhash64("doc_id", "i", F.lit(7)).alias("h"), words(F.col("p")).alias("w")).where("size(w) > 0") \
                  .withColumn("b", bigrams(F.col("w")))
    like = F.exists(_template_list(templates), lambda t: _share(F.col("b"), t["t"]) >= 0.3)
    ordinary = written(lines.where(~like).select((F.col("h") % 2 != 0).alias("held_out"), "h", "w"), "licence-sample")

    def some(held_out: bool) -> DataFrame:
        return ordinary.where(F.col("held_out") == held_out).orderBy("h", "w").limit(sample)

    train = _labelled(spark).unionByName(some(False).select(F.lit("unknown").alias("family"), "w"))
    families = sorted({f for f, _ in TEMPLATES}) + ["unknown"]
    label = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")).cast("double") - 1
    counted = F.when(F.col("family") == "unknown", 1.0).otherwise(8.0)
    train = train.select(grams(F.col("w")).alias("grams"), label.alias("label"), counted.alias("weight")).coalesce(1)
    train = written(train, "licence-train")
    t = _table(spark, TEMPLATES, ["family", "p"]).select(words(F.col("p")).alias("w"))
    cut = t.select(F.when(F.size("w") > 6, F.slice("w", F.lit(2), F.size("w") - 2)).otherwise(F.col("w")).alias("w"), F.lit(1.0).alias("label"))
    hold = written(cut.unionByName(some(True).select("w", F.lit(0.0).alias("label"))).coalesce(1), "licence-calibration")
    # features: grams of the templates with a word that ordinary paragraphs don't use
    plain = train.where(F.col("label") == len(families) - 1).select(F.explode("grams").alias("g")).where("instr(g, ' ') = 0")
    template_words = sorted({w for _, p in TEMPLATES for w in _plain_words(p)})
    usual = {r["g"] for r in plain.where(F.col("g").isin(template_words)).groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").collect()}
    grams_of = train.where(F.col("label") < len(families) - 1).select(F.explode("grams").alias("g")).distinct().orderBy("g").collect()
    vocabulary = [r["g"] for r in grams_of if any(w not in usual for w in r["g"].split(" "))]
    present = array_to_vector(F.transform(_list(vocabulary), lambda g: F.array_contains(F.col("grams"), g).cast("double")))
    model = LogisticRegression(family="multinomial", regParam=0.0005, elasticNetParam=0.5, weightCol="weight", maxIter=60, tol=1e-4, standardization=False) \
        .fit(train.select(present.alias("features"), "label", "weight"))
    matrix = model.coefficientMatrix.toArray()
    weights = {g: [float(x) for x in matrix[:, j]] for j, g in enumerate(vocabulary) if abs(matrix[:, j]).max() > 1e-3}
    raw = Licences(families, weights, [float(b) for b in model.interceptVector.toArray()], 1.0, 0.0, templates, usual)
    # calibration on windows of the templates and on ordinary paragraphs that the fit has not seen
    scores = F.transform(F.array(raw.logits(F.col("w"))), lambda s: raw.margin(s))      # the scores once, not once a class
    hold = hold.select(array_to_vector(scores).alias("features"), "label")
    line = LogisticRegression(family="binomial", regParam=0.01, maxIter=50).fit(hold)
    return Licences(families, weights, raw.bias, float(line.coefficients[0]), float(line.intercept), templates, usual)


def scan_licences(docs: DataFrame, model: Licences, known_at: float = KNOWN_AT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): paragraphs, predicted and confirmed
    ones, the families (sorted, comma-joined) and the best confirmed one."""
    trigger = _list(model.triggers)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n").alias("lines"))
    d = d.select("doc_id", F.size(F.filter("lines", lambda p: F.trim(p) != "")).cast("long").alias("n_paragraphs"),
                 F.filter(F.transform("lines", lambda p: F.split(F.lower(p), "[^a-z0-9]+")),
                          lambda w: F.arrays_overlap(w, trigger)).alias("some"))
    some = d.select("doc_id", "n_paragraphs", F.transform("some", lambda w: F.struct(
        F.filter(w, lambda x: x != "").alias("w"), model.logits(F.filter(w, lambda x: x != "")).alias("s"))).alias("some"))
    judged = some.select("doc_id", "n_paragraphs", F.transform("some", lambda x: F.struct(
        x["w"].alias("w"), model.known(x["s"]).alias("p"), model.best(x["s"]).alias("family"))).alias("some"))
    found = F.filter("some", lambda x: x["p"] >= known_at)
    judged = judged.select("doc_id", "n_paragraphs", F.transform(found, lambda x: F.struct(
        x["p"].alias("p"), x["family"].alias("family"), bigrams(x["w"]).alias("b"))).alias("found"))
    judged = judged.select("doc_id", "n_paragraphs", F.transform("found", lambda x: F.struct(
        x["p"].alias("p"), x["family"].alias("family"), model.confirmed(x["b"], x["family"]).alias("confirmed"))).alias("found"))
    sure = F.filter("found", lambda x: x["confirmed"])
    names = F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"])))
    return judged.select("doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_predicted"), F.size(sure).cast("long").alias("n_confirmed"),
                         F.array_join(names, ",").alias("families"), F.array_max(sure)["family"].alias("best_family"))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scan_licences(docs, fit(docs))
