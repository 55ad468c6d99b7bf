"""Operators 11, 12 and 13 against brute force on the awkward cases."""

import hashlib
import math
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from claimwise.llm import filter_audit, fingerprints, ranked_search
from pyspark.sql import functions as F

from tests.llm import cases

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans(ranked_search.UPPER_CASE, ranked_search.LOWER_CASE)
ITEM = "item_id long, text string, doc_id string, rank int"


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute_ranking(items, docs, k=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, b, n in bags:
            m = 75 + 25 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m))
                    for t in terms(text) if b[t])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


def some_items(rows):
    texts = [rows[0][1][:300], rows[11][1], "one two one", "", None, "!!!", "É日本 AKIA password", rows[15][1][5000:6000], "one two one", "nowhereatall"]
    return [(i if i != 6 else None, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("postings", [ranked_search.BLOCK_POSTINGS, 40])
def test_ranking_equals_brute_force(spark, postings):
    rows = cases.rows()
    items = some_items(rows)
    got = ranked_search.rank_documents(spark.createDataFrame([(*x, "x", 1) for x in items], ITEM), cases.documents(spark), block_postings=postings)
    assert Counter(map(tuple, got.collect())) == brute_ranking(items, [(r[0], r[1]) for r in rows])


def test_ranking_keeps_ties_and_bounds_the_heap(spark):
    docs = [(i, "same words here") for i in range(60, 0, -1)] + [(None, "same words here"), (100, "other text"), (101, None)]
    items = [(7, "same words"), (8, "other")]
    got = ranked_search.rank_documents(spark.createDataFrame(items, "item_id long, text string"),
                                       spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert Counter(map(tuple, got.collect())) == brute_ranking(items, docs)


def test_ranking_of_empty_tables(spark):
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert ranked_search.rank_documents(some, cases.empty(spark)).count() == 0
    assert ranked_search.rank_documents(none, cases.documents(spark)).count() == 0


def test_terms_of_bytes_equal_the_pattern():
    texts = ["Ab1_c-é日本😀x", "", "...", "a", "Zz[`{@/:", "tail end", "x\x7fy\x00z"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    off = np.cumsum([0, *map(len, raw)])
    s, e, bounds = ranked_search.term_spans(data, off)
    cut = [data[a:b].tobytes().decode() for a, b in zip(s, e, strict=True)]
    assert [cut[bounds[i]:bounds[i + 1]] for i in range(len(raw))] == [TERM.findall(t) for t in texts]


# ---- operator 12

LABELS = [(0, 1, 0), (0, 0, 1), (1, 0, 1), (2, None, None), (None, 1, 1), (14, 1, 0), (9, 1, 1), (3, 0, None), (15, 1, 0)]


def brute_audit(rows, labels):
    least = {}
    for i, t in rows_of(rows):
        if i is not None:
            least[t] = min(i, least.get(t, i))
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    parts = {}
    for r in rows:
        t, words = r[1] or "", re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        bad = {f for f, x in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                                           bool(re.search(r"[#$%&*|]", t)), r[0] is not None and r[0] > least[t]), strict=True) if x}
        parts.setdefault(r[3] or "", []).append((r[0], bad))
    out = {}
    for p, docs in parts.items():
        per_filter = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                before = [d for d in docs if set(order[:step - 1]) & d[1]]
                left = [d for d in left if f not in d[1]]
                per_filter[f] += len(gone)
                out[p, order, step] = [len(left), len(gone), sum(f in d[1] for d in before), sum(d[1] == {f} for d in docs),
                                       sum(d[0] in good for d in gone if d[0] is not None), sum(d[0] in toxic for d in gone if d[0] is not None)]
        for (q, order, step), v in out.items():
            if q == p:
                v.append(per_filter[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def rows_of(rows):
    return [(r[0], r[1] or "") for r in rows]


AUDIT = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audited(spark, docs, labels=LABELS):
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.col("source")).collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in got}) == len(got)
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in AUDIT) for r in got}


def test_audit_equals_brute_force(spark):
    rows = cases.rows()
    assert audited(spark, cases.documents(spark)) == brute_audit(rows, LABELS)
    assert audited(spark, cases.empty(spark)) == {}
    assert audited(spark, cases.documents(spark), []) == brute_audit(rows, [])


def test_audit_with_a_hot_text(spark, monkeypatch):
    # one text holds half of the rows, more light ones repeat: both joins are taken, over several blocks of rows
    monkeypatch.setattr(filter_audit, "HEAVY", 3)
    rows = [(i, "hot " * 60 if i % 2 else f"text {i % 31} " + "w " * 5, None, "s1" if i % 3 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7)
    assert audited(spark, docs) == brute_audit(rows, LABELS)
    flags = filter_audit.flagged(docs, F.col("source"))
    assert flags.count() == 400 and flags.where("mask >= 16").count() == 400 - 1 - 31


def test_sketch_clears_unique_texts(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("unique text "), F.col("id").cast("string")).alias("text"))
    docs = docs.unionByName(docs.where("doc_id % 10 = 0").withColumn("doc_id", F.col("doc_id") + 100_000))
    got = filter_audit.flagged(docs.repartition(6), F.lit("p"))
    assert got.where("mask >= 16").count() == 500
    assert 1000 <= got.where("repeats").count() <= 1150        # the repeats, and few unique texts beside them


# ---- operator 13

def brute_digest(text):
    b = text.encode() + bytes(5)
    counts = [0] * 512
    for i in range(len(b) - 5):
        t = fingerprints.TABLES
        counts[t[0][b[i]] ^ t[1][b[i + 2]] ^ t[2][b[i + 5]]] += 1
    q = sorted(counts)
    codes = [sum(c > q[k] for k in (127, 255, 383)) for c in counts]
    bits = "".join(f"{c:02b}" for c in codes)
    return f"{round(8 * math.log2(len(b) - 4)):02x}" + "".join(f"{int(bits[i:i + 8], 2):02x}" for i in range(0, 1024, 8))


def brute_likeness(a, b):
    size = abs(int(a[:2], 16) - int(b[:2], 16)) / 8
    if (a[:2] == "00") != (b[:2] == "00"):
        return 0.0
    x, y = ([int(f"{int(h[2:], 16):01024b}"[i:i + 2], 2) for i in range(0, 1024, 2)] for h in (a, b))
    apart = sum(abs(v - w) for v, w in zip(x, y, strict=True)) / 512
    chance = sum(abs(v - w) * x.count(v) * y.count(w) for v in range(4) for w in range(4)) / 512**2
    body = apart / chance if chance else float(apart > 0)
    return 1 - min(1, body + 0.1 * size)


@pytest.mark.parametrize("partitions", [1, 8])
def test_edit_audit_equals_brute_force(spark, partitions):
    rows = [r for r in cases.rows() if r[0] != 15] + [(15, cases.rows()[15][1][:9000], *cases.rows()[15][2:])]
    # rows of one doc_id come in the order of a hash: here they are equal, or the null ones, at the end
    rows = [r for r in rows if r[0] is not None] + [r for r in rows if r[0] is None][:1]
    docs = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, r[0] or 0))
    want = Counter()
    for k, (i, t) in enumerate(docs):
        nxt = docs[(k + 1) % len(docs)][1]
        e = t[:len(t) - len(t) // 4] + nxt[:len(t) // 4]
        own, edited, after = map(brute_digest, (t, e, nxt))
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest(), own, edited, round(brute_likeness(own, edited), 9), round(brute_likeness(own, after), 9)] += 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(partitions == 1).lower())
    try:
        got = fingerprints.edit_audit(spark.createDataFrame(rows, cases.SCHEMA).repartition(partitions)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert Counter((g[0], g[1], g[2], g[3], g[4], round(g[5], 9), round(g[6], 9)) for g in got) == want


def test_edit_audit_small_tables(spark):
    assert fingerprints.edit_audit(cases.empty(spark)).count() == 0
    (one,) = fingerprints.edit_audit(spark.createDataFrame([(3, "abcdefgh")], "doc_id long, text string")).collect()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one["near_next"] == 1.0


def test_fingerprints_of_whole_tables_and_their_comparison(spark):
    prints = fingerprints.fingerprints(cases.documents(spark)).collect()
    assert Counter(r["fingerprint"] for r in prints) == Counter(brute_digest((r[1] or "")) if r[0] != 15 else
                                                                next(p["fingerprint"] for p in prints if p["doc_id"] == 15) for r in cases.rows())
    a, b = (next(p["fingerprint"] for p in prints if p["doc_id"] == i) for i in (0, 20))
    pairs = spark.createDataFrame([(a, b), (a, a), (a, None)], "a string, b string")
    like = [r["likeness"] for r in fingerprints.compare(pairs).collect()]
    assert like[0] == pytest.approx(brute_likeness(a, b)) and like[0] > 0.8 and like[1:] == [1.0, None]


def test_likeness_separates_edits_from_neighbours(spark):
    got = fingerprints.op13_fingerprints(spark, "/root/testdata/sf0.001").where("n_chars >= 40")
    row = got.agg(F.avg("near_edited").alias("e"), F.expr("percentile(near_next, 0.9)").alias("n"), F.count_if(F.expr("near_edited > near_next")).alias("k"),
                  F.count(F.lit(1)).alias("all"), F.min("near_next").alias("low"), F.max("near_edited").alias("high")).first()
    assert row["e"] > 0.6 and row["n"] < 0.45 and row["k"] >= 0.99 * row["all"] and row["low"] >= 0 and row["high"] <= 1
