"""Operators 5, 7, 9 and 10, the pipeline and the registered queries."""

import random
import re

import corpus_pipeline
import numpy as np
import pytest
import sentencepiece
from claimwise.llm import mixing, mtree_search, quality, registry
from claimwise.llm import sentencepiece_bpe as spm

from tests import harness as H
from tests.conftest import SF_SMALL
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- 5 -------------------------------------------------------------------------

def brute_targets(size):
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(size, key=lambda s: (s is None, (s or "").encode())))}
    total, full = sum(size.values()), set()
    while True:
        rest, w = total - sum(3 * size[s] for s in full), sum(weight[s] for s in size if s not in full)
        out = {s: 3 * size[s] if s in full else rest * weight[s] / w for s in size}
        above = {s for s in size if s not in full and out[s] > 3 * size[s]}
        if not above:
            return out
        full |= above


def test_mixing_cases(spark):
    docs = cases.documents(spark)
    got = mixing.mix_sources(docs).collect()
    rows = cases.rows()
    assert sorted((g["doc_id"] is None, g["doc_id"] or 0, g["size"]) for g in got) == sorted(
        (r[0] is None, r[0] or 0, len(WORD.findall(r[1] or ""))) for r in rows)
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    want = brute_targets(size)
    assert all(g["target"] == pytest.approx(want[g["source"]]) and g["taken"] <= 3 * g["size"] for g in got)
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix_sources(cases.empty(spark)).count() == 0
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed(cases.empty(spark)).count() == 0


def test_mixing_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, cases.words(rng, rng.randint(1, 60)), f"s{i % 5}") for i in range(600)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    per = got.groupby("source").agg(t=("target", "first"), k=("taken", "sum"))
    assert (abs(per.t - per.k) <= 1).all()


def test_large_groups_are_picked_exactly(spark):
    rows = [(i, "a b c", "s0") for i in range(5000)] + [(9000 + i, "a b c", "s1") for i in range(5000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    per = got.groupby("source").agg(t=("target", "first"), k=("taken", "sum"))
    assert (abs(per.t - per.k) < 3).all()


def test_knapsack_is_optimal():
    rng = random.Random(0)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 40), rng.randint(1, 6))))
        counts = np.array([rng.randint(1, 4) for _ in lengths])
        budget = rng.randint(0, 150)
        n = mixing.knapsack(lengths, counts, budget)
        sums = {0}
        for length, c in zip(lengths, counts):
            sums = {s + k * int(length) for s in sums for k in range(c + 1)}
        assert (n <= counts).all() and int((n * lengths).sum()) == max(s for s in sums if s <= budget)


# ---- 7 -------------------------------------------------------------------------

def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 5 != 0"))
    held = quality.score(docs, model).join(labels.where("doc_id % 5 = 0"), "doc_id").toPandas()
    clean = (held.quality == 1) & (held.toxic == 0)
    assert held[clean].kept.mean() > 0.97
    assert held[held.toxic == 1].kept.mean() < 0.1
    assert held[(held.quality == 0)].kept.mean() < 0.35
    assert held[clean].expected_grade.mean() > held[held.quality == 0].expected_grade.mean() > held[held.toxic == 1].expected_grade.mean()


def test_quality_cases(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, None), (None, 1, 1), (2, None, 1), (99, 0, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    out = quality.score(docs, model)
    assert out.count() == len(cases.rows()) and out.where("p_clean is null or p_clean < 0 or p_clean > 1").count() == 0
    assert quality.fit(docs, labels.where("false")) is None
    assert quality.keep_clean(docs, None).count() == len(cases.rows())
    assert quality.keep_clean(docs, model).columns == docs.columns
    assert quality.score(cases.empty(spark), model).count() == 0
    assert quality.fit(cases.empty(spark), labels) is None


def test_thresholds_are_ordered():
    rng = np.random.default_rng(1)
    grade = rng.integers(0, 3, 300)
    places = np.concatenate([[g, 10 + int(rng.integers(0, 4))] for g in grade]).astype(np.int32)
    m = quality.Ordinal.fit(places, np.arange(0, 601, 2), grade, np.ones(300))
    assert m.cuts[0] < m.cuts[1]
    w = dict(zip(m.places.tolist(), m.weights.tolist()))
    assert w.get(0, 0) < w.get(1, 0) < w.get(2, 0)


# ---- 9 -------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizers():
    f = spm.default_model()
    with open(f, "rb") as h:
        return spm.Bpe(h.read()), sentencepiece.SentencePieceProcessor(model_file=f)


def test_encoding_equals_the_library(tokenizers):
    own, lib = tokenizers
    rng = random.Random(7)
    alphabet = "abcdeeettthhin  \n\t日本語é€😀▁<0x41>.,;:()==-- 0123"
    pieces = [p for p in own.pieces if len(p) > 2]
    texts = ["", " ", "   ", "a" * 3000, "ab" * 2000, "\x00﻿", "▁", " x  ", "�", "  a\n  b\n", "\n\n", "<s></s>"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(2000)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))).replace("▁", " ") for _ in range(2000)]
    for t, want in zip(texts, lib.encode(texts, add_eos=True)):
        assert own.encode(t) == want, t
        assert own.decode(want) == lib.decode(want), t


def test_decoding_any_ids_equals_the_library(tokenizers):
    own, lib = tokenizers
    rng = random.Random(8)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(1, 32000)]) for _ in range(rng.randint(0, 9))]
        assert own.decode(ids) == lib.decode(ids)


def test_greedy_is_not_enough(tokenizers):
    own, lib = tokenizers
    # some of these need a step back from the longest match
    texts = [a + b for a in ("thing", "other", "inter", "trans") for b in ("ingly", "ernal", "ation", "hering")]
    assert [own.encode(t) for t in texts] == lib.encode(texts, add_eos=True)


def test_encoded_rows(spark, tokenizers):
    import hashlib
    own, lib = tokenizers
    got = spm.encode_documents(cases.documents(spark), spm.default_model()).collect()
    want = []
    for r in cases.rows():
        ids = lib.encode(r[1] or "", add_eos=True)
        want.append((str(r[0]), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert sorted((str(g["doc_id"]), g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) for g in got) == sorted(want)
    ids = {str(r["doc_id"]): r["ids"] for r in spm.tokenize(cases.documents(spark).where("doc_id > 3"), spm.default_model()).collect()}
    assert ids["5"] == [2]
    assert spm.encode_documents(cases.empty(spark), spm.default_model()).count() == 0


# ---- 10 ------------------------------------------------------------------------

def brute_top(rows, k=5):
    ok = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % 50 == 0:
            s = sorted((-int(q @ v), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(1500)]
    rows += [(2000 + i, [1.0] * 8) for i in range(400)] + [(-50, [0.5] * 8), (7, [1.0] * 8)]
    rows += [(3000, None), (3050, [None] + [1.0] * 7), (3100, [float("nan")] * 8), (3150, [1.0, 2.0]), (3151, [2.0, 2.0]), (None, [1.0] * 8), (3200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted(tuple(r) for r in mtree_search.top_k(df).collect())
    assert got == brute_top(rows)
    assert mtree_search.top_k(df.where("false")).count() == 0


def test_tree_prunes_and_is_exact():
    rng = np.random.default_rng(5)
    x = np.floor(256 * np.concatenate([rng.normal(size=(800, 6)) * 0.05 + c for c in rng.normal(size=(5, 6)) * 3]))
    top2 = float((x * x).sum(1).max())
    tree = mtree_search.MTree(np.arange(len(x)), x, top2)
    for i in range(0, len(x), 97):
        got = sorted(tree.search(x[i], i, 5, top2, -np.inf), key=lambda p: (-p[0], p[1]))
        s = x @ x[i]
        s[i] = -np.inf
        assert [j for _, j in got] == np.lexsort((np.arange(len(x)), -s))[:5].tolist()


# ---- pipeline and registry -------------------------------------------------------

def test_pipeline_equals_its_stages_done_plainly(spark):
    out = corpus_pipeline.run(spark, SF_SMALL).toPandas()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    kept = quality.keep_clean(docs, quality.fit(docs, labels)).toPandas()
    kept = kept.sort_values("doc_id").drop_duplicates("text", keep="last")
    from tests.llm.test_dedup import brute_components
    comp = brute_components(list(zip(kept.doc_id, kept.text)))
    kept = kept[[comp[i] == i for i in kept.doc_id]]
    mixed = mixing.mix_sources(spark.createDataFrame(kept)).toPandas()
    times = mixed[mixed.copies > 0].set_index("doc_id").copies
    assert out.doc_id.value_counts().sort_index().to_dict() == times.sort_index().astype(int).to_dict()
    lib = sentencepiece.SentencePieceProcessor(model_file=spm.default_model())
    text = kept.set_index("doc_id").text
    assert all(len(lib.encode(text[i], add_eos=True)) == n for i, n in zip(out.doc_id, out.n_tokens))


def test_pipeline_stages_on_awkward_and_empty_tables(spark, tmp_path):
    cases.documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (cases.documents(spark), cases.empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= 3 * docs.count()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    got = registry.QUERIES[name](spark, SF_SMALL).toPandas()
    want = H.duck(SF_SMALL).execute(registry.ORACLE_SQL[name]).df()
    r = H.compare(got, want)
    assert r["cols_match"] and r["rows_match"] and r["hash_match"], r
