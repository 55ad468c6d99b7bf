"""Cases that reviews found: long digit runs, large vector components, clashing column names, small and large sources."""

import numpy as np
import pytest
from claimwise.llm import exact_dedup, minhash_dedup, mixing, mtree_search, pii_crf, quality, sentencepiece_bpe

from tests.llm import cases


def test_long_digit_runs_are_no_addresses(spark):
    texts = ["x 1.2.3." + "9" * 5000, "x 1.2.3." + "0" * 5000 + "7 y", "1" * 6000 + ".1.1.1", "256.1.1.1 255.255.255.255 0256.1.1.1 00255.0.0.0"]
    assert [sum(k == 1 for _, k, _ in pii_crf.base_spans(t)) for t in texts] == [0, 1, 0, 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert pii_crf.byte("") and pii_crf.byte("000255") and not pii_crf.byte("256") and not pii_crf.byte("1000")
    got = {r["doc_id"]: r["n_ip"] for r in pii_crf.personal_data(docs, None).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 2}


def exact_top(rows, k=5):
    x = {i: [int(np.floor(256 * np.float64(c))) for c in v] for i, v in rows}
    out = []
    for q in x:
        if q % 50 == 0:
            s = sorted(((-sum(a * b for a, b in zip(x[q], x[c], strict=True)), c) for c in x if c != q))[:k]
            out += [(q, r, c, -t) for r, (t, c) in enumerate(s, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e7 / 8])
def test_large_components_keep_exact_scores(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(size=4) * scale]) for i in range(300)]
    rows += [(300 + i, [c + (1 / 256 if j == i else 0) for j, c in enumerate(rows[7][1])]) for i in range(4)]      # scores that differ in the last digits
    got = mtree_search.top_k(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, v string")).collect()
    assert sorted(map(tuple, got)) == exact_top(rows)


def test_the_reported_pair(spark):
    rows = [(0, [1e7, 0.0]), (1, [1e3, 0.0])]
    (got,) = mtree_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert tuple(got) == (0, 1, 1, 655_360_000_000_000)


def plain(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_stages_take_clashing_column_names(spark):
    docs, more = cases.documents(spark), cases.clashing(spark)
    for stage in (exact_dedup.keep_one, minhash_dedup.keep_one, mixing.mixed, lambda d: quality.keep_clean(d, None)):
        got = stage(more)
        assert got.columns == more.columns
        assert plain(got, docs.columns) == plain(stage(docs), docs.columns)
        assert {r["z"] for r in got.select("z").collect()} == {"z"}
    model = sentencepiece_bpe.default_model()
    assert plain(sentencepiece_bpe.encode_documents(more, model), ["doc_id", "ids_sha256"]) == \
        plain(sentencepiece_bpe.encode_documents(docs, model), ["doc_id", "ids_sha256"])


@pytest.mark.parametrize("each", [5, 100, 2000])
def test_budgets_of_any_size_take_all_lengths_alike(each):
    # 25,250, 505,000 and 10,100,000 words: half of them wanted
    lengths, counts = np.arange(1, 101), np.full(100, each)
    total = int((lengths * counts).sum())
    passes, n = mixing.fit(lengths, counts, total / 2)
    assert passes == 0 and (n >= 0).all() and (n <= counts).all() and int((n * lengths).sum()) == total // 2
    for part in (slice(0, 50), slice(50, 100)):
        assert 0.4 < n[part].sum() / counts[part].sum() < 0.6


@pytest.mark.parametrize("seed", range(6))
def test_uneven_lengths_meet_their_budget(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(0, 10 ** rng.integers(1, 6), 300))
    counts = rng.integers(1, 4, len(lengths))
    total = int((lengths * counts).sum())
    for share in (0.01, 0.3, 0.5, 0.9, 1.7, 2.99):
        passes, n = mixing.fit(lengths, counts, total * share)
        taken = passes * total + int((n * lengths).sum())
        assert (n >= 0).all() and (n <= counts).all() and total * share - max(lengths.max(), 1) <= taken <= total * share + 1
