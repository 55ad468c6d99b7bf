"""Operators 1, 3 and 6 against brute force on the awkward cases."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from claimwise.llm import common as C
from claimwise.llm import exact_dedup, minhash_dedup, substring_dedup

from tests.llm import cases

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall((text or "").encode().lower())
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)])


def brute_components(rows):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(r[0], shingle_set(r[1])) for r in rows if r[0] is not None]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i:]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y) and find(a) != find(b):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: find(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rows = cases.rows()
    got = minhash_dedup.near_duplicates(cases.documents(spark)).collect()
    comp = brute_components(rows)
    want = Counter((r[0], len(shingle_set(r[1])), comp.get(r[0]), r[0] is not None and comp[r[0]] == r[0]) for r in rows)
    assert Counter(map(tuple, got)) == want


def test_near_duplicates_around_one_passage(spark):
    # documents that share much of one passage meet in buckets but stay apart
    import random
    rng = random.Random(3)
    passage = cases.words(rng, 60)
    texts = [passage + " " + cases.words(rng, 12 + i % 9) for i in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    common, a, b = (C.mix(rng.integers(1, 1 << 62, n).astype(np.uint64)) for n in (900, 150, 150))
    e = np.concatenate([common, a, common, b])
    sig = minhash_dedup.superminhash(e, np.array([0, 1050, 2100]))
    assert abs((sig[0] == sig[1]).mean() - 0.75) < 0.12
    one = minhash_dedup.superminhash(common[:1], np.array([0, 1]))
    assert sorted((one[0] >> np.uint64(32)).tolist()) == list(range(minhash_dedup.SLOTS))   # a permutation of the ranks


def test_exact_equals_brute_force(spark):
    rows = cases.rows()
    got = exact_dedup.exact_duplicates(cases.documents(spark)).collect()
    top, size = {}, Counter()
    for r in rows:
        t = r[1] or ""
        size[t] += 1
        top[t] = max(top.get(t, -1 << 62), -1 << 61 if r[0] is None else r[0])
    want = Counter((r[0], top[r[1] or ""] if top[r[1] or ""] > -1 << 61 else None, size[r[1] or ""],
                    hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    assert Counter((g["doc_id"], g["keep_id"], g["group_size"], g["text_sha256"]) for g in got) == want
    stay = [g["text_sha256"] for g in got if g["kept"]]
    assert len(stay) == len(set(stay)) == len(size)
    assert all(g["doc_id"] == g["keep_id"] for g in got if g["kept"])


def test_exact_keep_one_keeps_each_text_once(spark):
    out = exact_dedup.keep_one(cases.documents(spark))
    assert out.columns == cases.documents(spark).columns
    texts = [r["text"] or "" for r in out.collect()]
    assert sorted(texts) == sorted({r[1] or "" for r in cases.rows()})


def brute_repeats(rows):
    first = {}
    docs = [(r[0], (r[1] or "").encode().split()) for r in rows]
    for i, w in docs:
        if i is not None:
            for s in range(len(w) - 49):
                k = tuple(w[s:s + 50])
                first[k] = min(first.get(k, i), i)
    for i, w in docs:
        keep = [True] * len(w)
        for s in range(len(w) - 49):
            if i is not None and first[tuple(w[s:s + 50])] < i:
                keep[s:s + 50] = [False] * 50
        left = b" ".join(x for x, k in zip(w, keep) if k)
        yield i, len(w), len(w) - sum(keep), hashlib.sha256(left).hexdigest()


def test_repeats_equal_brute_force(spark):
    got = substring_dedup.remove_repeats(cases.documents(spark)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(brute_repeats(cases.rows()))


@pytest.mark.parametrize("run", [minhash_dedup.near_duplicates, exact_dedup.exact_duplicates, substring_dedup.remove_repeats,
                                 minhash_dedup.keep_one, exact_dedup.keep_one])
def test_empty_table(spark, run):
    assert run(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("n, universe", [(0, 10), (1, 1), (5, 1 << 40), (1000, 4096), (3000, 3000)])
def test_golomb_round_trip(n, universe):
    v = np.sort(np.random.default_rng(n).choice(universe, n, replace=False)).astype(np.uint64)
    assert (C.ungolomb(C.golomb(v, universe), n, universe) == v).all()


def test_word_hashes_do_not_depend_on_the_place():
    def first(text):
        d = np.frombuffer(text.encode(), np.uint8)
        s, e, _ = C.word_spans(d, np.array([0, len(d)]))
        return C.word_hashes(d, s, e)
    assert first("abc x")[0] == first("zz\tq abc")[2] != first("abd")[0]
