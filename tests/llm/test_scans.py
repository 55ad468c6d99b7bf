"""Operators 2, 4 and 8: base spans against plain patterns, and what the methods add."""

import hashlib
import random
import re

import numpy as np
from claimwise.llm import license_scan, pii_crf, secret_scan
from pyspark.sql import functions as F

from tests.llm import cases


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans)).encode()).hexdigest()


def brute_secrets(t):
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return out + [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]


def secrets(spark, df):
    return secret_scan.scan_secrets(df, F.col("lang"), F.col("source"))


def test_secret_base_spans(spark):
    want = {}
    for r in cases.rows():
        s = brute_secrets(r[1] or "")
        want[r[0], r[1]] = (*(sum(x[1] == k for x in s) for k in range(3)), digest(s))
    docs = cases.documents(spark)
    got = secrets(spark, docs).collect()
    assert len(got) == len(cases.rows())
    assert sorted((g["doc_id"] is None, g["doc_id"] or 0, g["n_assign"], g["n_access"], g["n_hex"], g["base_sha256"]) for g in got) == sorted(
        (i is None, i or 0, *want[i, t]) for i, t, *_ in cases.rows())
    assert secrets(spark, cases.empty(spark)).count() == 0


def test_secret_consumed_key_is_not_matched_again():
    t = "password: secret: abcdefghijklmnop"
    assert [s[:3] for s in secret_scan.base_spans(t)] == [s[:3] for s in sorted(brute_secrets(t))] == []


def test_secret_ownership(spark):
    live, copied = "0123456789abcdef", "aaaabbbbccccddddeeee0123"
    rows = [(i, f"x {copied} y", "r", f"o{i}") for i in range(5)] + [(9, f"z {live}", "r", "o9")]
    got = {r["doc_id"]: r for r in secrets(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[9]["spans"] == "hex:2:18,live:2:18" and got[9]["n_live"] == 1
    assert got[0]["spans"] == "hex:2:26,example:2:26" and got[0]["n_example"] == 1


def brute_pii(t):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if max(map(int, m[0].split("."))) < 256]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    return out + [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]


def pii_rows(n=300):
    rng = random.Random(2)
    out = []
    for i in range(n):
        d = "".join(rng.choice("0123456789") for _ in range(7))
        part = [f"+1 ({d[:3]}) 555-{d[3:]}", f"u{d[:3]}@mail{d[0]}.example.com", f"10.{int(d[:2])}.{int(d[2:4])}.9", "plain words only"][i % 4]
        out.append((i, f"{cases.words(rng, 9)} {part} {cases.words(rng, 7)}\n{cases.words(rng, 12)}"))
    return out


def test_pii_base_spans_and_crf(spark):
    docs = cases.documents(spark)
    train = spark.createDataFrame(pii_rows(), "doc_id long, text string")
    model = pii_crf.fit(train)
    got = pii_crf.personal_data(docs, model).collect()
    def row(i, t):
        s = brute_pii(t or "")
        return (i is None, i or 0, *(sum(x[1] == k for x in s) for k in range(4)), digest(s))
    assert sorted((g["doc_id"] is None, g["doc_id"] or 0, g["n_email"], g["n_ip"], g["n_card"], g["n_phone"], g["base_sha256"]) for g in got) == sorted(
        row(i, t) for i, t, *_ in cases.rows())
    assert pii_crf.personal_data(cases.empty(spark), model).count() == 0
    assert pii_crf.personal_data(docs, None).where("n_crf > 0").count() == 0
    assert pii_crf.fit(cases.empty(spark)) is None


def test_crf_finds_held_out_spans_and_viterbi_is_best():
    rows = pii_rows(400)
    model = pii_crf.train([t for _, t in rows[:300]])
    hit = total = wrong = 0
    for _, t in rows[300:]:
        raw = np.frombuffer(t.encode(), np.uint8)
        starts, ends, bounds = pii_crf.lines_of(raw, np.array([0, len(raw)]))
        label = model.viterbi(model.neighbours(pii_crf.shapes(raw, starts, ends), bounds), bounds)
        inside = np.zeros(len(starts), bool)
        for s, _, e, _ in brute_pii(t):
            inside |= (ends > s) & (starts < e)
        hit += int((label[inside] > 0).sum())
        total += int(inside.sum())
        wrong += int((label[~inside] > 0).sum())
    assert hit >= 0.95 * total > 0 and wrong <= 0.02 * total
    # against all label sequences of a short line
    rng = np.random.default_rng(0)
    small = pii_crf.Crf(rng.normal(size=(3, pii_crf.SHAPES + 1, 5)), rng.normal(size=(6, 5)))
    near = small.neighbours(np.array([3, 9, 1, 4]), np.array([0, 4]))
    s = small.scores(near)
    def value(y):
        return small.move[5, y[0]] + sum(s[i, c] for i, c in enumerate(y)) + sum(small.move[a, b] for a, b in zip(y, y[1:]))
    import itertools
    best = max(itertools.product(range(5), repeat=4), key=value)
    assert tuple(small.viterbi(near, np.array([0, 4])).tolist()) == best


def test_crf_learns_from_lines_with_digits_and_no_personal_data(spark):
    rng = random.Random(3)
    kinds = [lambda: f"{rng.randint(1900, 2020)}-{rng.randint(1900, 2020)}", lambda: str(rng.randint(1900, 2030)), lambda: f"({rng.randint(100, 999)})",
             lambda: f"{rng.randrange(1 << 28, 1 << 32):x}", lambda: f"{rng.randint(1, 99)}."]
    plain = [(1000 + i, f"{cases.words(rng, 5)} {kinds[i % 5]()} {cases.words(rng, 5)}") for i in range(600)]
    model = pii_crf.fit(spark.createDataFrame(pii_rows() + plain[:300], "doc_id long, text string"))
    held_out = spark.createDataFrame(plain[300:], "doc_id long, text string")
    assert pii_crf.personal_data(held_out, model).where("n_crf > 0").count() == 0


def test_crf_span_beside_a_base_match_of_its_kind(spark):
    texts = ["x a@b.com c@localhost y", "é 4012888888881881, 4012888888881882 y 😀", "c@localhost a@b.com d@localhost", "a@b.com"]
    model = pii_crf.Crf.zero()
    for word, kind in (("a@b.com", 0), ("c@localhost", 0), ("4012888888881881,", 2), ("4012888888881882", 2)):
        raw = np.frombuffer(word.encode(), np.uint8)
        model.emit[1][pii_crf.shapes(raw, np.array([0]), np.array([len(raw)])), kind + 1] = 5
    got = pii_crf.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["spans"] for r in got] == ["email:2:9,crf_email:10:21", "card:2:18,crf_card:20:36", "crf_email:0:11,email:12:19,crf_email:20:31", "email:0:7"]


def test_licences(spark):
    docs = cases.documents(spark)
    model = license_scan.fit(docs)
    rows = [(1, "Licensed under the Apache License, Version 2.0.\nabc def"), (2, "This work is licensed under the GNU General Public License, version 3."),
            (3, "The driver lost the license after a long trial.\nall words"), (4, None), (5, ""), (None, "All rights reserved."),
            (7, "text\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.")]
    got = sorted((r["doc_id"] or 0, r["families"], r["n_confirmed"]) for r in license_scan.scan_licences(
        spark.createDataFrame(rows, "doc_id long, text string"), model).collect())
    assert got == [(0, "proprietary", 1), (1, "apache-2.0", 1), (2, "gpl-3.0", 1), (3, "", 0), (4, "", 0), (5, "", 0), (7, "cc-by-nc,mit", 2)]
    out = license_scan.scan_licences(docs, model)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "hashpartitioning" not in plan
    assert out.where("n_confirmed > 0").count() == 1 and out.count() == len(cases.rows())
    assert license_scan.scan_licences(cases.empty(spark), model).count() == 0
    assert license_scan.fit(cases.empty(spark)).families[-1] == "unknown"


def test_licence_sample_is_not_read_by_one_task(spark, monkeypatch):
    plans = {}
    def kept(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, name)
    written = license_scan.written
    monkeypatch.setattr(license_scan, "written", kept)
    license_scan.fit(cases.documents(spark))
    assert "BroadcastHashJoin" in plans["licence-sample"] and "Coalesce 1" not in plans["licence-sample"]


def test_licences_calibrate_on_documents_of_one_line(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, cases.words(rng, 12)) for i in range(60)], "doc_id long, text string")
    model = license_scan.fit(docs)
    assert model.slope > 0.1 and abs(model.offset) < 50
    got = license_scan.scan_licences(spark.createDataFrame([(1, "Released under the MIT License."), (2, "the train was late")], "doc_id long, text string"), model)
    assert [(r["n_predicted"], r["families"]) for r in got.orderBy("doc_id").collect()] == [(1, "mit"), (0, "")]
