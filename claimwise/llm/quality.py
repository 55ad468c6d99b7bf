"""Operator 7: quality classifier, ordinal cumulative-link regression on graded ratings.

Grades: 0 toxic, 1 junk (quality 0), 2 clean.  One
hashed weight vector w is shared by all grades and ordered thresholds cut its
score: P(grade <= j) = sigmoid(theta_j - w.x).  A document gets its expected
grade and the tail probability P(grade = 2), by which it is selected.

Features of a whole text, all hashed to 2^22 places: each distinct word
(punctuation trimmed, A-Z lower-cased) and its leading 4 to 6 bytes, and the shares, in steps of a power of
two, of upper-case letters, digits, each kind of word ending, repeated lines
and words that repeat the one before.

Fitting: at most ``PER_GRADE`` labelled documents of each grade, those with the
smallest seeded hash of doc_id, weighted to the grades' shares among all
labels; the bound is a parameter and only the fit is bounded.  Scoring reads
every document whole and sends nothing but the weights (1 MB, fixed) to tasks.

Defined cases.  Null or empty text has only its length features and is scored
like any other.  Labels: a row without quality is left out, a null toxic counts
as 0, repeated rows count once, labels of unknown documents are not used.
Without labels of two grades every document gets grade 2 with probability 1.
Null doc_ids and repeated rows are scored like others; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (BYTE_KEYS, GOLD, LOWER_KEYS, TEXT_BYTES, WHITE, by_value, chunks, mix, prefix, range_hash, read, word_spans, written)

BITS = 22
PER_GRADE = 3000
KEEP_AT = 0.5               # tail probability from which a document is kept
STEMS = (4, 5, 6)           # leading bytes of longer words that are features too
STEPS, RATE, LASSO = 200, 0.05, 3e-5
SCALE = 0.25
TELLING = 4.0               # and how much more often one grade must hold it than another
LEAST_DOCS = 12             # training documents that a feature needs to get a weight

CORE = np.zeros(256, bool)
CORE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER | (np.arange(256) >= 97) & (np.arange(256) < 123)
DIGIT = (np.arange(256) >= 48) & (np.arange(256) < 58)


def _share(kind: int, some: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A feature for the share some / of, in steps of a power of two (0 is a step too)."""
    step = np.where(some > 0, 1 + np.floor(np.log2(np.maximum(some, 1) / np.maximum(of, 1)) + 12).clip(0, 12), 0).astype(np.uint64)
    return mix(np.uint64(kind) * GOLD + step)


def features(data: np.ndarray, off: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Feature places of each document and their n + 1 bounds, each place once a
    document; with ``only`` (a table of places) no others."""
    n = len(off) - 1
    starts, ends, bounds = word_spans(data, off)
    words = np.diff(bounds)
    count = lambda table: np.concatenate([[0], np.cumsum(table[data])])
    core = count(CORE)
    at = np.flatnonzero(CORE[data])
    some = core[ends] > core[starts]
    first = np.where(some, at[np.minimum(core[starts], len(at) - 1)] if len(at) else starts, ends)
    last = np.where(some, at[np.maximum(core[ends] - 1, 0)] + 1 if len(at) else starts, starts)
    lower, plain = prefix(LOWER_KEYS[data], 0), prefix(BYTE_KEYS[data], 0)
    word = range_hash(lower, first[some], last[some], 0)
    tail_of = np.flatnonzero(last < ends)
    tail = range_hash(plain, last[tail_of], ends[tail_of], 0)
    doc = np.repeat(np.arange(n), words)
    whole = range_hash(plain, starts, ends, 0)
    twice = np.zeros(len(whole), bool)          # a word that repeats the one before it
    twice[1:] = (whole[1:] == whole[:-1]) & (doc[1:] == doc[:-1])
    with np.errstate(over="ignore"):
        keys, docs = [word], [doc[some]]
        for k in STEMS:
            long = some & (last - first > k)
            keys.append(mix(range_hash(lower, first[long], first[long] + k, 0) + np.uint64(k)))
            docs.append(doc[long])
        # word endings by their share of the words
        order = np.lexsort((tail, doc[tail_of]))
        d, t = doc[tail_of][order], tail[order]
        new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])])) if len(d) else np.zeros(0, np.int64)
        if len(new):
            times = np.diff(np.append(new, len(d)))
            keys.append(mix(t[new] + _share(1, times, words[d[new]])))
            docs.append(d[new])
        letters = np.diff(count(LETTER)[off])
        size = np.diff(off)
        line = np.flatnonzero(data == 10)
        edge = np.unique(np.concatenate([off[:-1], line + 1, off[-1:]]))
        edge = edge[edge <= len(data)]
        if len(edge) > 1:
            h = range_hash(plain, edge[:-1], edge[1:], 0)
            of = np.searchsorted(off, edge[:-1], "right") - 1
            pair = np.lexsort((h, of))
            same = np.zeros(len(h), bool)
            same[1:] = (h[pair][1:] == h[pair][:-1]) & (of[pair][1:] == of[pair][:-1])
            again = np.bincount(of[pair], weights=same, minlength=n)
            lines = np.bincount(of, minlength=n)
        else:
            again, lines = np.zeros(n), np.zeros(n)
        for kind, (a, b) in enumerate([(np.diff(count(UPPER)[off]), letters), (np.diff(count(DIGIT)[off]), size), (letters, size),
                                       (np.diff(count(WHITE)[off]), size), (again, lines),
                                       (np.bincount(doc[twice], minlength=n), words), (words, np.ones(n))], 2):
            keys.append(_share(kind, np.asarray(a), np.asarray(b)))
            docs.append(np.arange(n))
    place = np.concatenate(keys) >> np.uint64(64 - BITS)
    doc = np.concatenate(docs)
    if only is not None:
        in_ = only[place]
        doc, place = doc[in_], place[in_]
    both = np.unique((doc.astype(np.uint64) << np.uint64(BITS)) | place)
    return (both & np.uint64((1 << BITS) - 1)).astype(np.int32), np.searchsorted(both, np.arange(n + 1, dtype=np.uint64) << np.uint64(BITS))


class Ordinal:
    """Cumulative-link (proportional odds) model with grades 0 .. len(cuts);
    weights for the given places, 0 for all others."""

    def __init__(self, places: np.ndarray, weights: np.ndarray, cuts: np.ndarray):
        self.places, self.weights, self.cuts = places, weights, cuts

    @classmethod
    def fit(cls, places: np.ndarray, bounds: np.ndarray, grade: np.ndarray, weight: np.ndarray, grades: int = 3) -> Ordinal:
        """By Adam on the weighted log likelihood with a lasso on the weights."""
        n = len(grade)
        rows = np.repeat(np.arange(n), np.diff(bounds))
        found, col, times = np.unique(places, return_inverse=True, return_counts=True)
        # share of each grade's sampled documents that hold a feature; what all grades hold alike says nothing
        held = np.stack([(np.bincount(col[grade[rows] == k], minlength=len(found)) + 0.5) / ((grade == k).sum() + 1)
                         for k in range(grades) if (grade == k).any()])
        often = np.flatnonzero((times >= min(LEAST_DOCS, max(1, n // 20))) & (held.max(0) >= TELLING * held.min(0)))
        new = np.full(len(found), -1)
        new[often] = np.arange(len(often))
        in_ = new[col] >= 0
        rows, col, dim = rows[in_], new[col[in_]], len(often)
        weight = weight / weight.sum()
        w, low, gaps = np.zeros(dim), np.array([-1.0]), np.zeros(grades - 2)
        state = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, low, gaps)]
        sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        for step in range(1, STEPS + 1):
            cuts = np.concatenate([low, low + np.cumsum(np.exp(gaps))])
            score = np.bincount(rows, weights=w[col], minlength=n) * SCALE
            full = np.concatenate([[-np.inf], cuts, [np.inf]])
            up, down = sig(full[grade + 1] - score), sig(full[grade] - score)
            p = np.maximum(up - down, 1e-9)
            du, dd = up * (1 - up), down * (1 - down)
            g_score = weight * (du - dd) / p                       # of -log p
            g_cut = np.zeros(grades - 1)
            np.add.at(g_cut, np.minimum(grade, grades - 2), np.where(grade < grades - 1, -weight * du / p, 0))
            np.add.at(g_cut, np.maximum(grade - 1, 0), np.where(grade > 0, weight * dd / p, 0))
            g_w = np.bincount(col, weights=g_score[rows] * SCALE, minlength=dim)
            g_low = np.array([g_cut.sum()])
            g_gaps = np.array([g_cut[j + 1:].sum() * np.exp(gaps[j]) for j in range(grades - 2)])
            for x, g, (m, v) in zip((w, low, gaps), (g_w, g_low, g_gaps), state, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                pace = RATE / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
                x -= pace * m / (1 - 0.9 ** step)
                if x is w:                                          # most words say nothing
                    np.copyto(w, np.sign(w) * np.maximum(0, np.abs(w) - pace * LASSO))
        some = np.flatnonzero(w)
        return cls(found[often][some].astype(np.int32), w[some].astype(np.float32), np.concatenate([low, low + np.cumsum(np.exp(gaps))]))

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.places] = self.weights
        return out

    def grades(self, data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, expected grade, probability of the highest grade) of each document."""
        places, bounds = features(data, off, table != 0)
        n = len(off) - 1
        score = np.bincount(np.repeat(np.arange(n), np.diff(bounds)), weights=table[places], minlength=n) * SCALE
        tail = 1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts[None, :], -35, 35)))
        return score, tail.sum(1), tail[:, -1]


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, data, off in chunks(batches, TEXT_BYTES):
        places, bounds = features(data, off)
        yield pa.RecordBatch.from_arrays([b.column("grade"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(places))],
                                         names=["grade", "places"])


def fit(docs: DataFrame, labels: DataFrame, per_grade: int = PER_GRADE) -> Ordinal | None:
    """The model fitted on the bounded sample; None without two grades."""
    by_value()
    grade = F.when(F.coalesce("toxic", F.lit(0)) == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    rated = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")) \
                  .groupBy("doc_id").agg(F.min("grade").alias("grade"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = rated.join(texts.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id", F.lit(7)))
    known = written(known, "quality-rated")
    totals = {r["grade"]: r["n"] for r in known.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return None
    sample = None
    for g in sorted(totals):
        part = known.where(F.col("grade") == g).orderBy("h", "doc_id").limit(per_grade)
        sample = part if sample is None else sample.unionByName(part)
    got = texts.join(F.broadcast(sample.select("doc_id", "grade")), "doc_id").orderBy("doc_id").select("grade", "text") \
               .mapInArrow(_featurize, "grade int, places array<int>").toArrow()
    places = got.column("places").combine_chunks()
    grades = got.column("grade").to_numpy()
    taken = np.bincount(grades, minlength=3)
    weight = np.array([totals.get(g, 0) / max(1, taken[g]) for g in range(3)])[grades]
    return Ordinal.fit(places.flatten().to_numpy(), places.offsets.to_numpy() - places.offsets[0].as_py(), grades, weight)


def score(docs: DataFrame, model: Ordinal | None, keep_at: float = KEEP_AT) -> DataFrame:
    """(doc_id, expected_grade, p_clean, kept) for every row of ``docs`` (doc_id, text)."""
    by_value()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if model is None else model.table()
        for b, data, off in chunks(batches, TEXT_BYTES):
            if model is None:
                expected, top = np.full(b.num_rows, 2.0), np.ones(b.num_rows)
            else:
                _, expected, top = model.grades(data, off, table)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(expected), pa.array(top), pa.array(top >= keep_at)],
                                             names=["doc_id", "expected_grade", "p_clean", "kept"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, expected_grade double, p_clean double, kept boolean")


def keep_clean(docs: DataFrame, model: Ordinal | None, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs``, all columns, that the model keeps; one pass, no shuffle."""
    by_value()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if model is None else model.table()
        for b, data, off in chunks(batches, TEXT_BYTES):
            yield b if model is None else b.filter(pa.array(model.grades(data, off, table)[2] >= keep_at))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))
