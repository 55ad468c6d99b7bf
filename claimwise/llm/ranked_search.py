"""Operator 11: ranked lexical search of every document for every item, reversed.

The items are the small side, so they are indexed and the documents stream by:

1. The items' terms become postings (item, term, repeats).  Items are dealt to
   blocks of at most ``BLOCK_POSTINGS`` postings on average (a block holds whole
   items); one block's inverted index is what a task gets by broadcast, and a
   larger set of items takes more passes, never a larger broadcast.
2. First pass over the texts: a task cuts a batch into terms, looks their hashes
   up in the index (a hit counts when the bytes agree) and writes one row of
   (term, occurrences) per document, plus its own share of the corpus counts:
   documents with a term, all terms, documents per indexed term.
3. Second pass over those rows, not the texts: each document's counts go through
   the index, term by term, into integer scores, and a task keeps a heap of the
   ``k`` best per item.  The heaps of all tasks are merged in two levels, so an
   item's merge grows with the root of the number of tasks.

Every document is scored for every item that shares a term with it; nothing is
skipped or estimated, the heap bound is the feature.  Scores are 64-bit integers.

Defined cases.  A null or empty text has no terms: such a document counts
nowhere, such an item has no rows.  Documents with equal scores rank by
doc_id, a null one last; a repeated row is a document of its own, and a repeated
item gets rows of its own.  An empty table on either side gives no rows.  A text
of any length is one row of counts; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, LOWER_KEYS, by_value, chunks, prefix, range_hash, read, written

BEST = 20                      # documents an item gets
BLOCK_POSTINGS = 2_000_000     # (item, term) pairs whose index is broadcast at once: some 60 MB
CELLS = 1 << 21                # scores (or postings visited) held at once in a task

TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
IN_TERM = np.zeros(256, bool)  # the same class on UTF-8 bytes: ASCII letters and digits, all else beyond ASCII
IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
UPPER_CASE, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = LOWER.astype(np.uint8)


def term_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the terms and, per document, the offsets into them."""
    edge = np.zeros(len(data) + 1, bool)
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = IN_TERM[data]
    edge[off] = True                                             # a document starts anew
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    return starts, ends, np.searchsorted(starts, off)


class Index:
    """The inverted index of one block of items: terms in hash order, and per
    term the items that hold it with their repeats."""

    def __init__(self, items: np.ndarray, item_ids: np.ndarray, terms: list[bytes], reps: np.ndarray):
        self.items, first, item = np.unique(items, return_index=True, return_inverse=True)
        self.item_ids = item_ids[first]                          # float-free: object array, null as None
        words = sorted(set(terms))
        raw, cut = np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])
        for self.which in range(3):                              # a base that keeps all terms apart
            hashes = range_hash(prefix(LOWER_KEYS[raw], self.which), cut[:-1], cut[1:], self.which)
            order = np.argsort(hashes)
            if len(np.unique(hashes)) == len(words):
                break
        else:
            raise RuntimeError("no hash keeps the terms of this block apart")
        self.hashes, self.size = hashes[order], np.diff(cut)[order]
        self.raw, self.at = raw, cut[:-1][order]
        place = {w: i for w, i in zip((words[o] for o in order), range(len(words)), strict=True)}
        term = np.array([place[t] for t in terms], np.int64)
        by = np.argsort(term, kind="stable")
        self.item, self.reps = item[by].astype(np.int64), reps[by].astype(np.int64)
        self.first = np.searchsorted(term[by], np.arange(len(words) + 1))

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the spans that are indexed terms, their terms)."""
        h = range_hash(prefix(LOWER_KEYS[data], self.which), starts, ends, self.which)
        t = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[t] == h) & (self.size[t] == ends - starts))
        t = t[hit]
        n = self.size[t]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        wrong = LOWERED[data[inner + np.repeat(starts[hit], n)]] != self.raw[inner + np.repeat(self.at[t], n)]
        if wrong.any():                                          # equal hashes, other bytes
            good = np.ones(len(hit), bool)
            good[np.repeat(np.arange(len(hit)), n)[wrong]] = False
            hit, t = hit[good], t[good]
        return hit, t


COUNTED = ("kind string, doc_id long, n long, docs long, terms array<int>, tfs array<long>")


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values, kind))


def _count(shared):
    def row(kind, ids, n, docs, terms, tfs) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(ids)), ids, pa.array(n, pa.int64()), pa.array(docs, pa.int64()), terms, tfs],
                                          names=["kind", "doc_id", "n", "docs", "terms", "tfs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, docs, total = shared.value, 0, 0
        df = np.zeros(len(index.hashes), np.int64)
        for b, data, off in chunks(batches):
            starts, ends, bounds = term_spans(data, off)
            n = np.diff(bounds)
            docs, total = docs + int((n > 0).sum()), total + int(n.sum())
            span, term = index.find(data, starts, ends)
            if not len(span):
                continue
            doc = np.searchsorted(bounds, span, "right") - 1
            pair, tf = np.unique(doc * len(df) + term, return_counts=True)
            doc, term = pair // len(df), pair % len(df)
            df += np.bincount(term, minlength=len(df))
            rows, k = np.unique(doc, return_counts=True)
            yield row("doc", b.column("doc_id").take(pa.array(rows)), n[rows], np.ones(len(rows), np.int64),
                      _lists(term.astype(np.int32), k, pa.int32()), _lists(tf, k, pa.int64()))
        held = np.flatnonzero(df)
        yield row("share", pa.nulls(1, pa.int64()), [total], [docs], _lists(held.astype(np.int32), [len(held)], pa.int32()),
                  _lists(df[held], [len(held)], pa.int64()))

    return run


class Heaps:
    """The best ``k`` (score, doc_id) of each of ``n`` items, kept sorted."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.item = self.score = self.doc = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)
        self.least, self.last = np.ones(n, np.int64), np.full(n, np.iinfo(np.int64).max)   # worst score and doc_id of a full heap

    def offer(self, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        """``scores``: documents x items."""
        row, item = np.nonzero((scores > self.least) | ((scores == self.least) & (doc[:, None] <= self.last)))
        if not len(row):
            return
        item, score = np.concatenate((self.item, item)), np.concatenate((self.score, scores[row, item]))
        doc, null = np.concatenate((self.doc, doc[row])), np.concatenate((self.null, null[row]))
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        first = np.searchsorted(item, np.arange(self.n + 1))
        place = np.arange(len(item)) - first[item]
        keep = place < self.k
        order, self.item, place = order[keep], item[keep], place[keep]
        self.score, self.doc, self.null = score[order], doc[order], null[order]
        full = place == self.k - 1
        self.least[self.item[full]] = self.score[full]
        self.last[self.item[full]] = self.doc[full]


BESTS = "item long, item_id long, doc_id long, score long, task int"


def _score(shared, weights: np.ndarray, docs: int, total: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, task = shared.value, TaskContext.get().partitionId()
        heaps = Heaps(len(index.items), k)
        postings = np.diff(index.first)
        for b in batches:
            ids, terms, tfs = b.column("doc_id"), b.column("terms"), b.column("tfs").flatten().to_numpy()
            cut = terms.offsets.to_numpy().astype(np.int64)
            cut, terms = cut - cut[0], terms.flatten().to_numpy()
            null = ids.is_null().to_numpy(zero_copy_only=False)
            doc = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
            m = 75 + 25 * b.column("n").to_numpy() * docs // total
            visits = np.concatenate(([0], np.cumsum(postings[terms])))[cut]
            i = 0
            while i < len(doc):                  # documents whose scores and visits stay within bounds, one at least
                j = min(i + max(1, CELLS // heaps.n), max(i + 1, int(np.searchsorted(visits, visits[i] + CELLS, "right")) - 1))
                j = min(j, len(doc))
                at = slice(cut[i], cut[j])
                row = np.repeat(np.arange(j - i), np.diff(cut[i:j + 1]))
                t, tf = terms[at], tfs[at]
                part = weights[t] * (1_000_000_000 * tf // (1000 * tf + 12 * m[i:j][row]))
                n = postings[t]
                place = np.arange(int(n.sum())) + np.repeat(index.first[t] - np.cumsum(n) + n, n)
                scores = np.zeros((j - i) * heaps.n, np.int64)
                np.add.at(scores, np.repeat(row, n) * heaps.n + index.item[place], np.repeat(part, n) * index.reps[place])
                heaps.offer(scores.reshape(j - i, heaps.n), doc[i:j], null[i:j])
                i = j
        yield pa.RecordBatch.from_arrays([
            pa.array(index.items[heaps.item], pa.int64()), pa.array(index.item_ids[heaps.item], pa.int64()),
            pa.array(heaps.doc, pa.int64(), mask=heaps.null), pa.array(heaps.score, pa.int64()),
            pa.array(np.full(len(heaps.item), task, np.int32))], names=["item", "item_id", "doc_id", "score", "task"])

    return run


def _best(rows: DataFrame, keys: list, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _one_block(postings: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The merged heaps of the items in ``postings`` (bounded, see ``rank_documents``)."""
    spark = docs.sparkSession
    t = postings.toArrow()
    index = spark.sparkContext.broadcast(Index(t["item"].to_numpy(), np.array(t["item_id"].to_pylist(), object),
                                               [x.encode() for x in t["term"].to_pylist()], t["reps"].to_numpy()))
    counted = written(docs.mapInArrow(_count(index), COUNTED), "ranked-counts", ["kind"])
    share = counted.where("kind = 'share'")
    n = share.agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).first()
    if not n["total"]:
        return spark.createDataFrame([], BESTS + ", rank int")
    df = share.select(F.explode(F.arrays_zip("terms", "tfs")).alias("s")).groupBy("s.terms").agg(F.sum("s.tfs").alias("df")).toArrow()
    held = np.zeros(len(index.value.hashes), np.int64)
    held[df["terms"].to_numpy()] = df["df"].to_numpy()
    weights = np.array([math.floor(1000 * math.log((2 * n["docs"] + 2) / (2 * x + 1))) for x in held.tolist()], np.int64)
    rows = counted.where("kind = 'doc'").select("doc_id", "n", "terms", "tfs")
    bests = written(rows.mapInArrow(_score(index, weights, n["docs"], n["total"], k), BESTS), "ranked-bests")
    tasks = bests.agg(F.max("task").alias("n")).first()["n"]
    fan = math.isqrt(tasks or 0) + 1
    return _best(_best(bests, ["item", F.pmod("task", F.lit(fan))], k), ["item"], k)


def rank_documents(items: DataFrame, docs: DataFrame, k: int = BEST, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best rows of ``docs`` (doc_id,
    text) for each row of ``items`` (item_id, text)."""
    by_value()
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    terms = F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER_CASE, LOWER_CASE), F.lit(TERMS), F.lit(0))
    rows = written(items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), terms.alias("terms")),
                   "ranked-items")
    postings = written(rows.select("item", "item_id", F.explode("terms").alias("term")).groupBy("item", "item_id", "term")
                       .agg(F.count(F.lit(1)).alias("reps")), "ranked-postings")
    blocks = -(-postings.count() // block_postings)
    mine = lambda b: postings.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
    found = [_one_block(mine(b), docs, k) for b in range(blocks) if mine(b).limit(1).count()]
    if not found:
        found = [spark.createDataFrame([], BESTS + ", rank int")]
    return reduce(DataFrame.unionByName, found).select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    return rank_documents(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
i AS (
  SELECT row_number() OVER () AS item, item_id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT item, item_id, term, count(*) AS reps FROM i GROUP BY ALL),
c AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, c
      WHERE term IN (SELECT term FROM p) GROUP BY term, n_docs),
m AS (SELECT r, doc_id, 100 - 25 + ((25 * len(t) * n_docs) // n_terms) AS m FROM d, c WHERE len(t) > 0),
s AS (SELECT item, item_id, r, doc_id, sum(reps * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM p JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= 20
"""
