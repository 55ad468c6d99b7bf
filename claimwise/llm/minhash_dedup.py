"""Operator 1: near-duplicate groups by SuperMinHash, banding, verification on
full shingle sets and union-find.

* A document's set: its distinct 5-word shingles (words ``[^\\x20\\x09-\\x0D]+``,
  A-Z lower-cased; fewer words make one shingle, none an empty set).
* SuperMinHash: every element ranks the m slots by its own random
  permutation; a slot's value is the smallest ``rank + u`` over the elements.
  Ranks are handled level by level for all elements of many documents at
  once, and a document leaves as soon as all its slots are filled: no later
  rank could lower one (the early stop).
* Equal sets become one class, represented by its smallest doc_id.
* Banding: 32 bands of 4 slots; a pair at similarity 0.75 meets in no band
  with probability 5e-6.
* Verification without all pairs: in every bucket the smallest member (the
  hub) is checked against the others and links are joined by union-find, which
  settles copies and most near copies.  Buckets that still hold several
  components get some more hubs, picked by hash.  What then still does (documents around one common passage, say) goes on to an exact
  residue: shingles of their members are ordered by frequency, a pair can only
  reach the similarity if it shares one of the rarest quarter of both, and the
  places of the first shared one bound the overlap.  Only pairs of different
  components within that bound are verified.  A pair left out is either in one
  component already or below the similarity, so no link that matters is lost.

Defined cases.  Null or empty text, or no word: empty set, in no group, and
component_id is its own doc_id.  A null doc_id: n_shingles is counted, it links
with nothing, component_id null, kept false.  Rows with one doc_id are one
node: it links whatever any of its texts links.  An empty table gives no rows.
Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import (GOLD, TEXT_BYTES, by_value, chunks, flat, if_small, mix, own_names, read, windows, word_hashes, word_spans, written)
from .components import components

SLOTS, ROWS = 128, 4
BANDS = SLOTS // ROWS
MORE_HUBS = 6     # hubs by hash in buckets of several components
MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(data: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and their n + 1 bounds."""
    starts, ends, bounds = word_spans(data, off)
    hashes = word_hashes(data, starts, ends, lower=True)
    at, full = windows(hashes, bounds, k)
    cut = np.searchsorted(at, bounds)
    n_words, parts, sizes = np.diff(bounds), [], np.zeros(len(off), np.int64)
    for d in range(len(off) - 1):
        if n_words[d] >= k:
            e = np.unique(full[cut[d]:cut[d + 1]])
        elif n_words[d]:
            e = mix(np.array([sum((i + 2) * int(x) for i, x in enumerate(hashes[bounds[d]:bounds[d + 1]])) % (1 << 64)], np.uint64))
        else:
            continue
        parts.append(e)
        sizes[d + 1] = len(e)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(sizes)


def superminhash(elements: np.ndarray, bounds: np.ndarray, m: int = SLOTS) -> np.ndarray:
    """Signatures (documents x m): level in the high half, random part in the low half."""
    n = len(bounds) - 1
    sig = np.full(n * m, MOST, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    e, perm = elements, None
    for level in range(m):
        x = mix(e + np.uint64((level + 1) * int(GOLD) % (1 << 64)))
        pick = (level + ((x >> np.uint64(32)) * np.uint64(m - level) >> np.uint64(32)).astype(np.int64))
        value = np.uint64(level << 32) | (x & np.uint64(0xFFFFFFFF))
        if perm is None:
            slot = pick
        else:
            rows = np.arange(len(e))
            slot = perm[rows, pick].astype(np.int64)
            perm[rows, pick] = perm[rows, level]
        np.minimum.at(sig, doc * m + slot, value)
        open_docs = (sig.reshape(n, m) == MOST).any(1)
        stay = open_docs[doc]
        if not stay.any():
            break
        if perm is None:
            e, doc, pick = e[stay], doc[stay], pick[stay]
            perm = np.tile(np.arange(m, dtype=np.uint16), (len(e), 1))
            perm[np.arange(len(e)), pick] = 0
        elif stay.mean() < 0.7:
            e, doc, perm = e[stay], doc[stay], perm[stay]
    return sig.reshape(n, m)


SIGNED = "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>"


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: set size, 128-bit fingerprint of the set, band hashes."""
    for b, data, off in chunks(batches, TEXT_BYTES):
        e, bounds = shingles(data, off)
        size = np.diff(bounds)
        sig = superminhash(e, bounds)
        bands = sig.reshape(len(size), BANDS, ROWS)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLD, (len(size), BANDS)).copy()
        for r in range(ROWS):
            key = mix(key + bands[:, :, r] * np.uint64(0x9E3779B97F4A7C15))
        sums = []
        for salt in (1, 2):
            p = np.zeros(len(e) + 1, np.uint64)
            np.cumsum(mix(e + np.uint64(salt)), out=p[1:])
            sums.append(mix((p[bounds[1:]] - p[bounds[:-1]]) + size.astype(np.uint64)).view(np.int64))
        some = size > 0
        yield pa.RecordBatch.from_arrays([
            b.column("doc_id").cast(pa.int64()), pa.array(size), pa.array(sums[0]), pa.array(sums[1]),
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)),
                                     pa.array(key[some].ravel().view(np.int64)))],
            names=["doc_id", "n_shingles", "fp1", "fp2", "bands"])


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets have 100 * intersection >= 75 * union."""
    for b in batches:
        da, oa = flat(b.column("ta"))
        db, ob = flat(b.column("tb"))
        hit, i, n = np.zeros(b.num_rows, bool), 0, b.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(oa + ob, oa[i] + ob[i] + 2 * TEXT_BYTES, "right")) - 1)
            j = min(j, n)
            sa, ba = shingles(da[oa[i]:oa[j]], oa[i:j + 1] - oa[i])
            sb, bb = shingles(db[ob[i]:ob[j]], ob[i:j + 1] - ob[i])
            for r in range(j - i):
                x, y = sa[ba[r]:ba[r + 1]], sb[bb[r]:bb[r + 1]]
                if 100 * min(len(x), len(y)) >= 75 * max(len(x), len(y)) > 0:
                    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                    both = int((x[at] == y).sum())
                    hit[i + r] = 100 * both >= 75 * (len(x) + len(y) - both)
            i = j
        keep = pa.array(hit)
        yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])


def links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The verified ones of the pairs (a, b); the text of a node travels to
    its pairs by two equi-joins, whose hot hubs Spark splits by size."""
    ta = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(ta, "a").join(tb, "b").mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    by_value()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(docs.mapInArrow(sign, SIGNED), "minhash-signed")
    named = signed.where("n_shingles > 0 and doc_id is not null")
    classes = named.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n_rows"))
    first = named.join(classes.select("fp1", "fp2", F.col("node").alias("doc_id")), ["fp1", "fp2", "doc_id"]) \
                 .dropDuplicates(["fp1", "fp2", "doc_id"])
    entries = first.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"))
    shared = entries.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi")
    members = written(entries.join(shared.select("bucket"), "bucket"), "minhash-members")

    # a doc_id with several different texts is one node: its classes are linked through it
    several = named.groupBy("doc_id").agg(F.min(F.struct("fp1", "fp2")).alias("x"), F.max(F.struct("fp1", "fp2")).alias("y")) \
                   .where("x != y").select("doc_id")
    found = written(named.join(several, "doc_id").join(classes, ["fp1", "fp2"])
                    .select(F.col("doc_id").alias("a"), F.col("node").alias("b")), "minhash-links")
    wanted = written(members.select(F.col("node").alias("doc_id")).distinct(), "minhash-wanted")
    texts = written(docs.join(if_small(wanted), "doc_id", "left_semi"), "minhash-texts")

    found = written(found.unionByName(links(_hub_pairs(members), texts)), "minhash-links")
    labels = components(found, "minhash")
    second = written(links(_more_hub_pairs(members, labels), texts), "minhash-links")
    if second.limit(1).count():
        found = found.unionByName(second)
        labels = components(found, "minhash")
    more = written(links(_residue_pairs(members, labels, texts), texts), "minhash-links")
    if more.limit(1).count():
        labels = components(found.unionByName(more), "minhash")

    rows = signed.select("doc_id", "n_shingles", "fp1", "fp2").join(
        classes.where("n_rows > 1").select("fp1", "fp2", "node"), ["fp1", "fp2"], "left")
    rows = rows.withColumn("node", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(),
                                          F.coalesce("node", "doc_id")).otherwise(F.col("doc_id")))
    out = rows.join(labels.withColumnRenamed("root", "comp"), "node", "left")
    comp = F.when(F.col("n_shingles") > 0, F.coalesce("comp", "node")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"),
                      F.coalesce(F.col("doc_id") == comp, F.lit(False)).alias("kept"))


def _hub_pairs(members: DataFrame) -> DataFrame:
    """Each bucket's smallest member with the others that its size allows."""
    hub = members.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("hub"))
    near = "node > hub.node and 100 * least(n, hub.n) >= 75 * greatest(n, hub.n)"
    return members.join(hub, "bucket").where(near).select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of the buckets that hold several components, with these."""
    now = members.join(labels, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("comp"))
    mixed = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi")
    return now.join(mixed.select("bucket"), "bucket")


def _more_hub_pairs(members: DataFrame, labels: DataFrame) -> DataFrame:
    """In buckets of several components, some members by hash with those of other components."""
    now = written(_labelled(members, labels), "minhash-mixed")
    hub = now.groupBy("bucket").agg(*[F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), "node", "n", "comp")).alias(f"h{i}") for i in range(MORE_HUBS)])
    each = now.join(hub, "bucket").select("node", "n", "comp", F.explode(F.array(*[f"h{i}" for i in range(MORE_HUBS)])).alias("hub"))
    near = each.where("comp != hub.comp and 100 * least(n, hub.n) >= 75 * greatest(n, hub.n)")
    return near.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()


def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of a node, a row each."""
    for b, data, off in chunks(batches, TEXT_BYTES):
        e, bounds = shingles(data, off)
        size = np.diff(bounds)
        at = np.repeat(np.arange(len(size)), size)
        yield pa.RecordBatch.from_arrays([pa.array(e.view(np.int64)), b.column("doc_id").take(pa.array(at)), pa.array(size[at])],
                                         names=["e", "node", "n"])


def _residue_pairs(members: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of different components in the buckets that hold several, by the
    prefix and position bounds of an overlap of 3/7 of both sizes."""
    live = written(_labelled(members, labels).select("node", "comp").distinct(), "minhash-live")
    rows = written(texts.join(live.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
                   .mapInArrow(elements, "e long, node long, n long").distinct(), "minhash-elements")
    often = rows.groupBy("e").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    w = Window.partitionBy("node", "n")
    # shingles of one document only come first in the order and make no pair
    rare = rows.join(often, "e").withColumn("later", F.count(F.lit(1)).over(w)) \
               .withColumn("at", F.col("n") - F.col("later") + F.row_number().over(w.orderBy("f", "e")) - 1) \
               .where("4 * at <= n").join(live, "node").select("e", "node", "n", "at", "comp")
    x = written(rare, "minhash-prefixes")
    y = x.select("e", *[F.col(c).alias("y_" + c) for c in ("node", "n", "at", "comp")])
    bound = "node < y_node and comp != y_comp and 7 * least(n - at, y_n - y_at) >= 3 * (n + y_n)"
    return x.join(y, "e").where(bound).select(F.col("node").alias("a"), F.col("y_node").alias("b")).distinct()


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one document of each near-duplicate group; null doc_ids stay."""
    gone = written(near_duplicates(docs).where("component_id != doc_id").select("doc_id").distinct(), "minhash-gone")
    own, at = own_names(docs)
    return own.join(if_small(gone), F.col(at["doc_id"]) == F.col("doc_id"), "left_anti").toDF(*docs.columns)


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


OP1_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y FROM both_have JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT x AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(y) AS component_id, x = min(y) AS kept
FROM reach LEFT JOIN n ON n.doc_id = x GROUP BY x
"""
