"""Operator 6: substring dedup of 50-word windows with a count-min prefilter.

A window is removed if its word sequence also starts in a document with a
smaller doc_id.

1. One pass over the texts.  A window's sketch key is its anchor, the smallest
   hash among the 25-word runs inside it: equal windows have equal anchors and
   neighbours mostly share one, so a text sends about one key per 13 windows.
   Every task sketches its blocks: the cells of both rows of the count-min
   sketch, as Golomb-Rice codes, with a bit where two documents of the block
   share a cell.
2. The sketch's cell ranges have owners, which merge the partition sketches and
   answer each block with the cells of total 2 or more.  An anchor whose
   estimate (the least of its cells) is 2 or more is kept with its documents.
   The sketch only overestimates, so no repeated window is lost.
3. Documents with such anchors are read again; exactly their windows of such
   anchors are grouped by a 128-bit hash of the word sequence, and a document
   loses those whose smallest doc_id is below its own.

Copies (equal word sequences) are one class: only its smallest doc_id takes
part in step 3, any other one of 50 words or more loses all its words.

Defined cases.  Null or empty text has no words; kept_sha256 is then that of the
empty text.  A null doc_id is below and above nothing: nothing is removed there
or because of it.  Rows that share a doc_id are one document: none of them
removes from another, each is cut for itself.  Empty tables give no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (GOLD, by_value, chunks, golomb, mix, prefix, range_hash, read, shuffle_partitions, ungolomb,
                     word_hashes, word_spans, written)

WINDOW, RUN = 50, 25
ROWS = 2                        # rows of the sketch
BLOCK_KEYS = 1 << 20            # anchors of a block, about
OWNER_CELLS = 1 << 22           # cells of an owner at most
BYTES_A_KEY = 64                # texts give about a key per 80 bytes
CELLS_A_KEY = 4
EMPTY = hashlib.sha256(b"").hexdigest()


class Sketch:
    """Where the cells of a key are, and who owns them."""

    def __init__(self, text_bytes: int, tasks: int):
        self.bits = max(16, (CELLS_A_KEY * text_bytes // BYTES_A_KEY).bit_length())
        self.owners = max(tasks // ROWS, (1 << self.bits) // OWNER_CELLS, 1)
        self.span = -(-(1 << self.bits) // self.owners)

    def cells(self, keys: np.ndarray, row: int) -> np.ndarray:
        return mix(keys + np.uint64((row + 1) * int(GOLD) % (1 << 64))) >> np.uint64(64 - self.bits)


class Text:
    """The words of a chunk of documents and the anchors of their windows."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data = data
        self.starts, self.ends, self.bounds = word_spans(data, off)
        self.hashes = word_hashes(data, self.starts, self.ends)
        self.p = prefix(self.hashes, 1)
        n = len(self.hashes)
        self.first = np.minimum(self.bounds[:-1], max(0, n - WINDOW + 1))       # windows of document d: first[d] .. last[d]
        self.last = np.maximum(self.first, self.bounds[1:] - WINDOW + 1)
        if n < WINDOW:
            self.anchors = np.zeros(0, np.uint64)
            return
        at = np.arange(n - RUN + 1)
        low = range_hash(self.p, at, at + RUN, 1)
        width, want = 1, WINDOW - RUN + 1
        while 2 * width <= want:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        self.anchors = np.minimum(low[:len(low) - (want - width)], low[want - width:])

    def sequence(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for the whole word sequence of each document."""
        p2 = prefix(mix(self.hashes + GOLD), 2)
        b = self.bounds
        return range_hash(self.p, b[:-1], b[1:], 1).view(np.int64), range_hash(p2, b[:-1], b[1:], 2).view(np.int64)

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p2 = prefix(mix(self.hashes + GOLD), 2)
        return range_hash(self.p, at, at + WINDOW, 1), range_hash(p2, at, at + WINDOW, 2)

    def digest(self, d: int, keep: np.ndarray | None = None) -> str:
        """SHA-256 of a document's words, or of the kept ones, joined by a space."""
        i, j = self.bounds[d], self.bounds[d + 1]
        if keep is None:
            return hashlib.sha256(b" ".join(self.data[self.starts[i]:self.ends[j - 1]].tobytes().split()) if j > i else b"").hexdigest()
        raw = self.data
        return hashlib.sha256(b" ".join(raw[self.starts[w]:self.ends[w]].tobytes() for w in range(i, j) if keep[w - i])).hexdigest()


SEEN = ("doc_id long, n_words long, s1 long, s2 long, sha string, block long, owner int, n int, code binary, again binary, "
        "keys binary, docs binary, ids binary, kind string")
NAMES = [x.split()[0] for x in SEEN.split(", ")]
TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _rows(count: int, kind: str, **cols) -> pa.RecordBatch:
    """A batch of SEEN with the given columns, the others null."""
    have = {"kind": [kind] * count} | cols
    types = [TYPES[x.split()[1]] for x in SEEN.split(", ")]
    return pa.RecordBatch.from_arrays([have[c] if isinstance(have.get(c), pa.Array) else pa.array(have[c], t) if c in have else pa.nulls(count, t)
                                       for c, t in zip(NAMES, types, strict=True)], names=NAMES)


def _sketch(sketch: Sketch):
    def block(no: int, keys: list, docs: list, ids: list) -> Iterator[pa.RecordBatch]:
        a, d = np.concatenate(keys), np.concatenate(docs)
        yield _rows(1, "keys", block=[no], keys=[a.tobytes()], docs=[d.astype(np.uint32).tobytes()], ids=[np.array(ids, np.int64).tobytes()])
        for row in range(ROWS):
            cells, times = np.unique(sketch.cells(a, row), return_counts=True)
            owner = (cells // np.uint64(sketch.span)).astype(np.int64)
            first = np.searchsorted(owner, np.arange(sketch.owners + 1))
            to = np.flatnonzero(np.diff(first))
            yield _rows(len(to), "cells", block=[no] * len(to), owner=[int(o) + row * sketch.owners for o in to], n=np.diff(first)[to].tolist(),
                        code=[golomb(cells[first[o]:first[o + 1]] - np.uint64(o * sketch.span), sketch.span) for o in to],
                        again=[np.packbits(times[first[o]:first[o + 1]] > 1).tobytes() for o in to])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, keys, docs, ids, held = TaskContext.get().partitionId() << 20, [], [], [], 0
        for b, data, off in chunks(batches):
            t = Text(data, off)
            s1, s2 = t.sequence()
            yield _rows(b.num_rows, "doc", doc_id=b.column("doc_id"), n_words=pa.array(np.diff(t.bounds)), s1=pa.array(s1), s2=pa.array(s2),
                        sha=[t.digest(d) for d in range(b.num_rows)])
            for d, i in enumerate(b.column("doc_id").to_pylist()):
                if i is not None and t.last[d] > t.first[d]:
                    own = np.unique(t.anchors[t.first[d]:t.last[d]])
                    keys.append(own)
                    docs.append(np.full(len(own), len(ids)))
                    ids.append(i)
                    held += len(own)
            if held >= BLOCK_KEYS:
                yield from block(no, keys, docs, ids)
                no, keys, docs, ids, held = no + 1, [], [], [], 0
        if ids:
            yield from block(no, keys, docs, ids)

    return run


def _merge(sketch: Sketch):
    """An owner's cells: the sum of all partition sketches, and each block's cells of 2 or more."""
    def run(messages: pd.DataFrame) -> pd.DataFrame:
        lists = [ungolomb(c, int(n), sketch.span).astype(np.int64) for c, n in zip(messages["code"], messages["n"])]
        total = np.zeros(sketch.span, np.uint8)
        for cells, again in zip(lists, messages["again"]):
            more = 1 + np.unpackbits(np.frombuffer(again, np.uint8), count=len(cells))
            total[cells] = np.minimum(total[cells] + more, 3)
        return pd.DataFrame({"block": messages["block"], "owner": messages["owner"],
                             "bits": [np.packbits(total[cells] >= 2).tobytes() for cells in lists]})

    return run


def _flagged(sketch: Sketch):
    """(doc_id, anchors) of the anchors that both rows of the sketch estimate at 2 or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                keys = np.frombuffer(b.column("keys")[i].as_py(), np.uint64)
                docs = np.frombuffer(b.column("docs")[i].as_py(), np.uint32)
                ids = np.frombuffer(b.column("ids")[i].as_py(), np.int64)
                replies = {r["owner"]: r["bits"] for r in b.column("replies")[i].as_py()}
                hot = np.ones(len(keys), bool)
                for row in range(ROWS):
                    cells, at = np.unique(sketch.cells(keys, row), return_inverse=True)
                    first = np.searchsorted(cells, np.arange(sketch.owners + 1, dtype=np.uint64) * np.uint64(sketch.span))
                    bits = np.zeros(len(cells), bool)
                    for o in np.flatnonzero(np.diff(first)):
                        n = int(first[o + 1] - first[o])
                        bits[first[o]:first[o + 1]] = np.unpackbits(np.frombuffer(replies[int(o) + row * sketch.owners], np.uint8), count=n)
                    hot &= bits[at]
                keys, docs = keys[hot], docs[hot]
                cut = np.searchsorted(docs, np.arange(len(ids) + 1))
                some = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array([keys[cut[d]:cut[d + 1]].tobytes() for d in some], pa.binary())],
                                                 names=["doc_id", "anchors"])

    return run


def candidate_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h1, h2): a document's distinct windows with a kept anchor."""
    for b, data, off in chunks(batches):
        t = Text(data, off)
        ids, anchors = b.column("doc_id").to_pylist(), b.column("anchors")
        at, who = [], []
        for d in range(b.num_rows):
            kept = np.frombuffer(b"".join(anchors[d].as_py()), np.uint64)
            w = t.first[d] + np.flatnonzero(np.isin(t.anchors[t.first[d]:t.last[d]], kept))
            at.append(w)
            who.append(np.full(len(w), d))
        who = np.concatenate(who)
        h1, h2 = t.windows(np.concatenate(at))
        order = np.lexsort((h2, h1, who))            # a window that repeats inside its document goes once
        who, h1, h2 = who[order], h1[order], h2[order]
        new = np.ones(len(who), bool)
        new[1:] = (who[1:] != who[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[who[new]]), pa.array(h1[new].view(np.int64)),
                                          pa.array(h2[new].view(np.int64))], names=["doc_id", "h1", "h2"])


def cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents without the words of their windows in ``gone``."""
    for b, data, off in chunks(batches):
        t = Text(data, off)
        s1, s2 = t.sequence()
        removed, sha, text = [], [], []
        for d in range(b.num_rows):
            i, j = t.bounds[d], t.bounds[d + 1]
            at = np.arange(t.first[d], t.last[d])
            h1 = range_hash(t.p, at, at + WINDOW, 1).view(np.int64)
            gone = np.flatnonzero(np.isin(h1, b.column("gone")[d].values.to_numpy()))
            edge = np.zeros(j - i + 1, np.int64)
            np.add.at(edge, gone, 1)
            np.add.at(edge, gone + WINDOW, -1)
            keep = np.cumsum(edge)[:-1] == 0
            removed.append(int((~keep).sum()))
            words = [data[t.starts[w]:t.ends[w]].tobytes() for w in i + np.flatnonzero(keep)]
            text.append(b" ".join(words).decode())
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s1), pa.array(s2), pa.array(removed, pa.int64()), pa.array(sha, pa.string()),
                                          pa.array(text, pa.string())], names=["doc_id", "s1", "s2", "n_removed", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) for every row of
    ``docs`` (doc_id, text); kept_text is null where nothing was removed."""
    by_value()
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    sketch = Sketch(int(size), shuffle_partitions(spark))
    seen = written(docs.mapInArrow(_sketch(sketch), SEEN), "repeats-seen", ["kind"])
    rows = seen.where("kind = 'doc'").select("doc_id", "n_words", "s1", "s2", "sha")
    replies = seen.where("kind = 'cells'").select("block", "owner", "n", "code", "again").groupBy("owner") \
                  .applyInPandas(_merge(sketch), "block long, owner int, bits binary")
    by_block = replies.groupBy("block").agg(F.collect_list(F.struct("owner", "bits")).alias("replies"))
    flagged = seen.where("kind = 'keys'").select("block", "keys", "docs", "ids").join(by_block, "block") \
                  .mapInArrow(_flagged(sketch), "doc_id long, anchors binary")
    classes = written(rows.where(f"n_words >= {WINDOW} and doc_id is not null").groupBy("s1", "s2")
                      .agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "repeats-classes")
    flagged = flagged.join(classes.select(F.col("least").alias("doc_id")).distinct(), "doc_id") \
                     .groupBy("doc_id").agg(F.collect_list("anchors").alias("anchors"))
    texts = written(docs.join(flagged, "doc_id"), "repeats-texts")
    found = written(texts.mapInArrow(candidate_windows, "doc_id long, h1 long, h2 long"), "repeats-windows")
    owners = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    gone = found.join(owners.select("h1", "h2", "least"), ["h1", "h2"]).where("doc_id > least") \
                .groupBy("doc_id").agg(F.collect_set("h1").alias("gone"))
    cut = texts.select("doc_id", "text").join(gone, "doc_id").mapInArrow(
        cut_words, "doc_id long, s1 long, s2 long, n_removed long, kept_sha256 string, kept_text string").dropDuplicates(["doc_id", "s1", "s2"])
    out = rows.join(classes.where("copies > 1").select("s1", "s2", "least"), ["s1", "s2"], "left").join(cut, ["doc_id", "s1", "s2"], "left")
    copy = (F.col("n_words") >= WINDOW) & (F.col("doc_id") > F.col("least"))
    return out.select("doc_id", "n_words",
                      F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                      F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
                      F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).drop("kept_text")


OP6_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least USING (h) WHERE doc_id > m),
stays AS (
  SELECT doc_id, p, w[p] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p)),
txt AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM stays GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN txt USING (doc_id)
"""
