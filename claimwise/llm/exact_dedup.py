"""Operator 3: exact dedup by a Golomb-coded fingerprint exchange.

1. Every task reads its documents once, hashes each whole text (SHA-256) and
   cuts the digest to a fingerprint of log2(rows) + 12 bits.  The sorted
   distinct fingerprints of a block (one task, at most 2^18 rows) go to the
   owners of their ranges as Golomb-Rice codes, some 15 bits each.
2. An owner decodes its messages, finds the fingerprints that several blocks
   sent, and answers each message with a bitmap.  A text that fills a third of
   the table sends one fingerprint a block, so no owner is hot.
3. Documents whose bit is set, or that repeat inside their block, are suspects;
   only their texts are shuffled, grouped by digest and bytes.

Texts are compared as they are, a null as empty.  The row with the largest
doc_id stays (a null doc_id is the smallest; of rows equal in doc_id and text
one stays).  A digest whose texts differ in a byte is left ungrouped.  An empty
table gives no rows; other columns are not read.
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

from .common import by_value, flat, golomb, if_small, own_names, read, shuffle_partitions, ungolomb, written

BLOCK_ROWS = 1 << 18     # rows of a block at most
OWNER_ROWS = 1 << 20     # fingerprints of an owner on average, at most
SPARE_BITS = 12          # fingerprint bits beyond log2(rows): one false suspect in 4,096

SENT = ("rid long, doc_id long, sha binary, block long, owner int, at int, again boolean, n int, code binary, kind string")


class Ring:
    """Equal ranges of the fingerprints, one an owner."""

    def __init__(self, rows: int, owners: int):
        self.bits = min(62, max(1, rows).bit_length() + SPARE_BITS)
        self.owners = max(1, owners)
        self.span = -(-(1 << self.bits) // self.owners)

    def fingerprints(self, digests: bytes) -> np.ndarray:
        first = np.frombuffer(digests, ">u8").reshape(-1, 4)[:, 0].astype(np.uint64)
        return first >> np.uint64(64 - self.bits)


def _send(ring: Ring):
    def block(no: int, ids: list, digests: list) -> Iterator[pa.RecordBatch]:
        raw = b"".join(digests)
        fp, at, again = np.unique(ring.fingerprints(raw), return_inverse=True, return_counts=True)
        owner = (fp // np.uint64(ring.span)).astype(np.int64)
        first = np.searchsorted(owner, np.arange(ring.owners + 1))
        pos = np.arange(len(fp)) - first[owner]
        n = len(at)
        nulls = lambda k, t: pa.nulls(k, t)
        ids_col = pa.concat_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in ids])
        yield pa.RecordBatch.from_arrays([
            pa.array((no << 32) + np.arange(n)), ids_col, pa.array([raw[32 * i:32 * i + 32] for i in range(n)], pa.binary()),
            pa.array(np.full(n, no)), pa.array(owner[at].astype(np.int32)), pa.array(pos[at].astype(np.int32)),
            pa.array(again[at] > 1), nulls(n, pa.int32()), nulls(n, pa.binary()), pa.array(["doc"] * n)], names=NAMES)
        to = np.flatnonzero(np.diff(first))
        if len(to):
            codes = [golomb(fp[first[o]:first[o + 1]] - np.uint64(o * ring.span), ring.span) for o in to]
            k = len(to)
            yield pa.RecordBatch.from_arrays([
                nulls(k, pa.int64()), nulls(k, pa.int64()), nulls(k, pa.binary()), pa.array(np.full(k, no)),
                pa.array(to.astype(np.int32)), nulls(k, pa.int32()), nulls(k, pa.bool_()),
                pa.array(np.diff(first)[to].astype(np.int32)), pa.array(codes, pa.binary()), pa.array(["sent"] * k)], names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, ids, digests = TaskContext.get().partitionId() << 12, [], []
        for b in batches:
            data, off = flat(b.column("text"))
            raw = memoryview(np.ascontiguousarray(data))
            for i in range(0, b.num_rows, BLOCK_ROWS):
                j = min(b.num_rows, i + BLOCK_ROWS)
                if digests and len(digests) + j - i > BLOCK_ROWS:
                    yield from block(no, ids, digests)
                    no, ids, digests = no + 1, [], []
                ids.append(b.column("doc_id").slice(i, j - i))
                digests += [hashlib.sha256(raw[off[r]:off[r + 1]]).digest() for r in range(i, j)]
        if digests:
            yield from block(no, ids, digests)

    return run


NAMES = [x.split()[0] for x in SENT.split(", ")]


def _answer(ring: Ring):
    """An owner's replies: for each message the bits of what another block sent too."""
    def run(messages: pd.DataFrame) -> pd.DataFrame:
        lists = [ungolomb(c, int(n), ring.span) for c, n in zip(messages["code"], messages["n"])]
        seen, times = np.unique(np.concatenate(lists), return_counts=True)
        hot = seen[times > 1]
        rows = []
        for block, owner, fps in zip(messages["block"], messages["owner"], lists):
            bit = np.isin(fps, hot, assume_unique=True)
            if bit.any():
                packed = np.packbits(np.pad(bit, (0, -len(bit) % 64)), bitorder="little").view(np.int64)
                rows.append((block, owner, packed))
        return pd.DataFrame(rows, columns=["block", "owner", "bits"])

    return run


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs`` (doc_id, text)."""
    by_value()
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = docs.count()
    ring = Ring(rows, max(shuffle_partitions(spark), -(-rows // OWNER_ROWS)))
    sent = written(docs.mapInArrow(_send(ring), SENT), "exact-sent", ["kind"])
    all_docs = sent.where("kind = 'doc'").select("rid", "doc_id", "sha", "block", "owner", "at", "again")
    replies = sent.where("kind = 'sent'").select("block", "owner", "n", "code").groupBy("owner") \
                  .applyInPandas(_answer(ring), "block long, owner int, bits array<long>")
    bit = F.expr("shiftright(element_at(bits, cast(at div 64 + 1 as int)), at % 64) & 1") == 1
    suspects = all_docs.join(replies, ["block", "owner"], "left").where(F.col("again") | F.coalesce(bit, F.lit(False))) \
                       .select("rid", "doc_id", "sha")
    suspects = written(suspects, "exact-suspects")

    ids = written(suspects.select(F.col("doc_id").alias("id")).distinct(), "exact-ids")
    texts = docs.join(if_small(ids), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    bytes_ = texts.groupBy(F.unhex(F.sha2("text", 256)).alias("sha"), "text").agg(F.count(F.lit(1)).alias("copies"))
    same = bytes_.groupBy("sha").agg(F.count(F.lit(1)).alias("texts")).where("texts = 1").select("sha")
    groups = suspects.groupBy("sha").agg(F.max(F.struct("doc_id", "rid")).alias("top"), F.count(F.lit(1)).alias("size")) \
                     .where("size > 1").join(same, "sha", "left_semi")
    return all_docs.select("rid", "doc_id", "sha").join(groups, "sha", "left").select(
        "doc_id", F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).alias("group_size"),
        (F.col("size").isNull() | (F.col("rid") == F.col("top.rid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one row of each group of equal texts."""
    d = written(exact_duplicates(docs), "exact-decided")
    per = d.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n")).where("not stays or n > 1")
    per = written(per, "exact-gone")
    own, at = own_names(docs)
    i, text = F.col(at["doc_id"]), F.col(at["text"])
    same = i.cast("long").eqNullSafe(F.col("doc_id")) & (F.sha2(F.coalesce(text, F.lit("")), 256) == F.col("text_sha256"))
    out = own.join(if_small(per.where("not stays")), same, "left_anti")
    again = per.where("stays")
    if again.limit(1).count():      # rows equal in doc_id and text
        out = out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates([at["doc_id"], at["text"]]))
    return out.toDF(*docs.columns)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


OP3_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
