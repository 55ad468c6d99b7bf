"""Operator 13: document fingerprints by quartile buckets.

Every byte triplet of a text (the bytes at places i, i + 2 and i + 5; past the end
a zero) is hashed to one of ``BUCKETS`` buckets and counted.  Two bits a bucket
say in which quartile of the text's own counts it lies (above the first, second,
third quartile); with eight times the binary logarithm of the length before it
that is the digest, ``DIGITS`` hex digits.  The spread triplets see across letters
of one syllable, which tells texts of one language apart better than adjacent ones.

The difference of two digests is the sum of the bucket differences over what the
same codes would give if they were dealt at random, plus ``LENGTH_COST`` for each
doubling in length, bounded by 1; likeness is 1 minus it: 1 for equal digests, about
0 for unrelated texts, long or short.

For the audit by edits (``edit_audit``) the documents are range-partitioned and
sorted by doc_id, texts shuffled once, compressed; a task walks its rows, holding one, and
compares each with the next.  The last row of a task meets the first row of the
next non-empty one in a small second step.

Defined cases.  A null or empty text is the empty text: all buckets zero, likeness 1
with another empty one, else 0.  Equal texts have equal fingerprints.  Null doc_ids come
last; of rows with one doc_id the order is that of a hash of the text, so equal rows
are next to each other.  A single document is its own next one; an empty table
gives no rows.  Texts of any length count whole; other columns are not read.
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

from .common import CHUNK_BYTES, GOLD, by_value, chunks, mix, read, written

BUCKETS = 512
PLACES = (0, 2, 5)                   # a triplet's bytes
LENGTH_COST = 0.1
DIGITS = 2 + BUCKETS // 2
# tabulation hashing: a random bucket number per place and byte, combined by exclusive or
TABLES = (mix(np.arange(1, 769, dtype=np.uint64) * GOLD) % np.uint64(BUCKETS)).astype(np.int64).reshape(3, 256)
AT_ONCE = 1 << 12                    # texts counted at once: 4,096 x 512 counters
SIZE_STEPS = 8


def digests(texts: list[bytes]) -> np.ndarray:
    """One row a text: its length code and the quartile codes (0 to 3) of its buckets."""
    out = np.zeros((len(texts), 1 + BUCKETS), np.uint8)
    tail = bytes(PLACES[-1])
    for i in range(0, len(texts), AT_ONCE):
        part = texts[i:i + AT_ONCE]
        n = np.array([len(t) for t in part], np.int64)
        data = np.frombuffer(b"".join(t + tail for t in part) + tail, np.uint8)
        doc = np.repeat(np.arange(len(part)), n)
        at = np.arange(len(doc)) + doc * len(tail)
        bucket = TABLES[0][data[at]]
        for k in (1, 2):
            bucket ^= TABLES[k][data[at + PLACES[k]]]
        counts = np.bincount(doc * BUCKETS + bucket, minlength=len(part) * BUCKETS).reshape(len(part), BUCKETS)
        cuts = np.sort(counts, axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
        out[i:i + len(part), 0] = np.minimum(255, np.rint(SIZE_STEPS * np.log2(1 + n)))
        out[i:i + len(part), 1:] = (counts[:, :, None] > cuts[:, None, :]).sum(2)
    return out


def to_hex(codes: np.ndarray) -> list[str]:
    bits = np.unpackbits(codes[:, 1:, None], axis=2)[:, :, 6:].reshape(len(codes), 2 * BUCKETS)
    return [bytes(r).hex() for r in np.concatenate((codes[:, :1], np.packbits(bits, axis=1)), axis=1)]


def from_hex(prints: list[str]) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex("".join(prints)), np.uint8).reshape(len(prints), DIGITS // 2)
    pairs = np.unpackbits(raw[:, 1:], axis=1).reshape(len(prints), BUCKETS, 2)
    return np.concatenate((raw[:, :1], 2 * pairs[:, :, 0] + pairs[:, :, 1]), axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, 0 to 1, of two arrays of digests."""
    x, y = a[:, 1:].astype(np.int16), b[:, 1:].astype(np.int16)
    apart = np.abs(x - y).mean(axis=1)
    share = [np.stack([(z == v).mean(axis=1) for v in range(4)]) for z in (x, y)]
    chance = sum(abs(v - w) * share[0][v] * share[1][w] for v in range(4) for w in range(4))
    body = np.divide(apart, chance, out=np.where(apart > 0, 1.0, 0.0), where=chance > 0)
    size = np.abs(a[:, 0].astype(np.int16) - b[:, 0].astype(np.int16)) / SIZE_STEPS
    empty = (a[:, 0] == 0) != (b[:, 0] == 0)
    return np.where(empty, 0.0, 1.0 - np.minimum(1.0, body + LENGTH_COST * size))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, fingerprint): one scan, no shuffle."""
    by_value()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, off in chunks(batches):
            raw = data.tobytes()
            prints = to_hex(digests([raw[s:e] for s, e in zip(off[:-1], off[1:], strict=True)]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fingerprint string")


def compare(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``pairs`` with the likeness of two fingerprint columns (null where one is null)."""
    by_value()

    def run(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in frames:
            both = (x.notna() & y.notna()).to_numpy()
            out = pd.Series([None] * len(x), dtype="object")
            if both.any():
                out[both] = likeness(from_hex(x[both].tolist()), from_hex(y[both].tolist()))
            yield out.astype("float64")

    return pairs.withColumn("likeness", F.pandas_udf(run, "double")(a, b))


WALKED = ("kind string, task int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, text string")
NAMES = [x.split()[0] for x in WALKED.split(", ")]
RESULT = NAMES[2:-1]


def _compared(ids: list, texts: list[str], codes: np.ndarray, task: int) -> pa.RecordBatch:
    """Result rows of all but the last of consecutive documents."""
    n = len(texts) - 1
    edited = [(t[:len(t) - len(t) // 4] + texts[i + 1][:len(t) // 4]).encode() for i, t in enumerate(texts[:n])]
    after = digests(edited)
    return pa.RecordBatch.from_arrays([
        pa.array(["done"] * n), pa.array(np.full(n, task, np.int32)), pa.array(ids[:n], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()),
        pa.array([hashlib.sha256(t).hexdigest() for t in edited]), pa.array(to_hex(codes[:n])), pa.array(to_hex(after)),
        pa.array(likeness(codes[:n], after)), pa.array(likeness(codes[:n], codes[1:])), pa.nulls(n, pa.string())], names=NAMES)


CODEC = "zstd"
PACKED = "doc_id long, h long, size long, packed binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one: less to shuffle than the shuffle's own codec leaves."""
    codec = pa.Codec(CODEC)
    for b, data, off in chunks(batches):
        raw = data.tobytes()
        packed = [codec.compress(raw[s:e], asbytes=True) for s, e in zip(off[:-1], off[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(np.diff(off), pa.int64()), pa.array(packed, pa.binary())],
                                         names=["doc_id", "h", "size", "packed"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """(doc_ids, texts) of at most ``CHUNK_BYTES`` of text, or of one row."""
    codec = pa.Codec(CODEC)
    for b in batches:
        off = np.concatenate(([0], np.cumsum(b.column("size").to_numpy())))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_BYTES, "right")) - 1)
            part = b.slice(i, j - i)
            sizes, packed = part.column("size").to_pylist(), part.column("packed").to_pylist()
            yield part.column("doc_id").to_pylist(), [codec.decompress(p, n, asbytes=True) if n else b"" for p, n in zip(packed, sizes, strict=True)]
            i = j


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, held, first = TaskContext.get().partitionId(), None, None
    for ids, own in _unpack(batches):
        texts, codes = [t.decode() for t in own], digests(own)
        if held is None:
            first = (ids[0], texts[0])
        else:
            ids, texts, codes = [held[0], *ids], [held[1], *texts], np.concatenate((held[2], codes))
        if len(ids) > 1:
            yield _compared(ids, texts, codes, task)
        held = ids[-1], texts[-1], codes[-1:]
    if held is not None:
        ends = [("head", *first), ("last", *held[:2])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _, _ in ends]), pa.array([task, task], pa.int32()), pa.array([i for _, i, _ in ends], pa.int64()),
             pa.nulls(2, pa.int64()), pa.nulls(2, pa.string()), pa.nulls(2, pa.string()), pa.nulls(2, pa.string()), pa.nulls(2, pa.float64()),
             pa.nulls(2, pa.float64()), pa.array([t for _, _, t in ends])], names=NAMES)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, next_text) as results."""
    for b in batches:
        for i in range(b.num_rows):
            texts = [b.column("text")[i].as_py(), b.column("next_text")[i].as_py()]
            ids = [b.column("doc_id")[i].as_py(), None]
            yield _compared(ids, texts, digests([t.encode() for t in texts]), 0).select(RESULT)


def edit_audit(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its fingerprint, that of the text
    whose last quarter is replaced by the start of the next document, and likenesses."""
    by_value()
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    packed = rows.withColumn("h", F.xxhash64("text")).mapInArrow(_pack, PACKED)
    order = [F.asc_nulls_last("doc_id"), F.asc("h")]
    walked = written(packed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_walk, WALKED), "prints-walked", ["kind"])
    head = walked.where("kind = 'head'").select("task", F.col("text").alias("next_text"))
    tasks = sorted(r["task"] for r in head.select("task").collect())          # one number a task
    follows = spark.createDataFrame(list(zip(tasks, tasks[1:] + tasks[:1], strict=True)), "at int, task int")
    last = walked.where("kind = 'last'").select(F.col("task").alias("at"), "doc_id", "text")
    ends = last.join(follows, "at").join(head, "task").select("doc_id", "text", "next_text")
    types = ", ".join(x for x in WALKED.split(", ") if x.split()[0] in RESULT)
    return walked.where("kind = 'done'").select(*RESULT).unionByName(ends.mapInArrow(_meet, types))


def op13_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edit_audit(read(spark, sf_dir, "documents"))
