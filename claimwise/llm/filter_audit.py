"""Operator 12: filter interaction audit with a counting-Bloom duplicate prepass.

Five filters, one bit each: A few words, B few distinct words, C many capitals,
D special signs, E equal to the text of a smaller doc_id.

1. One scan of the whole texts sets bits A to D of a row and digests its text.
   Each block (one task, at most ``BLOCK_ROWS`` rows) counts its digests into a
   blocked counting Bloom filter: a digest picks the owner of a range of cells
   and ``HASHES`` cells in it; counters stop at two.
2. Blocks send owners the numbers of the cells they touched, Golomb-coded, with
   a bit for "twice".  An owner adds the sketches of its range up and answers
   each block with the cells that ended at two.  A text with a cell below two
   occurs once in the table for sure.
3. Only rows whose cells are all at two fetch and shuffle their whole texts: the
   least doc_id per text, a partial aggregate, so copies meet in a task once.
   Texts that hold over 1 / ``HEAVY`` of these rows are at most ``HEAVY`` many and
   find their rows by broadcast, the others by a shuffle on the digest.
4. Rows join into counts per (part, mask), and all 120 orders are sums over masks:
   a step removes what its filter fails and no earlier one does.

Defined cases.  A null text counts as empty (it fails A; all empty texts are
equal).  A null doc_id is no smaller one, has none and no labels.  Repeated rows each
count; E asks for a smaller doc_id, so rows equal in both do not fail each other.
A document is good (toxic) if any of its labels rows says so.  A null
source is the part ''.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, flat, golomb, read, shuffle_partitions, ungolomb, written

FILTERS = "ABCDE"
BLOCK_ROWS = 1 << 18     # rows of a block at most
OWNER_ROWS = 1 << 20     # rows whose cells one owner holds on average, at most
CELLS_A_ROW = 12         # cells of the sketch a row: with 4 hashes under 1 in 100 unique texts is fetched
HASHES = 4
HEAVY = 1000

CAPITALS = bytes(range(0x41, 0x5B))
SPECIAL = b"#$%&*|"
INNER = bytes(range(0x80, 0xC0))     # bytes that continue a code point


def mask(text: bytes) -> int:
    """Bits A to D of one whole text (UTF-8)."""
    words = text.split()             # on space and \\x09 to \\x0D
    points, capitals = len(text.translate(None, INNER)), len(text) - len(text.translate(None, CAPITALS))
    return ((len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * capitals > 5 * points) << 2
            | (len(text.translate(None, SPECIAL)) < len(text)) << 3)


class Cells:
    """The blocked counting Bloom filter: equal ranges of cells, one an owner."""

    def __init__(self, rows: int, owners: int):
        self.owners = max(1, owners)
        self.span = max(64, -(-max(1, rows) * CELLS_A_ROW // self.owners))

    def of(self, digests: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(owner, rows x HASHES cells inside its range) of SHA-256 digests."""
        word = np.frombuffer(digests, "<u8").reshape(-1, 4)
        step = word[:, 2] | np.uint64(1)
        cells = word[:, 1, None] + np.arange(HASHES, dtype=np.uint64)[None, :] * step[:, None]
        cells ^= cells >> np.uint64(29)
        return (word[:, 0] % np.uint64(self.owners)).astype(np.int64), (cells % np.uint64(self.span)).astype(np.int64)


SENT = ("kind string, rid long, doc_id long, part string, mask int, sha binary, block long, owner int, at array<int>, n int, "
        "code binary, twice binary")
NAMES = [x.strip().split()[0] for x in SENT.split(",")]


def _scan(sketch: Cells):
    def batch(kind: str, size: int, **cols) -> pa.RecordBatch:
        types = dict(rid=pa.int64(), doc_id=pa.int64(), part=pa.string(), mask=pa.int32(), sha=pa.binary(), block=pa.int64(), owner=pa.int32(),
                     at=pa.list_(pa.int32()), n=pa.int32(), code=pa.binary(), twice=pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([kind] * size)] + [cols.get(c, pa.nulls(size, types[c])) for c in NAMES[1:]], names=NAMES)

    def block(no: int, ids: list, parts: list, masks: list, digests: list) -> Iterator[pa.RecordBatch]:
        n = len(digests)
        owner, cells = sketch.of(b"".join(digests))
        # a row adds one to each of its different cells
        rows = np.unique(np.arange(n)[:, None] * sketch.span + cells)
        flat_cell, times = np.unique(owner[rows // sketch.span] * sketch.span + rows % sketch.span, return_counts=True)
        first = np.searchsorted(flat_cell, np.arange(sketch.owners + 1) * sketch.span)
        at = np.searchsorted(flat_cell, owner[:, None] * sketch.span + cells) - first[owner][:, None]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * HASHES), pa.array(at.ravel().astype(np.int32)))
        yield batch("doc", n, rid=pa.array((no << 32) + np.arange(n)), doc_id=pa.concat_arrays(ids), part=pa.concat_arrays(parts),
                    mask=pa.array(masks, pa.int32()), sha=pa.array(digests, pa.binary()), block=pa.array(np.full(n, no)),
                    owner=pa.array(owner.astype(np.int32)), at=lists)
        to = np.flatnonzero(np.diff(first))
        piece = [slice(first[o], first[o + 1]) for o in to]
        k = len(to)
        yield batch("cells", k, block=pa.array(np.full(k, no)), owner=pa.array(to.astype(np.int32)), n=pa.array(np.diff(first)[to].astype(np.int32)),
                    code=pa.array([golomb(flat_cell[p] - o * sketch.span, sketch.span) for o, p in zip(to, piece, strict=True)], pa.binary()),
                    twice=pa.array([np.packbits(times[p] > 1).tobytes() for p in piece], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, ids, parts, masks, digests = TaskContext.get().partitionId() << 12, [], [], [], []
        for b in batches:
            data, off = flat(b.column("text"))
            raw = data.tobytes()
            for i in range(0, b.num_rows, BLOCK_ROWS):
                j = min(b.num_rows, i + BLOCK_ROWS)
                if digests and len(digests) + j - i > BLOCK_ROWS:
                    yield from block(no, ids, parts, masks, digests)
                    no, ids, parts, masks, digests = no + 1, [], [], [], []
                ids.append(b.column("doc_id").slice(i, j - i))
                parts.append(b.column("part").slice(i, j - i))
                for r in range(i, j):
                    text = raw[off[r]:off[r + 1]]
                    masks.append(mask(text))
                    digests.append(hashlib.sha256(text).digest())
        if digests:
            yield from block(no, ids, parts, masks, digests)

    return run


def _merge(sketch: Cells):
    """An owner's merged range and its answers: per block, the sent cells whose counter reached two."""
    def run(messages: pd.DataFrame) -> pd.DataFrame:
        seen, two = np.zeros(sketch.span, bool), np.zeros(sketch.span, bool)
        for n, code, twice in zip(messages["n"], messages["code"], messages["twice"], strict=True):
            cells = ungolomb(code, int(n), sketch.span).astype(np.int64)
            two[cells] |= seen[cells] | np.unpackbits(np.frombuffer(twice, np.uint8), count=int(n)).astype(bool)
            seen[cells] = True
        rows = []
        for block, owner, n, code in zip(messages["block"], messages["owner"], messages["n"], messages["code"], strict=True):
            bit = two[ungolomb(code, int(n), sketch.span).astype(np.int64)]
            if bit.any():
                rows.append((block, owner, np.packbits(np.pad(bit, (0, -len(bit) % 64)), bitorder="little").view(np.int64)))
        return pd.DataFrame(rows, columns=["block", "owner", "bits"])

    return run


def flagged(docs: DataFrame, part) -> DataFrame:
    """(rid, doc_id, part, mask, repeats): every row of ``docs`` (doc_id, text and
    what ``part`` reads) with the bits of the filters that it fails."""
    by_value()
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = rows.count()
    sketch = Cells(n, max(shuffle_partitions(spark), -(-n // OWNER_ROWS)))
    sent = written(rows.mapInArrow(_scan(sketch), SENT), "audit-sent", ["kind"])
    scanned = sent.where("kind = 'doc'").select("rid", "doc_id", "part", "mask", "sha", "block", "owner", "at")
    merged = sent.where("kind = 'cells'").select("block", "owner", "n", "code", "twice").groupBy("owner") \
                 .applyInPandas(_merge(sketch), "block long, owner int, bits array<long>")
    twice = F.expr("forall(at, c -> (shiftright(element_at(bits, cast(c div 64 + 1 as int)), c % 64) & 1) = 1)")
    scanned = written(scanned.join(merged, ["block", "owner"], "left").select(
        "rid", "doc_id", "part", "mask", "sha", F.coalesce(twice, F.lit(False)).alias("repeats")), "audit-scanned", ["repeats"])

    suspects = scanned.where("repeats and doc_id is not null")
    ids = written(suspects.select(F.col("doc_id").alias("id")).distinct(), "audit-suspects")
    texts = rows.join(ids, F.col("doc_id") == F.col("id"), "left_semi")      # broadcast if the written ids are below Spark's byte threshold
    least = written(texts.groupBy("text").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
                    .where("copies > 1").select(F.unhex(F.sha2("text", 256)).alias("sha"), "least", "copies"), "audit-least")
    total = least.agg(F.sum("copies").alias("n")).first()["n"] or 0
    hot = F.col("copies") * HEAVY > total                                    # fewer than HEAVY such texts
    heavy, light = F.broadcast(least.where(hot).select("sha", "least")), least.where(~hot).select("sha", "least")
    bit = F.when(F.col("doc_id") > F.col("least"), F.lit(16)).otherwise(F.lit(0))
    out = ["rid", "doc_id", "part", "mask", "repeats"]
    alone = scanned.where("not repeats or doc_id is null")
    kept_apart = suspects.join(heavy, "sha").withColumn("mask", F.col("mask") + bit)
    others = suspects.join(heavy.select("sha"), "sha", "left_anti").join(light, "sha", "left").withColumn("mask", F.col("mask") + bit)
    return alone.select(out).unionByName(kept_apart.select(out)).unionByName(others.select(out))


def audit(docs: DataFrame, labels: DataFrame, part) -> DataFrame:
    """One row per (part, filter_order, step); see the module docstring."""
    rows = written(flagged(docs, part).select("doc_id", "part", "mask"), "audit-masks")
    of = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    fails = rows.where("mask > 0").join(of.where("good + toxic > 0"), "doc_id", "left")    # what no filter removes needs no label
    counts = rows.where("mask = 0").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("good"),
                                                                F.lit(0).cast("long").alias("toxic"))
    counts = counts.unionByName(fails.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
                                                                  F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")))
    per_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("c"))   # at most 32 entries
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = per_part.select("part", "c", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step"))
    bit_of = "shiftleft(1, ascii(substring(filter_order, {0}, 1)) - 65)"
    steps = steps.withColumn("f", F.expr(bit_of.format("step"))) \
                 .withColumn("before", F.expr(f"aggregate(sequence(1, 5), 0, (s, i) -> if(i < step, s + {bit_of.format('i')}, s))"))
    total = lambda value, when: F.expr(f"aggregate(c, 0L, (s, x) -> if({when}, s + {value}, s))")
    here = "(x.mask & before) = 0 and (x.mask & f) != 0"
    return steps.select(
        "part", "filter_order", "step",
        total("x.n", "(x.mask & (before + f)) = 0").alias("kept"), total("x.n", here).alias("removed"),
        total("x.n", "(x.mask & before) != 0 and (x.mask & f) != 0").alias("redundant"), total("x.n", "x.mask = f").alias("unique_fails"),
        total("x.good", here).alias("good_lost"), total("x.toxic", here).alias("toxic_lost"),
        # of the failed filters of a row, each comes first in the same share of all 120 orders
        total("x.n * (120 div bit_count(x.mask))", "(x.mask & f) != 0").alias("shapley"))


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), F.col("source"))


OP12_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
          100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
          regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, k AS step, [instr('ABCDE', substr(o, i, 1)) for i in range(1, k + 1)] AS upto FROM orders, range(1, 6) AS r(k)),
r AS (
  SELECT part, o, step, upto[step] AS flt, n, good, toxic, fails[upto[step]] AS bad,
         len(list_filter(upto[1:step - 1], lambda i: fails[i])) > 0 AS gone,
         len(list_filter(fails, lambda v: v)) AS n_fails
  FROM c, s)
SELECT part, o AS filter_order, step::INTEGER AS step,
       coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0)::BIGINT AS kept,
       coalesce(sum(n) FILTER (NOT gone AND bad), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (gone AND bad), 0)::BIGINT AS redundant,
       coalesce(sum(n) FILTER (bad AND n_fails = 1), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (NOT gone AND bad), 0)::BIGINT AS good_lost,
       coalesce(sum(toxic) FILTER (NOT gone AND bad), 0)::BIGINT AS toxic_lost,
       sum(coalesce(sum(n) FILTER (NOT gone AND bad), 0)) OVER (PARTITION BY part, flt)::BIGINT AS shapley
FROM r GROUP BY part, o, step, flt
"""
