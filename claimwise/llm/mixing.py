"""Operator 5: mixing sources to target weights by subset-sum budget fitting.

1. Words of every document are counted; everything after works on
   (doc_id, source, size) rows written once.
2. Targets: sources by code point (null last) weigh 1, 2, 3, repeating, and
   share all words; a target stops at 3 times its source and the excess goes to
   the others by weight, until none is above.
3. Fitting, per source, on its histogram (documents per exact size): whole
   passes first, then a proportional part of all sizes (15 of 16 words of any
   budget, more of a very large one, less where the rest couldn't meet it), then a
   bounded knapsack over the sizes left
   (binary-split counts, a bitset of reachable sums) that meets the remaining
   budget exactly wherever sums allow.
4. Of each (source, size) the fitted number of documents is picked by a seeded
   hash of doc_id.  A large (source, size) group is cut into hash ranges of
   about 512 rows, counted, and only the range in which the cut falls is ranked.

The histogram has a row per source and size, whatever the number of documents;
the source table one row per source.

Defined cases.  Null or empty text has size 0 and takes 0 words.  A null source
is a source of its own.  Rows equal in doc_id hash alike, so which of them is
picked is open, how many is not; a null doc_id counts as one value.  A source
without words has target 0.  An empty table gives no rows.  Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import TEXT_BYTES, by_value, chunks, if_small, own_names, read, word_spans, written

MOST_PASSES = 3
KNAPSACK_WORDS = 1 << 16   # words the knapsack settles at most (its memory)
KNAPSACK_SHARE = 16        # and its share of a budget: one in so many words; the others go in proportion
SEED = 20240229


def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, data, off in chunks(batches, TEXT_BYTES):
        _, _, bounds = word_spans(data, off)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(np.diff(bounds))],
                                         names=["doc_id", "source", "size"])


def targets(per_source: DataFrame) -> DataFrame:
    """Adds weight and target to (source, source_size); one row per source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = per_source.withColumn("weight", (rank - 1) % 3 + 1)
    w = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    big = lambda c: F.col(c).cast("decimal(38,0)")
    s = s.withColumn("total", F.sum("source_size").over(everything)) \
         .withColumn("before", F.coalesce(F.sum(F.col("source_size") * MOST_PASSES).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) \
         .withColumn("weights", F.sum("weight").over(w.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("full", big("source_size") * MOST_PASSES * big("weights") < (big("total") - big("before")) * big("weight"))
    # the first source that is not full fixes the words a unit of weight gets
    free = F.min(F.when(~F.col("full"), F.struct((F.col("source_size") / F.col("weight")).alias("o"), "before", "weights"))).over(everything)
    s = s.withColumn("free", free)
    share = (F.col("total") - F.col("free.before")).cast("double") * F.col("weight") / F.col("free.weights")
    return s.withColumn("target", F.when(F.col("full"), (F.col("source_size") * MOST_PASSES).cast("double"))
                        .otherwise(F.least(share, (F.col("source_size") * MOST_PASSES).cast("double")))) \
            .select("source", "source_size", "weight", "target")


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take for the largest sum within the budget."""
    taken = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return taken
    reach, mask = 1, (1 << (budget + 1)) - 1
    by = np.full(budget + 1, -1, np.int64)
    pieces: list[tuple[int, int]] = []
    done = np.zeros(budget + 1, bool)
    done[0] = True
    for i in np.argsort(-lengths):
        length, left = int(lengths[i]), int(min(counts[i], budget // max(1, int(lengths[i]))))
        k = 1
        while length and left > 0 and not reach >> budget & 1:
            k = min(k, left)
            left -= k
            more = (reach | reach << (k * length)) & mask
            if more != reach:
                bits = np.unpackbits(np.frombuffer(more.to_bytes(budget // 8 + 1, "little"), np.uint8), bitorder="little")[:budget + 1].astype(bool)
                by[bits & ~done] = len(pieces)
                done, reach = bits, more
            pieces.append((int(i), k))
            k *= 2
    at = reach.bit_length() - 1
    while at:
        i, k = pieces[by[at]]
        taken[i] += k
        at -= k * int(lengths[i])
    return taken


def fit(lengths: np.ndarray, counts: np.ndarray, target: float, most: int = KNAPSACK_WORDS) -> tuple[int, np.ndarray]:
    """Whole passes over a source and how many documents of each length (ascending) to add."""
    total = int((lengths * counts).sum())
    none = np.zeros(len(lengths), np.int64)
    if not total:
        return 0, none
    passes = min(MOST_PASSES, int(target // total))
    budget = min(total, max(0, round(target) - passes * total))
    if passes == MOST_PASSES or not budget:
        return passes, none
    # the knapsack's share: a sixteenth, or what its longest document needs; more only where that can't meet the budget
    all_ = min(most, budget)
    rest = min(all_, max(budget // KNAPSACK_SHARE, int(lengths.max())))
    best = None
    while True:
        n, left = _in_proportion(lengths, counts, total, budget, rest, most)
        more = knapsack(lengths, counts - n, left)
        gap = left - int((more * lengths).sum())
        if best is None or gap < best[0]:
            best = gap, n + more
        if not gap or rest == all_:
            return passes, best[1]
        rest = min(all_, 2 * rest)


def _in_proportion(lengths: np.ndarray, counts: np.ndarray, total: int, budget: int, rest: int, most: int) -> tuple[np.ndarray, int]:
    """Documents of each length for ``budget`` less ``rest`` words, and the words left
    of the budget: taken over the running count of documents, so that lengths with few of them get theirs too."""
    run = [0]
    for c in counts:
        run.append(run[-1] + int(c))
    n = np.diff(np.array([c * (budget - rest) // total for c in run], np.int64))
    left = budget - int((n * lengths).sum())
    for i in np.argsort(-lengths):           # rounding may be off by a document: long ones out, or in, until the rest is in reach
        if lengths[i] and left < 0:
            k = min(int(n[i]), -(left // int(lengths[i])))
        elif lengths[i] and left > most:
            k = -min(int(counts[i] - n[i]), (left - most) // int(lengths[i]))
        else:
            continue
        n[i] -= k
        left += k * int(lengths[i])
    return n, left


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size")
    passes, n = fit(rows["size"].to_numpy(), rows["docs"].to_numpy(), float(rows["target"].iloc[0]))
    return rows.assign(passes=passes, picks=n)[["source", "size", "docs", "source_size", "target", "passes", "picks"]]


def _decided(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Every row's (doc_id, source, size, source_size, target, copies), and the
    rules that give it: per (source, size) the whole passes and the last
    (u, doc_id) that is picked."""
    d = written(docs.mapInArrow(sizes, "doc_id long, source string, size long"), "mix-sizes")
    hist = d.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs"))
    per = written(targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))), "mix-targets")
    per = per.withColumnRenamed("source", "s")
    plan = hist.join(per, F.col("source").eqNullSafe(F.col("s"))).groupBy("source").applyInPandas(
        _fit_source, "source string, size long, docs long, source_size long, target double, passes int, picks long")
    plan = written(plan, "mix-plan").withColumnsRenamed({"source": "s", "size": "z"})

    d = d.withColumn("u", F.xxhash64(F.lit(seed), "doc_id"))
    d = d.join(if_small(plan), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")
    deep = F.greatest(F.lit(0), F.floor(F.log2(F.col("docs") / 512)).cast("int"))
    # ranges of u in its own (signed) order
    d = d.withColumn("deep", deep).withColumn("part", F.expr("CASE WHEN deep = 0 THEN 0L ELSE shiftright(u, 64 - deep) END"))
    some = (F.col("picks") > 0) & (F.col("picks") < F.col("docs"))
    key = ["source", "size", "part"]
    per_part = d.where(some).groupBy(*key, "picks").agg(F.count(F.lit(1)).alias("inside"))
    up_to = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.withColumn("need", F.col("picks") - F.coalesce(F.sum("inside").over(up_to), F.lit(0))) \
                       .where("need > 0").select(*[F.col(c).alias("k_" + c) for c in key], "need", "inside")
    at = F.col("source").eqNullSafe(F.col("k_source")) & (F.col("size") == F.col("k_size")) & (F.col("part") == F.col("k_part"))
    d = written(d.join(per_part, at & some, "left").drop("k_source", "k_size", "k_part"), "mix-parts")
    cut = F.col("need").isNotNull() & (F.col("need") <= F.col("inside"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("u", "doc_id"))
    ranked = d.where(cut).withColumn("rank", rank)
    clear = d.where(~cut).withColumn("more", ((F.col("picks") > 0) & (~some | F.col("need").isNotNull())).cast("int"))
    copies = F.when(F.col("size") > 0, F.col("passes") + F.col("more")).otherwise(0)
    rows = ranked.withColumn("more", (F.col("rank") <= F.col("need")).cast("int")).drop("rank").unionByName(clear)
    rows = rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))
    last = ranked.where("rank = need").select(F.col("source").alias("l_s"), F.col("size").alias("l_z"), F.col("u").alias("last_u"), F.col("doc_id").alias("last_id"))
    rules = plan.join(last, F.col("s").eqNullSafe(F.col("l_s")) & (F.col("z") == F.col("l_z")), "left") \
                .select("s", "z", "docs", "passes", "picks", "last_u", "last_id")
    return rows, rules


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.col("text").cast("string").alias("text"))


def mix_sources(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row
    of ``docs`` (doc_id, source, text); copies is how often the mix holds it."""
    by_value()
    rows, _ = _decided(_inputs(docs), seed)
    return rows.withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, as often as it takes
    them.  The rules (a row per source and size) go to the documents, so texts
    are not shuffled while that table is small.  Rows equal in doc_id, source
    and size at the last picked place are all picked."""
    by_value()
    _, rules = _decided(_inputs(docs), seed)
    rules = written(rules.where("z > 0 and (passes > 0 or picks > 0)"), "mix-rules")
    d, at = own_names(docs)
    columns, text = d.columns, at["text"]

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, off in chunks(batches, TEXT_BYTES, text):
            _, _, bounds = word_spans(data, off)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.diff(bounds))], names=[*columns, "size"])

    rows = d.mapInArrow(sized, StructType([*d.schema.fields, StructField("size", LongType())]))
    rows = rows.join(if_small(rules), F.col(at["source"]).eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    i, none = F.col(at["doc_id"]).cast("long"), F.lit(-1 << 63)
    u = F.xxhash64(F.lit(seed), i)
    before = (u < F.col("last_u")) | ((u == F.col("last_u")) & (F.coalesce(i, none) <= F.coalesce("last_id", none)))
    more = (F.col("picks") > 0) & ((F.col("picks") == F.col("docs")) | before)
    copies = F.col("passes") + F.coalesce(more, F.lit(False)).cast("int")
    rows = rows.withColumn("copies", copies).where("copies > 0")
    return rows.select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("no")).select(*columns).toDF(*docs.columns)


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"))
