"""Operator 10: exact top-k inner products by best-first search in M-trees.

Metric.  With M the largest norm, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0)
have |q' - x'|^2 = |q|^2 + M^2 - 2 q.x: the nearest objects are those of the
largest inner product, and the triangle inequality holds.  Bounds are floating
point with a safety margin; scores are exact integers, compared as such.

Index.  Every row is indexed.  Vectors go to the nearest of at most 256 pivots
(the rows with the smallest hash of vec_id: a sample that only routes), and a
pivot's rows to trees of about 4,096 rows by a hash of vec_id, so that one
vector that fills a third of the table still spreads evenly.  A tree is a set
of pages: an inner page holds routing objects with covering radii, distances to
the parent and children; a leaf page holds vectors with their distances to the
parent.

Search.  Queries (vec_id divisible by 50) are packed in blocks of 256 and a
(tree, block) pair is one row of work.  A query visits pages in the order of
their least possible distance; an entry e of a page under p is passed over
without a distance when |d(q, p) - d(e, p)| - radius(e) is beyond the k-th
best.  The k-th best among the pivots starts that bound for every tree.  Each
tree's k best are merged by a window per query.

Defined cases.  A null vector, one with a null or non-finite component, or a
null vec_id takes no part.  Only vectors of one length meet.  Rows that share a
vec_id are candidates each, but none for a query of that vec_id.  Empty tables
give no rows.  Scores are exact: in floating point while all squared norms are
below 2^53, in 64-bit integers beyond; a score has to fit 64 bits, as the result
does.  Other columns are not read.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_value, read, written

PIVOTS, TREE_ROWS, BLOCK = 256, 4096, 256
LEAF, FANOUT = 128, 24
SLACK = 1e-6


def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, dim, norm2, v): floor(256 x) of the vectors that take part, as little-endian 64-bit integers."""
    for b in batches:
        rows = []
        for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding")):
            if i is None or not v.is_valid or v.values.null_count:
                continue
            x = np.floor(256 * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
            if np.isfinite(x).all():
                rows.append((i, len(x), float((x * x).sum()), x.astype("<i8").tobytes()))
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64()),
                                          pa.array(cols[3], pa.binary())], names=["vec_id", "dim", "norm2", "v"])


def whole(col: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col), "<i8").reshape(len(col), dim)


def matrix(col: list[bytes], dim: int) -> np.ndarray:
    return whole(col, dim).astype(np.float64)


EXACT = 2.0 ** 53        # squared norms below it: every score is exact in floating point


def reach_of(base: float, score: float) -> float:
    """The distance at which an object of that score lies, with the margin that bounds need."""
    wide = 0.0 if base < EXACT else SLACK * float(np.sqrt(base))
    return float(np.sqrt(max(0.0, base - 2 * score))) * (1 + SLACK) + SLACK + wide


class MTree:
    """Pages over (ids, vectors); built by splitting around spread-out routing objects."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, top2: float):
        self.ids, self.x, self.exact = ids, x, None
        lift = np.sqrt(np.maximum(0.0, top2 - (x * x).sum(1)))
        self.lifted = np.hstack([x, lift[:, None]])
        self.pages: list[tuple] = []
        self.root = self._page(np.arange(len(ids)), None)
        del self.lifted

    def _from(self, rows: np.ndarray, center: np.ndarray | None) -> np.ndarray:
        return np.zeros(len(rows)) if center is None else np.sqrt(((self.lifted[rows] - center) ** 2).sum(1))

    def _page(self, rows: np.ndarray, center: np.ndarray | None) -> int:
        if len(rows) <= LEAF:
            self.pages.append(("leaf", rows, self._from(rows, center)))
            return len(self.pages) - 1
        k = min(FANOUT, -(-len(rows) // (LEAF // 2)))
        y = self.lifted[rows]
        picked, near = [0], ((y - y[0]) ** 2).sum(1)
        nearest = np.zeros(len(rows), np.int64)
        while len(picked) < k and near.max() > 0:     # farthest first
            far = int(near.argmax())
            d = ((y - y[far]) ** 2).sum(1)
            nearest[d < near] = len(picked)
            near = np.minimum(near, d)
            picked.append(far)
        if len(picked) == 1 or np.bincount(nearest).max() > 0.9 * len(rows):   # equal objects: cut evenly
            nearest = np.arange(len(rows)) * k // len(rows)
            picked = list(np.searchsorted(nearest, np.arange(k)))
        entries = []
        for c, p in enumerate(picked):
            inside = rows[nearest == c]
            if len(inside):
                obj = y[p]
                entries.append((rows[p], float(self._from(inside, obj).max()), self._page(inside, obj)))
        at = np.array([e[0] for e in entries])
        self.pages.append(("inner", at, self._from(at, center), np.array([e[1] for e in entries]), np.array([e[2] for e in entries])))
        return len(self.pages) - 1

    def search(self, q: np.ndarray, own: int, k: int, top2: float, floor: float, whole_q: np.ndarray | None = None) -> list[tuple[float, int]]:
        """The k best (score, id), those with scores under ``floor`` may be missing.  With
        ``whole_q`` scores are 64-bit sums over ``exact``; without, floating point holds them."""
        base = float((q * q).sum()) + top2
        reach = lambda score: reach_of(base, score)
        wide = 0.0 if base < EXACT else SLACK * float(np.sqrt(base))
        best: list[tuple[float, int]] = []      # a heap of the k best as (score, -id)
        bound = reach(floor) if floor > -np.inf else np.inf
        heap = [(0.0, self.root, -1.0)]
        while heap:
            least, page, above = heapq.heappop(heap)
            if least > bound:
                break
            kind, rows, to_parent, *inner = self.pages[page]
            if above >= 0:                      # what the stored distances already rule out
                apart = np.abs(above - to_parent) - (inner[0] if inner else 0.0)
                go = np.flatnonzero(apart <= bound + wide)
            else:
                go = np.arange(len(rows))
            if not len(go):
                continue
            score = self.x[rows[go]] @ q
            if kind == "inner":
                d = np.sqrt(np.maximum(0.0, base - 2 * score))
                least_of = np.maximum(0.0, d * (1 - SLACK) - inner[0][go] - SLACK - wide)
                for j in np.flatnonzero(least_of <= bound):
                    heapq.heappush(heap, (float(least_of[j]), int(inner[1][go[j]]), float(d[j])))
                continue
            if whole_q is not None:
                score = (self.exact[rows[go]] * whole_q).sum(1)
            if len(best) == k:
                keep = score >= best[0][0]
                go, score = go[keep], score[keep]
            for s, i in zip(score.tolist(), self.ids[rows[go]].tolist()):
                if i != own:
                    if len(best) < k:
                        heapq.heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (s, -i))
            if len(best) == k:
                bound = min(bound, reach(best[0][0]))
        return [(s, -i) for s, i in best]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best rows of ``vectors`` (vec_id, embedding)."""
    by_value()
    raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = written(raw.mapInArrow(integers, "vec_id long, dim int, norm2 double, v binary"), "mtree-vectors")
    parts = [_top_k(v.where(F.col("dim") == r["dim"]), int(r["dim"]), float(r["top2"]), int(r["n"]), int(r["q"]), k, every)
             for r in v.groupBy("dim").agg(F.max("norm2").alias("top2"), F.count(F.lit(1)).alias("n"),
                                           F.sum((F.col("vec_id") % every == 0).cast("long")).alias("q")).collect() if r["q"]]
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _top_k(v: DataFrame, dim: int, top2: float, rows: int, queries: int, k: int, every: int) -> DataFrame:
    wanted = min(PIVOTS, max(1, rows // TREE_ROWS * 2))
    sample = v.withColumn("h", F.xxhash64("vec_id")).orderBy("h", "vec_id").limit(max(wanted, min(PIVOTS, 4 * k))).select("vec_id", "v").collect()
    pivots, pivot_ids = matrix([r["v"] for r in sample], dim), np.array([r["vec_id"] for r in sample])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p2 = (pivots[:wanted] ** 2).sum(1)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("v").to_pylist(), dim)
                cell = (p2[None, :] - 2 * x @ pivots[:wanted].T).argmin(1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(cell.astype(np.int32))], names=["vec_id", "v", "cell"])

    routed = written(v.select("vec_id", "v").mapInArrow(route, "vec_id long, v binary, cell int"), "mtree-routed")
    per_cell = routed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TREE_ROWS).alias("parts"))
    placed = routed.join(per_cell, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = MTree(pdf["vec_id"].to_numpy(), matrix(list(pdf["v"]), dim), top2)
        high = np.abs(tree.x).max(initial=0)
        narrow = np.int16 if high < 1 << 15 else np.int32 if high < 1 << 31 else np.int64
        pages = pickle.dumps((tree.ids, whole(list(pdf["v"]), dim).astype(narrow), tree.pages, tree.root))
        return pd.DataFrame({"tree": [(int(pdf["cell"].iloc[0]) << 32) + int(pdf["part"].iloc[0])], "pages": [pages]})

    trees = written(placed.groupBy("cell", "part").applyInPandas(build, "tree long, pages binary"), "mtree-pages")
    n_blocks = -(-queries // BLOCK)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "ids": [pdf["vec_id"].to_numpy("<i8").tobytes()], "q": [b"".join(pdf["v"])]})

    packed = v.where(F.col("vec_id") % every == 0).select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("block")) \
              .groupBy("block").applyInPandas(pack, "block long, ids binary, q binary")
    # a stated query set against all rows, in blocks: a row of work per tree and block
    work = trees.select("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block")) \
                .join(packed, "block").repartition(F.col("tree"), F.col("block")).join(trees, "tree")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                tree = MTree.__new__(MTree)
                ids, x, tree.pages, tree.root = pickle.loads(b.column("pages")[i].as_py())
                tree.ids, tree.x = ids, x.astype(np.float64)
                own = np.frombuffer(b.column("ids")[i].as_py(), "<i8")
                whole_q = whole([b.column("q")[i].as_py()[8 * dim * n:8 * dim * (n + 1)] for n in range(len(own))], dim)
                q = whole_q.astype(np.float64)
                tree.exact = None if top2 < EXACT else x.astype(np.int64)
                found = []
                for at in range(len(own)):
                    known = np.sort((pivots @ q[at])[pivot_ids != own[at]])
                    floor = known[-k] if len(known) >= k else -np.inf
                    best = tree.search(q[at], own[at], k, top2, floor, None if tree.exact is None else whole_q[at])
                    found += [(b.column("block")[i].as_py(), at, own[at], n, s) for s, n in best]
                cols = list(zip(*found, strict=True)) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array([int(s) for s in cols[4]], pa.int64())],
                                                 names=["block", "at", "query_id", "vec_id", "score"])

    best = work.mapInArrow(search, "block long, at long, query_id long, vec_id long, score long")
    w = Window.partitionBy("block", "at").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_mtree_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
