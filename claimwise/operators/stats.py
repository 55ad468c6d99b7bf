"""Global-statistics operators (F1–F5): quantiles, winsorising, quantile bands.

All quantiles a table needs are computed together; exact ones are attached as
constants, the sketch's single row with a broadcast cross join.

There is one path for every input size: exact quantiles (linear interpolation,
equal to pandas ``quantile``) by cutting the ranges that hold the wanted positions
(see ``distributed_quantiles``), so no task holds all distinct values and none are shuffled
but the last few.  ``method="approx"`` (per call, or for a whole job with the session conf
``claimwise.quantile.method``) asks for the mergeable ``percentile_approx``
sketch instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import bucketed

QCOL = "__q_{}"


def _method(df: DataFrame, method: str | None) -> tuple[str, int]:
    """exact (default) | approx."""
    spark = df.sparkSession
    m = method or spark.conf.get("claimwise.quantile.method", "exact")
    if m not in ("exact", "approx"):
        raise ValueError(f"quantile method {m}: exact or approx")
    return m, int(spark.conf.get("claimwise.quantile.accuracy", "100000"))


BINS = 4096             # bins that a range is cut into at once
FEW = 1_000_000         # rows left in all ranges that are counted value by value
DEPTH = 6               # cuts at most, however uneven the values


def distributed_quantiles(df: DataFrame, specs: dict[str, tuple[Column, list[float]]], weight: str | None = None) -> dict[str, list[float] | None]:
    """Exact quantiles without a single-task merge and without a shuffle of the values.
    A row counts as often as its ``weight`` says (a column of whole numbers), once without.

    1. one aggregate gives every spec's count and least and greatest finite value;
    2. while the ranges that hold needed positions (pos = (n-1)·p, floor and ceil) have
       many rows, each is cut into ``BINS`` bins of equal width (an expression that never
       falls as the value rises); counts and bounds of the bins, one row each, say which
       bins hold the positions, and only those are cut again;
    3. the values of what is left are counted one by one (``_picked``) and interpolated
       exactly like ``percentile``: (hi - pos)·v[lo] + (pos - lo)·v[hi].

    Each pass tallies all columns in one go over Arrow batches (``_tally``): as SQL
    expressions, many columns make methods beyond what the JVM compiles.
    """
    names = list(specs)
    if not names:
        return {}
    value = df.select(*[specs[n][0].cast("double").alias(f"v{i}") for i, n in enumerate(names)],
                      (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"))
    found = _extent(value, names)
    want = {(n, i): (found[n]["n"] - 1) * float(p) for n in names if found[n]["n"] for i, p in enumerate(specs[n][1])}
    got: dict[tuple[str, int], float] = {}
    ranges: dict[str, list[tuple[float, float, int, int]]] = {n: [] for n in names}        # (least, greatest, rows before, rows)
    for (n, _), pos in want.items():
        r = found[n]
        for place in (math.floor(pos), math.ceil(pos)):
            if place < r["low"]:
                got[n, place] = -math.inf
            elif place < r["low"] + r["fin"]:
                got[n, place] = math.nan
                ranges[n] = [(r["least"], r["most"], r["low"], r["fin"])]
            else:
                got[n, place] = math.inf if place < r["low"] + r["fin"] + r["high"] else math.nan
    left = {n: {p for (m, p) in got if m == n and found[n]["low"] <= p < found[n]["low"] + found[n]["fin"]} for n in names}
    for _ in range(DEPTH):
        for n in names:                                                 # a range of one value needs no look
            for lo, hi, before, k in ranges[n]:
                if lo == hi:
                    here = {p for p in left[n] if before <= p < before + k}
                    got |= {(n, p): lo + 0.0 for p in here}
                    left[n] -= here
            ranges[n] = [r for r in ranges[n] if any(r[2] <= p < r[2] + r[3] for p in left[n])]
        if sum(k for rs in ranges.values() for _, _, _, k in rs) <= FEW:
            break
        bins = _cut(value, ranges)
        ranges = {n: [(lo, hi, before, k) for lo, hi, before, k in bins[n] if any(before <= p < before + k for p in left[n])] for n in names}
    got |= _picked(value, ranges, left)

    def at(n: str, i: int) -> float:
        pos = want[n, i]
        lo, hi = math.floor(pos), math.ceil(pos)
        x, y = got[n, lo], got[n, hi]
        return x if lo == hi or x == y else (hi - pos) * x + (pos - lo) * y

    return {n: [at(n, i) for i in range(len(specs[n][1]))] if found[n]["n"] else None for n in names}


def _tally(value: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn(columns, weights)`` over the batches of ``value``: a generator that is sent nothing and
    yields lists of columns for ``schema``; ``columns`` are pairs of present values and their weights."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns():
            for b in batches:
                w = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
                out = []
                for c in b.columns[:-1]:
                    there = c.is_valid().to_numpy(zero_copy_only=False) if c.null_count else slice(None)
                    out.append((c.drop_null().to_numpy(zero_copy_only=False) if c.null_count else c.to_numpy(zero_copy_only=False), w[there]))
                yield out

        for found in fn(columns()):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, types, strict=True)], names=fields)

    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    fields, types = zip(*[(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")], strict=True)
    return value.mapInArrow(run, schema)


def _extent(value: DataFrame, names: list[str]) -> dict[str, dict]:
    """Of every column: rows, infinite ones below and above (NaN counts as above them),
    finite ones with their least and greatest value."""
    def extents(batches):
        rows: dict[int, list] = {}
        for columns in batches:
            for i, (v, w) in enumerate(columns):
                finite = np.isfinite(v)
                r = rows.setdefault(i, [i, 0, 0, 0, 0, None, None])
                r[1] += int(w.sum())
                if finite.all():
                    r[4] += int(w.sum())
                else:
                    r[2] += int(w[v == -math.inf].sum())
                    r[3] += int(w[v == math.inf].sum())
                    r[4] += int(w[finite].sum())
                    v = v[finite]
                if len(v):
                    r[5:] = [float(v.min()) if r[5] is None else min(r[5], float(v.min())), float(v.max()) if r[6] is None else max(r[6], float(v.max()))]
        yield list(zip(*rows.values(), strict=True)) or [[]] * 7

    found = _tally(value, extents, "i int, n long, low long, high long, fin long, least double, most double").groupBy("i").agg(
        *[F.sum(k).alias(k) for k in ("n", "low", "high", "fin")], F.min("least").alias("least"), F.max("most").alias("most"))
    by = {r["i"]: r.asDict() for r in found.collect()}                      # one row a column
    none = {"n": 0, "low": 0, "high": 0, "fin": 0, "least": None, "most": None}
    return {n: by.get(i, none) for i, n in enumerate(names)}


def _cut(value: DataFrame, ranges: dict[str, list]) -> dict[str, list]:
    """The ranges' bins that hold rows, by value, as ranges: one aggregate, at most ``BINS`` rows a range."""
    bounds = [(i, k, lo, hi) for i, rs in enumerate(ranges.values()) for k, (lo, hi, _, _) in enumerate(rs)]

    def bins(batches):
        kept: dict[tuple[int, int], tuple] = {}
        for columns in batches:
            for i, k, lo, hi in bounds:
                v, w = columns[i]
                inside = (v >= lo) & (v <= hi)
                v, w, half = v[inside], w[inside], hi / 2 - lo / 2             # halves, so that no width is infinite
                place = np.minimum(np.floor((v / 2 - lo / 2) / half * BINS), BINS - 1).astype(np.int64) if half > 0 else np.zeros(len(v), np.int64)
                if (i, k) not in kept:
                    kept[i, k] = (np.zeros(BINS, np.int64), np.full(BINS, math.inf), np.full(BINS, -math.inf))
                n, least, most = kept[i, k]
                np.add.at(n, place, w)
                np.minimum.at(least, place, v)
                np.maximum.at(most, place, v)
        for (i, k), (n, least, most) in kept.items():
            at = np.flatnonzero(n)
            yield [np.full(len(at), i), at + k * BINS, n[at], least[at], most[at]]

    names = list(ranges)
    out: dict[str, list] = {n: [] for n in ranges}
    before: dict[tuple[str, int], int] = {}
    found = _tally(value, bins, "i int, code long, c long, lo double, hi double").groupBy("i", "code").agg(
        F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    for r in found.orderBy("i", "code").collect():
        at = (names[r["i"]], r["code"] // BINS)
        done = before.get(at, ranges[at[0]][at[1]][2])
        out[at[0]].append((r["lo"], r["hi"], done, r["c"]))
        before[at] = done + r["c"]
    return out


def _picked(value: DataFrame, ranges: dict[str, list], left: dict[str, set[int]]) -> dict[tuple[str, int], float]:
    """The values at the wanted places of the ranges.

    Counts per distinct value (partial aggregation) are written in ranges of (name, v)
    (``operators/prefix.py``); the sum of each, one row a range, says which hold the
    places, and a running sum inside those picks the values."""
    if not any(ranges.values()):
        return {}
    bounds = [(i, k, lo, hi) for i, rs in enumerate(ranges.values()) for k, (lo, hi, _, _) in enumerate(rs)]

    def inside_ranges(batches):
        for columns in batches:
            for name, (i, _, lo, hi) in enumerate(bounds):
                v, w = columns[i]
                within = (v >= lo) & (v <= hi)
                if within.any():
                    each, at = np.unique(v[within], return_inverse=True)
                    n = np.zeros(len(each), np.int64)
                    np.add.at(n, at, w[within])
                    yield [np.full(len(each), name), each, n]

    spark, names = value.sparkSession, list(ranges)
    start = {j: (names[i], ranges[names[i]][k][2]) for j, (i, k, _, _) in enumerate(bounds)}
    long = _tally(value, inside_ranges, "name int, v double, c long")
    counts = bucketed(long.groupBy("name", "v").agg(F.sum("c").alias("c")), ["name", "v"], "quantile-counts")
    at, done = set(), {}
    for r in counts.groupBy("name", "_b").agg(F.sum("c").alias("n")).orderBy("name", "_b").collect():
        n, first = start[r["name"]]
        before = done.get(r["name"], first)
        at |= {(r["name"], r["_b"], before, p) for p in left[n] if before <= p < before + r["n"]}
        done[r["name"]] = before + r["n"]
    kinds = {"name": "int", "_b": "int", "before": "long", "at": "long"}                      # two a probability
    places = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).cast(kinds[k]).alias(k) for k, x in zip(kinds, r, strict=True)]) for r in sorted(at)])))
    few = F.broadcast(places.select("name", "_b", "before").distinct())
    w = Window.partitionBy("name", "_b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = counts.where(F.col("_b").isin(*sorted({b for _, b, _, _ in at}))).join(few, ["name", "_b"]) \
                   .withColumn("cum", F.col("before") + F.sum("c").over(w))
    # the distinct value covering 0-based position `at`: cum - c <= at < cum
    hit = inside.join(F.broadcast(places.select("name", "_b", "at")), ["name", "_b"]) \
                .where((F.col("cum") - F.col("c") <= F.col("at")) & (F.col("at") < F.col("cum")))
    return {(start[r["name"]][0], r["at"]): r["v"] for r in hit.select("name", "at", "v").collect()}


def distributed_quantile_row(df: DataFrame, specs: dict[str, tuple[Column, list[float]]], weight: str | None = None) -> DataFrame:
    """``distributed_quantiles`` as a one-row DataFrame."""
    return df.sparkSession.range(1).select(*_as_columns(distributed_quantiles(df, specs, weight)).values())


def _as_columns(found: dict[str, list[float] | None]) -> dict[str, Column]:
    cols = {QCOL.format(n): F.lit(None) if v is None else F.array(*[F.lit(x) for x in v]) for n, v in found.items()}
    return {n: c.cast("array<double>").alias(n) for n, c in cols.items()}


def quantile_row(df: DataFrame, specs: dict[str, tuple[Column, list[float]]],
                 method: str | None = None) -> DataFrame:
    """One-row DataFrame with an array<double> column per spec name.

    ``specs``: name -> (value expression, list of probabilities)."""
    m, acc = _method(df, method)
    if m == "exact":
        return distributed_quantile_row(df, specs)
    aggs = []
    for name, (expr, probs) in specs.items():
        arr = F.array(*[F.lit(float(p)) for p in probs])
        aggs.append(F.percentile_approx(expr.cast("double"), arr, acc).cast("array<double>").alias(QCOL.format(name)))
    return df.agg(*aggs)


def attach_quantiles(df: DataFrame, specs: dict[str, tuple[Column, list[float]]],
                     method: str | None = None, of: DataFrame | None = None) -> DataFrame:
    """Compute the specs over ``df`` (or over ``of``) and attach them: exact ones, known by
    then, as constants, a sketch's row by a cross join."""
    if not specs:
        return df
    return with_constants(df, quantile_constants(df if of is None else of, specs, method))


def quantile_constants(of: DataFrame, specs: dict[str, tuple[Column, list[float]]],
                       method: str | None = None) -> dict[str, Column] | DataFrame:
    """The specs' quantiles over ``of``, for ``with_constants`` on any tables: constants, or a sketch's row."""
    if _method(of, method)[0] == "exact":
        return _as_columns(distributed_quantiles(of, specs))
    return quantile_row(of, specs, method)


def with_constants(df: DataFrame, found: dict[str, Column] | DataFrame) -> DataFrame:
    return df.withColumns(found) if isinstance(found, dict) else df.crossJoin(F.broadcast(found))


def qref(name: str, i: int) -> Column:
    return F.col(QCOL.format(name))[i]


def drop_quantiles(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__q_")])


def clip(c: Column, name: str) -> Column:
    """winsorise to the attached (lo, hi) pair; an all-null column (null
    bounds) is returned unchanged."""
    lo, hi = qref(name, 0), qref(name, 1)
    return F.when(c.isNull(), c).otherwise(
        F.coalesce(F.least(F.greatest(c, F.coalesce(lo, c)), F.coalesce(hi, c)), c))


def quantile_band(c: Column, name: str, labels: list[str]) -> Column:
    """right-closed banding on attached quantile edges
    (-inf, q1], (q1, q2], ..., (qn, +inf).  Equal edges leave a band empty
    instead of failing; a null edge set (all-null input) gives null."""
    n = len(labels) - 1
    out = F.when(c.isNull() | qref(name, 0).isNull(), F.lit(None).cast("string"))
    for i in range(n):
        out = out.when(c <= qref(name, i), F.lit(labels[i]))
    return out.otherwise(F.lit(labels[-1]))


def median_fill(df: DataFrame, cols: list[str], method: str | None = None) -> DataFrame:
    """Fill nulls with the column median (one aggregate)."""
    specs = {c: (F.col(c), [0.5]) for c in cols}
    out = attach_quantiles(df, specs, method)
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(c), qref(c, 0)))
    return drop_quantiles(out)


def median_split(df: DataFrame, col: str, out_col: str, method: str | None = None) -> DataFrame:
    """binarise a measure at its median (1 when above)."""
    out = attach_quantiles(df, {col: (F.col(col), [0.5])}, method)
    out = out.withColumn(out_col, (F.col(col) > qref(col, 0)).cast("int"))
    return drop_quantiles(out)
