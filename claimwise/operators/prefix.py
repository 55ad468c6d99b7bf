"""Distributed running sums (prefix sums) over a global order.

A global running sum written as ``sum(x).over(Window.orderBy(v))`` runs in
one task.  Here the rows are range-partitioned by (key, value) and written once
with the number of their range as bucket: buckets hold about equally many rows, at
any number of partitions, equal values share one, and all later steps read the
same written buckets, so nothing rests on two samplings giving the same bounds.
Local running sums run inside (key, bucket); one row per (key, bucket) gives every
bucket its offset; offset + local sum is the global running sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def bucketed(df: DataFrame, order: list[str], name: str, buckets: int | None = None) -> DataFrame:
    """``df`` written in ranges of ``order``, with the range's number as ``_b`` (ascending, nulls first)."""
    by = [F.col(c).asc_nulls_first() for c in order]
    placed = df.repartitionByRange(buckets, *by) if buckets else df.repartitionByRange(*by)
    return written(placed.withColumn("_b", F.spark_partition_id()), name)


def running_sums(df: DataFrame, order: str, values: list[str], key: list[str] | None = None,
                 buckets: int | None = None, prefix: str = "cum_") -> DataFrame:
    """Adds ``<prefix><v>`` = sum of v over rows with (key equal and) order <=
    this row's order position (inclusive, rows ordered by ``order``)."""
    key = key or []
    placed = bucketed(df, [*key, order], "running-sums", buckets)
    w = Window.partitionBy(*key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumns({f"_l_{v}": F.sum(v).over(w) for v in values})
    per = placed.groupBy(*key, "_b").agg(*[F.sum(v).alias(f"_p_{v}") for v in values])
    wo = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*[F.col(c).alias(f"_k_{c}") for c in key], F.col("_b").alias("_k_b"),
                     *[F.coalesce(F.sum(f"_p_{v}").over(wo), F.lit(0)).alias(f"_o_{v}") for v in values])
    at = F.col("_b") == F.col("_k_b")
    for c in key:
        at = at & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    out = local.join(per, at)
    out = out.withColumns({f"{prefix}{v}": F.col(f"_o_{v}") + F.col(f"_l_{v}") for v in values})
    return out.drop("_b", "_k_b", *[f"_k_{c}" for c in key], *[f"_l_{v}" for v in values], *[f"_o_{v}" for v in values])
