"""G1 keep-first dedup by key.

Expressed as an aggregate, not a window: the least struct of the row's columns, in
the wanted order, per key.  The aggregate is partial (map-side), so a hot key
holding a third of all rows is reduced to one candidate per input partition
before the shuffle — no single task ever sees the whole hot group.  The struct
holds every payload column once, the order's first, so the order is total and the
result does not depend on physical row order.

``within`` names columns that have one value per key.  They join the grouping, which
changes no row, but rows that a join has already dealt by them are grouped where they lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order_cols: list[str] | None = None, within: list[str] | None = None) -> DataFrame:
    keys = [*(within or []), *keys]
    payload = [c for c in df.columns if c not in keys]
    if not payload:
        return df.select(*keys).distinct()
    first = [c for c in (order_cols or []) if c in payload]
    row = F.struct(*first, *[c for c in payload if c not in first])
    return df.groupBy(*keys).agg(F.min(row).alias("__row")).select(*keys, "__row.*").select(*df.columns)
