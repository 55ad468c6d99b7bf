"""Connected components of an edge table (a written one): union-find by hooking and pointer
jumping, one join round at a time.

Every node points to the smallest node it knows.  A round hooks the root of
each edge's larger end under the root of its smaller end (the smallest offer
wins, a partial aggregate) and then halves all pointer chains.  A star of any
size ends after one round, a chain of n nodes after about log2 n.  Nothing but
one count per round reaches the driver, and each round's table is written to
the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is the
    smallest node of the component.  Loops and repeated edges are allowed."""
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # first hook: the smallest neighbour at or below a node
    both = e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        e.select(F.col("a").alias("node"), F.col("a").alias("root")))
    up = written(both.groupBy("node").agg(F.min("root").alias("root")), f"{name}-up")
    while True:
        # halve the chains until every pointer shows a root
        while True:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            up = written(up.join(over, "root").select("node", F.col("above").alias("root"),
                                                      (F.col("above") != F.col("root")).alias("moved")), f"{name}-up")
            moved = up.where("moved").limit(1).count()
            up = up.drop("moved")
            if not moved:
                break
        ra = up.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        rb = up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        e = written(e.join(ra, "a").join(rb, "b").where("ra != rb")
                    .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"{name}-edges")
        if not e.limit(1).count():
            return up
        hook = e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        up = written(up.join(hook, "node", "left").select("node", F.coalesce("to", "root").alias("root")), f"{name}-up")
