"""Connected components by random contraction.

Each round, every node of the remaining graph joins its neighbour with the lowest random priority (its own
included), and the edges are rewritten to what their ends joined. A constant share of the nodes goes each
round, whatever the graph's shape: O(log n) rounds. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def connected_components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """node, component for every node that has an edge to another; a component is named by one of its nodes.
    Loops and repeated edges are fine. Edges with a null end are left out."""
    now = staged(edges.select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b")).filter((F.col(u) != F.col(v))).distinct() if {u, v} != {"a", "b"} else edges.filter(F.col(u) != F.col(v)).distinct(), "edges")
    joined: list[DataFrame] = []
    while not now.isEmpty():
        seed = len(joined)
        rank = lambda x: F.xxhash64(F.lit(seed), x)
        both = now.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(now.select(F.col("b").alias("node"), F.col("a").alias("to")))
        best = both.groupBy("node").agg(F.min(F.struct(rank(F.col("to")).alias("p"), F.col("to").alias("to"))).alias("m"))
        own = F.struct(rank(F.col("node")).alias("p"), F.col("node").alias("to"))
        parent = staged(best.select("node", F.least(F.col("m"), own)["to"].alias("parent")), "parents")
        joined.append(parent)
        ends = now.join(parent.select(F.col("node").alias("a"), F.col("parent").alias("x")), "a").join(parent.select(F.col("node").alias("b"), F.col("parent").alias("y")), "b")
        now = staged(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not joined:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    label = joined[-1].select("node", F.col("parent").alias("component"))
    for parent in reversed(joined[:-1]):
        later = label.select(F.col("node").alias("parent"), "component")
        label = parent.join(later, "parent", "left").select("node", F.coalesce("component", "parent").alias("component"))
    return staged(label, "components")
