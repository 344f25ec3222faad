"""Connected components by label propagation with pointer jumping, checkpointed between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import cut, release


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component) for every end of an edge; the component is its lowest id. Self loops and repeated edges are harmless.

    Alternates large-star and small-star steps: each round links a node's larger neighbours, then all of its smaller
    ones, to the smallest; stars shrink a chain exponentially and no step gathers a neighbourhood in one task
    (only ``min`` per node, with partial aggregation, and a join on the node).
    """
    e = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    nodes = e.select(F.col("u").alias("id")).union(e.select("v")).distinct()
    first = e
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        same = new.count() == e.count() and new.exceptAll(e).isEmpty()
        if same:
            release(new)
            break
        if e is not first:  # the first cut names the nodes
            release(e)
        e = new
    else:
        raise RuntimeError(f"components are not complete after {max_rounds} rounds")
    return nodes.join(e.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
