"""Connected components of a large graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut, spread


def _least(pairs: DataFrame, owner: str) -> DataFrame:
    """Each node's least neighbour and the number of its neighbours."""
    return cut(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), owner)


def components(edges: DataFrame, owner: str) -> DataFrame:
    """(u, v): each node that has an edge, other than the least of its component, with that least node.

    ``edges`` has columns a and b.  Each step takes each node's least neighbour, an aggregate with map-side combining,
    and joins it back; the neighbours of a node of any degree are dealt over tasks (``spread``).  The number of steps
    grows with the logarithm of the longest path."""
    state = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), owner)
    seen = None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both, owner)
        joined = spread(both, least.select("u", F.least("u", "m").alias("m")), ["u"], ["v"], counts=least)
        large = cut(joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), owner)
        least = _least(large, owner)
        small = spread(large, least.select("u", "m"), ["u"], ["v"], counts=least)
        state = cut(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct(), owner)
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return state
        seen = now
