"""Connected components of an edge table, by alternating stars over durable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hot_join, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b), a materialized table; root is the least node of its component.

    Large and small stars in turn (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014) until an
    iteration changes nothing. Each step needs the least neighbour of a node only, which is a partial aggregate, and
    a join that gives it to the node's edges, in which a hot node's edges are dealt over many tasks. Nulls and loops are
    ignored.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e)
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = state(e)
    while seen[0]:
        # large star: the larger neighbours of a node go to the least one among all neighbours and itself
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        up = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        moved = hot_join(up, least, "u", "v", rows=seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = moved.filter("u <> v").distinct()
        # small star: the smaller neighbours, and the node itself, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        before, e = e, materialize(small)
        discard(before)
        last, seen = seen, state(e)
        if seen == last:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
