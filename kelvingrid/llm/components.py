"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kelvingrid.session import cut_lineage


def _mark(edges: DataFrame) -> tuple[int, int]:
    n, x = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return n, x or 0


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node that is not its own label.

    ``edges`` holds (u, v) longs in any direction; loops and repeated edges do no harm.  A node's least neighbour is
    found by partial aggregation, so a hub of a third of all edges is not gathered.  Each round is checkpointed.
    """
    e = cut_lineage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large stars hang every greater neighbour on the least one; small stars do so with the smaller neighbours
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        after = _mark(e)
        if after == before:
            break
        before = after
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
