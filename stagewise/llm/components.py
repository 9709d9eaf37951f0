"""Connected components of a distributed edge list, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise import scratch


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for every node of an edge; no edges, no rows.

    Each round points every node's larger neighbours, then its smaller ones and itself, at the least
    node near (large-star, small-star); the forest is done when a round changes nothing, after
    O(log^2 n) rounds. Both steps of a round are written tables, so lineage and plans stay short: the
    driver keeps each plan's text and metrics. Nothing but a count reaches it. A node's neighbours are only ever reduced to their minimum, never gathered,
    and edges repeat to each neighbour by a join that can be split, so hot nodes do no harm.
    """
    now = scratch.table(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "components"
    )
    before = state(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # written, as both halves of the next step read it: in one plan it would be there twice
        large = scratch.table(large.filter("u > v").distinct(), "large-stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = scratch.table(small.filter("u > v").distinct(), "components")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # a settled forest has one edge from each node to its root
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
