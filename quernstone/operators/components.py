"""Connected components by alternating large-star and small-star contraction.

Both steps only ever need the smallest neighbour of a node (a partially
aggregated minimum) and one equi-join on the node, so a hub with a third of
all edges is combined map-side and its join partition can be split by AQE.
The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.plans.shared import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v in, the same form out.

    large: every larger neighbour of a node is tied to the node's smallest
    neighbour (itself included). small: a node and its smaller neighbours are
    tied to the smallest of them.
    """
    if large:
        nb = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        nb = edges.select("u", "v")
    low = nb.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        low = low.select("u", F.least("u", "m").alias("m"))
        out = nb.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        tied = nb.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = tied.union(low.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node id reachable.

    Only nodes that occur in an edge between different nodes are returned;
    edges with a null end are ignored. Raises if ``max_rounds`` is not enough,
    rather than returning unfinished labels.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a != b")
    e = cut(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        e = cut(_star(_star(e, True), False))
        # a star forest is a fixed point: its edge set no longer changes
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
