"""Graph operators over edge tables (src, dst[, weight]).

Iterations run as DataFrame joins; state is cut through reliable checkpoints, and only counts or
one-row sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.plans import broadcast_few, cut, dealt
from quernstone.plans.sizes import FEW_ROWS


def weighted_edges(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight) with parallel edges summed; edges from unknown sources are dropped."""
    out = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return out.join(nodes.select(F.col("node").alias("src")), "src", "left_semi") if nodes is not None else out


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def normalized(edges: DataFrame, beside: Callable[[DataFrame], DataFrame] = lambda total: total) -> DataFrame:
    """Weights divided by their source's sum, joined as ``beside`` says; sources with sum 0 keep no edge."""
    total = edges.groupBy("src").agg(F.sum("weight").alias("_total"))
    return edges.join(beside(total), "src").where("_total != 0").select("src", "dst", (F.col("weight") / F.col("_total")).alias("weight"))


def pagerank(edges: DataFrame, damping: float = 0.85, max_rounds: int = 100, tolerance: float = 1e-6, personal: DataFrame | None = None) -> DataFrame:
    """(node, score) by power iteration from 1/n, with dangling mass dealt out by the teleport vector.

    Stops when scores change by less than ``tolerance`` in sum. ``personal`` is (node, share); nodes
    without a positive share take 1/n, so the vector need not sum to 1.
    """
    edges = cut(weighted_edges(edges))
    nodes = cut(nodes_of(edges))
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("score"))
    # edges stay where they are while there are few nodes, else they are dealt by their source
    n_edges = edges.count()
    here = lambda e: e if n <= FEW_ROWS else dealt(e, n_edges, "src")
    beside = partial(broadcast_few, rows=n)
    out = cut(normalized(here(edges), beside))
    hanging = nodes.join(out.select(F.col("src").alias("node")).distinct(), "node", "left_anti").withColumn("hangs", F.lit(True))
    base = nodes.join(hanging, "node", "left").select("node", F.coalesce("hangs", F.lit(False)).alias("hangs"))
    if personal is not None:
        base = base.join(personal, "node", "left").withColumn("jump", F.when(F.col("share") > 0, F.col("share")).otherwise(1.0 / n)).drop("share")
    else:
        base = base.withColumn("jump", F.lit(1.0 / n))
    state = cut(base.withColumn("score", F.lit(1.0 / n)))
    for _ in range(max_rounds):
        lost = state.where("hangs").agg(F.sum("score")).first()[0] or 0.0
        given = here(out).join(beside(state.select(F.col("node").alias("src"), "score")), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("weight")).alias("got"))
        new = state.join(given, "node", "left").select("node", "hangs", "jump", F.col("score").alias("old"), ((1 - damping) * F.col("jump") + damping * (F.coalesce("got", F.lit(0.0)) + lost * F.col("jump"))).alias("score"))
        new = cut(new)
        moved = new.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0]
        state = new.drop("old")
        if moved < tolerance:
            break
    return state.select("node", "score")


def coupling(edges: DataFrame) -> DataFrame:
    """(node, ca, ce, instability): distinct sources and targets; instability is ce / (ca + ce), 0 if alone."""
    e = edges.select("src", "dst").distinct()
    ce = e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("ce"))
    ca = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("ca"))
    both = ca.join(ce, "node", "full_outer").na.fill(0)
    return both.select("node", "ca", "ce", F.coalesce(F.try_divide(F.col("ce").cast("double"), F.col("ca") + F.col("ce")), F.lit(0.0)).alias("instability"))


def levels(nodes: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, level): 0 for nodes that depend on nothing, else one more than the highest dependency.

    ``edges`` (src, dst) say that src depends on dst; dependencies on unknown nodes don't count.
    Nodes in or behind a cycle get no level. More than ``max_rounds`` levels are an error.
    """
    left = cut(nodes.select("node").distinct())
    open_ = cut(edges.select("src", "dst").distinct().join(left.select(F.col("node").alias("dst")), "dst", "left_semi"))
    done = None
    for level in range(max_rounds):
        ready = cut(left.join(open_.select(F.col("src").alias("node")), "node", "left_anti").withColumn("level", F.lit(level)))
        if not ready.count():
            break
        done = ready if done is None else done.union(ready)
        left = cut(left.join(ready, "node", "left_anti"))
        open_ = cut(open_.join(ready.select(F.col("node").alias("dst")), "dst", "left_anti"))
    else:
        raise RuntimeError(f"there are more than {max_rounds} levels")
    return done if done is not None else left.withColumn("level", F.lit(0))


def ready_nodes(nodes: DataFrame, edges: DataFrame, complete: DataFrame) -> DataFrame:
    """Open nodes whose dependencies are all complete."""
    blocked = edges.join(complete.select(F.col("node").alias("dst")), "dst", "left_anti").select(F.col("src").alias("node"))
    return nodes.select("node").join(complete.select("node"), "node", "left_anti").join(blocked, "node", "left_anti")


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth): nodes within ``depth`` steps of each start, at their shortest distance."""
    seen = cut(start.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")))
    front = seen
    for step in range(1, depth + 1):
        new = front.select("root", F.col("node").alias("src")).join(edges.select("src", "dst"), "src").select("root", F.col("dst").alias("node")).distinct()
        front = cut(new.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(step)))
        seen = seen.union(front)
    return seen


def strong_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component): strongly connected components, named by their smallest node.

    Rounds of colouring: the smallest ancestor of each node is spread forward along edges; the nodes of
    one colour that reach the colour's own node backwards within the colour are its component and leave.
    """
    all_nodes = cut(nodes_of(edges))
    nodes, e = all_nodes, cut(edges.select("src", "dst").where("src != dst").distinct())
    found = None
    for _ in range(max_rounds):
        # a node without both a way in and a way out is a component of its own
        while True:
            core = cut(nodes.join(e.select(F.col("src").alias("node")), "node", "left_semi").join(e.select(F.col("dst").alias("node")), "node", "left_semi"))
            alone = nodes.join(core, "node", "left_anti").select("node", F.col("node").alias("component"))
            found = alone if found is None else found.union(alone)
            settled = core.count() == nodes.count()
            nodes = core
            if settled:
                break
            e = cut(e.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi"))
        if not nodes.count():
            return cut(found)
        color = cut(nodes.select("node", F.col("node").alias("color")))
        while True:
            came = e.join(color.select(F.col("node").alias("src"), "color"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("color").alias("low"))
            new = cut(color.join(came, "node", "left").select("node", F.least("color", F.coalesce("low", "color")).alias("color"), F.col("color").alias("old")))
            changed = new.where("color != old").count()
            color = new.drop("old")
            if not changed:
                break
        inner = cut(e.join(color.select(F.col("node").alias("src"), F.col("color").alias("a")), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("b")), "dst").where("a = b").select("src", "dst"))
        back = cut(color.where("node = color"))
        front = back
        while True:
            front = cut(inner.join(front.select(F.col("node").alias("dst"), "color"), "dst").select(F.col("src").alias("node"), "color").distinct().join(back, ["node", "color"], "left_anti"))
            if not front.count():
                break
            back = cut(back.union(front))
        found = found.union(back.select("node", F.col("color").alias("component")))
        nodes = cut(nodes.join(back, "node", "left_anti"))
        e = cut(e.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def phases(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """(component, size, level, risk): strongly connected groups in dependency order.

    ``scores`` is (node, ca, score); the risk of a group is the mean of 10 ca + 100 score, times 1.5 in a cycle.
    """
    member = strong_components(edges)
    to = lambda side: member.select(F.col("node").alias(side), F.col("component").alias(f"{side}_c"))
    dag = edges.join(to("src"), "src").join(to("dst"), "dst").where("src_c != dst_c").select(F.col("src_c").alias("src"), F.col("dst_c").alias("dst")).distinct()
    group = member.join(scores, "node", "left").na.fill(0).groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.avg(10 * F.col("ca") + 100 * F.col("score")).alias("mean"))
    level = levels(group.select(F.col("component").alias("node")), dag).withColumnRenamed("node", "component")
    return group.join(level, "component").select("component", "size", "level", (F.col("mean") * F.when(F.col("size") > 1, 1.5).otherwise(1.0)).alias("risk"))
