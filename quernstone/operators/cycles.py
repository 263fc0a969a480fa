"""Cycles of a dependency graph: for each strongly connected group, a shortest one through its smallest node."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators.components import connected_components
from quernstone.operators.graph import strong_components
from quernstone.plans import cut, discard, shared_table, ship

#: Edges of a connected part that one task searches; larger parts are searched by joins.
MAX_EDGES = 100_000
_SCHEMA = "component long, length int, cycle array<long>"


def _groups(out: dict[int, list[int]]) -> list[list[int]]:
    """Strongly connected groups of a graph, by Tarjan's algorithm without recursion."""
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    stack, on_stack, found = [], set(), []
    for start in out:
        if start in number:
            continue
        work = [(start, iter(out[start]))]
        number[start] = low[start] = len(number)
        stack.append(start)
        on_stack.add(start)
        while work:
            node, rest = work[-1]
            for to in rest:
                if to not in number:
                    number[to] = low[to] = len(number)
                    stack.append(to)
                    on_stack.add(to)
                    work.append((to, iter(out.get(to, ()))))
                    break
                if to in on_stack:
                    low[node] = min(low[node], number[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    group = []
                    while True:
                        group.append(stack.pop())
                        on_stack.discard(group[-1])
                        if group[-1] == node:
                            break
                    found.append(group)
    return found


def _shortest(out: dict[int, list[int]], root: int) -> list[int]:
    """The shortest way from ``root`` back to it, of those the first in the order of nodes; empty if there is none."""
    came: dict[int, int | None] = {root: None}
    todo = deque([root])
    while todo:
        node = todo.popleft()
        if root in out.get(node, ()):
            way = []
            while node is not None:
                way.append(node)
                node = came[node]
            return way[::-1]
        for to in out.get(node, ()):
            if to not in came:
                came[to] = node
                todo.append(to)
    return []


def _search(part: pd.DataFrame) -> pd.DataFrame:
    out: dict[int, list[int]] = {}
    for a, b in sorted(zip(part["src"].tolist(), part["dst"].tolist(), strict=True)):
        out.setdefault(a, []).append(b)
    rows = []
    for group in _groups(out):
        root = min(group)
        way = _shortest(out, root)
        if way:
            rows.append((root, len(way), way))
    return pd.DataFrame(rows, columns=["component", "length", "cycle"])


def _by_joins(edges: DataFrame) -> DataFrame:
    """The same for (component, src, dst) within strong components: breadth first, ways kept, all components at once."""
    front = cut(edges.select("component").distinct().select("component", F.col("component").alias("node"), F.array("component").alias("way")))
    seen = front.select("component", "node")
    found, steps = None, [front]
    while front.count():
        step = cut(front.join(edges.select("component", F.col("src").alias("node"), "dst"), ["component", "node"]))
        closed = cut(step.where("dst = component").groupBy("component").agg(F.min("way").alias("cycle")))
        found = closed if found is None else found.union(closed)
        new = step.join(closed, "component", "left_anti").select("component", F.col("dst").alias("node"), F.concat("way", F.array("dst")).alias("way"))
        front = cut(new.join(seen, ["component", "node"], "left_anti").groupBy("component", "node").agg(F.min("way").alias("way")))
        seen = cut(seen.union(front.select("component", "node")))
        discard(step)
        steps.append(front)
    discard(*steps)
    return found.select("component", F.size("cycle").alias("length"), "cycle")


def shortest_cycles(edges: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """(component, length, cycle): a shortest cycle through the smallest node of each strongly connected group.

    ``edges`` is (src, dst) of long ids; nulls and repeated edges don't count. A cycle begins with its group's smallest
    node, the first in the order of nodes among the shortest; a node with an edge to itself is a cycle of one. Groups
    without a cycle, single nodes, are left out. Connected parts of at most ``max_edges`` edges are each searched by one
    task; larger ones are cut into strong components first, and those that are still larger are searched by joins.
    """
    spark = edges.sparkSession
    ship(spark)
    e = shared_table(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src is not null and dst is not null").distinct(), "edges")
    weak = connected_components(e.where("src != dst"), "src", "dst").select(F.col("node").alias("src"), F.col("component").alias("part"))
    parts = shared_table(e.join(weak, "src", "left").select("src", "dst", F.coalesce("part", "src").alias("part")), "parts")
    small, large = _split(parts, max_edges)
    out = small.groupBy("part").applyInPandas(_search, _SCHEMA)
    if large is not None:
        strong = strong_components(large.select("src", "dst"))
        inner = large.select("src", "dst").join(strong.select(F.col("node").alias("src"), F.col("component").alias("part")), "src").join(strong.select(F.col("node").alias("dst"), F.col("component").alias("other")), "dst").where("part = other")
        small, large = _split(shared_table(inner.select("src", "dst", "part"), "inner"), max_edges)
        out = out.union(small.groupBy("part").applyInPandas(_search, _SCHEMA))
        if large is not None:
            out = out.union(_by_joins(large.select(F.col("part").alias("component"), "src", "dst")))
    return out


def _split(parts: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges of parts with at most ``most`` of them, and the others, None if there are none."""
    over = shared_table(parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("part"), "large-parts")
    if not over.count():
        return parts, None
    return parts.join(over, "part", "left_anti"), cut(parts.join(over, "part", "left_semi"))
