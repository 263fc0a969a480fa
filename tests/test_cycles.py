"""Shortest cycles against a search from every group's smallest node."""

from __future__ import annotations

import random

import pytest

from quernstone.operators.cycles import shortest_cycles


def plain(pairs):
    """{smallest node: first shortest cycle} by enumerating ways."""
    out = {}
    for a, b in set(pairs):
        out.setdefault(a, set()).add(b)
    reach = {}
    for n in {x for p in pairs for x in p}:
        seen, todo = set(), [n]
        while todo:
            for t in out.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        reach[n] = seen
    found = {}
    for n, r in reach.items():
        if n in r and n == min(x for x in r if n in reach[x]):
            ways = [[n]]
            while not (closed := [w for w in ways if n in out.get(w[-1], ())]):
                ways = [[*w, t] for w in ways for t in sorted(out.get(w[-1], ())) if t not in w]
            found[n] = min(closed)
    return found


@pytest.mark.parametrize("most", [100_000, 5, 0])
def test_cycles(spark, most):
    rng = random.Random(4)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)]
    pairs += [(100, 101), (101, 102), (102, 100), (102, 103), (200, 200), (300, 301), (400, 403), (403, 400), (400, 402), (402, 400), (500, 501), (501, 502), (502, 503), (503, 500), (500, 502)]
    df = spark.createDataFrame([*pairs, *pairs[:5], (None, 1), (1, None)], "src long, dst long")
    got = {r.component: r.cycle for r in shortest_cycles(df, most).collect()}
    assert got == plain(pairs)


def test_ring(spark):
    df = spark.createDataFrame([(k, (k + 1) % 1000) for k in range(1000)], "src long, dst long")
    (r,) = shortest_cycles(df).collect()
    assert (r.component, r.length, r.cycle) == (0, 1000, list(range(1000)))
    assert shortest_cycles(df.limit(0)).collect() == []
