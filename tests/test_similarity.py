"""Leader clusters, least similarities and token links against plain versions."""

from __future__ import annotations

import random

import pytest

from quernstone.operators import similarity as M


def one_pass(pairs, nodes):
    """Leaders as a loop over nodes in order finds them."""
    near = set(pairs)
    leaders, out = [], {}
    for n in sorted(nodes):
        out[n] = next((x for x in leaders if (x, n) in near), n)
        if out[n] == n:
            leaders.append(n)
    return out


@pytest.mark.parametrize("few", [0, 4, 10_000])
def test_leaders(spark, few):
    rng = random.Random(few)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(70)} | {(100 + k, 101 + k) for k in range(7)} | {(200, k) for k in range(201, 230)}
    pairs |= {(300, 302), (301, 302), (299, 301), (298, 300)}  # 302 meets 301 and 300, which leave late
    df = spark.createDataFrame([*pairs, (5, 5), next(iter(pairs))], "a long, b long")
    got = {r.node: r.leader for r in M.leader_clusters(df, few).collect()}
    assert got == one_pass(pairs, {x for p in pairs for x in p})
    assert M.leader_clusters(df.limit(0)).collect() == []


def plain_jaccard(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def test_least_similarity(spark):
    rng = random.Random(9)
    rows = []
    for g in range(12):
        base = set(rng.sample(range(40), 14))
        for _ in range(rng.randint(1, 25)):
            rows.append((g, sorted((base - set(rng.sample(sorted(base), rng.randint(0, 4)))) | set(rng.sample(range(40), rng.randint(0, 4))))))
    rows += [(20, [1, 2])] * 300 + [(21, [1]), (21, [2])] + [(22, []), (22, None), (23, [1]), (23, None), (24, [3]), (None, [1, 2]), (None, [1, 3])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "g int, set array<int>, n string").repartition(3)
    want = {}
    for g in {r[0] for r in rows}:
        own = [set(s or []) for h, s in rows if h == g]
        if len(own) > 1:
            want[g] = (len(own), len({frozenset(x) for x in own}), min(plain_jaccard(a, b) for i, a in enumerate(own) for b in own[:i]))
    got = {r.g: (r.n, r.n_sets, r.least) for r in M.least_similarity(df, "g", "set").collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert {k: v[2] for k, v in got.items()} == pytest.approx({k: v[2] for k, v in want.items()})
    rough = {r.g: r.least for r in M.least_similarity(df, "g", "set", floor=0.5).collect()}
    assert all((rough[k] == pytest.approx(v[2])) if v[2] >= 0.5 else rough[k] <= 1.0 and (rough[k] < 0.5 or rough[k] >= v[2]) for k, v in want.items())
    assert M.least_similarity(df.limit(0), "g", "set").collect() == []


def test_pairs_in_blocks(spark, monkeypatch):
    """A group of near copies that is cut into blocks gives the same pairs; ids and tokens may be strings."""
    monkeypatch.setattr(M, "MET", 240)
    rng = random.Random(5)
    base = [f"t{k}" for k in range(60)]
    sets = {f"r{k:03d}": set(base) - set(rng.sample(base, 3)) | {f"x{k}"} for k in range(30)} | {f"s{k}": set(rng.sample(base, 20)) for k in range(10)}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id string, set array<string>").repartition(3)
    want = {(a, b): plain_jaccard(sets[a], sets[b]) for a in sets for b in sets if a < b and plain_jaccard(sets[a], sets[b]) >= 0.8}
    got = {(r.a, r.b): r.similarity for r in M.similar_pairs(df, "id", "set", 0.8).collect()}
    assert len(want) > 200 and got == pytest.approx(want)
    only = spark.createDataFrame([(f"r{k:03d}",) for k in range(0, 30, 2)], "id string")
    got = {(r.a, r.b) for r in M.similar_pairs(df, "id", "set", 0.8, only).collect()}
    assert got == {p for p in want if all(int(x[1:]) % 2 == 0 for x in p)}


def test_token_links(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(30)]
    rows = []
    for k in range(60):
        own = words[: 25 + k % 3]
        rng.shuffle(own)
        rows.append((k, f"f{k % 4}", " ".join(own) + (" w1" * (60 if k % 7 == 0 else 0))))
    rows += [(100, "f0", None), (101, "f1", ""), (102, None, "a b"), (103, None, "b a"), (104, "f1", "a  b"), (105, "f1", "b a"), (106, "f2", "a b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, file string, text string, class int").repartition(3)

    def near(x, y):
        a, b = set((x or "").split()), set((y or "").split())
        n, m = len(x or ""), len(y or "")
        return bool(a) and abs(n - m) <= 0.5 * max(n, m) and plain_jaccard(a, b) >= 0.92 - 1e-9

    got = {r.id: (r["class"], r.n_links) for r in M.token_links(df, "id", "file", "text").collect()}
    for i, f, x in rows:
        same = min(j for j, _, y in rows if set((y or "").split()) == set((x or "").split()) and len(y or "") == len(x or ""))
        assert got[i] == (same, sum(g != f and near(x, y) for _, g, y in rows)), i
    assert len(got) == len(rows)
