"""Weighted similarity of records of several fields against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quernstone.functions.scoring import match_action, match_reason
from quernstone.operators import record_similarity as R

SETS, SAME = {"title": 0.4, "body": 0.3, "tags": 0.2}, {"kind": 0.1}
SCHEMA = "id long, title array<string>, body array<string>, tags array<string>, kind string, project string, place int, tokens string"


def jaccard(a, b):
    a, b = ({x for x in s or [] if x is not None} for s in (a, b))
    return len(a & b) / len(a | b) if a and b else 0.0


def alike(x, y):
    return jaccard(x[1], y[1]) * 0.4 + jaccard(x[2], y[2]) * 0.3 + jaccard(x[3], y[3]) * 0.2 + (x[4] == y[4]) * 0.1


def some_rows():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(25)]
    rows = []
    for g in range(14):
        title, body = rng.sample(words, 5), rng.sample(words, 12)
        for _ in range(rng.randint(1, 8)):
            own = [w for w in body if rng.random() < 0.8] + rng.sample(words, rng.randint(0, 3))
            rows.append((title[: rng.randint(2, 5)], own, rng.sample("abc", rng.randint(0, 3)), rng.choice(["x", "y", None]), rng.choice(["p", "q", None])))
    rows += [(["t"], ["b", "c"], [], "x", "p")] * 9 + [(["t"], ["b", "c"], ["a"], "x", "p")] * 4
    rows += [(None, None, None, None, None), ([], [], [], None, None), ([None], ["b"], [None, "a"], "x", "p"), ([], ["b"], ["a"], "x", "p")]
    return [(k, *r, k % 3, "z") for k, r in enumerate(rows)]


@pytest.mark.parametrize(("least", "leads", "some"), [(0.5, None, 60), (0.5, ["title", "body"], 60), (0.8, ["body"], 8), (0.35, None, 90)])
def test_all_pairs(spark, least, leads, some):
    rows = some_rows()
    df = spark.createDataFrame([*rows, (None, *rows[0][1:]), rows[3], rows[3]], SCHEMA).repartition(3)
    want = {(x[0], y[0]): alike(x, y) for x in rows for y in rows if x[0] < y[0] and x[5] == y[5] and alike(x, y) >= least}
    members, pairs = R.similar_records(df, "id", SETS, SAME, least, "project", leads)
    by_class, own = {}, {}
    for m in members.collect():
        by_class.setdefault(m["class"], []).append(m.id)
        own[m["class"]] = m.own
    assert sorted(i for ids in by_class.values() for i in ids) == [r[0] for r in rows]
    assert all(c == min(ids) for c, ids in by_class.items()) and max(map(len, by_class.values())) >= 9
    found = pairs.collect()
    got = {tuple(sorted((i, j))): p.similarity for p in found for i in by_class[p.a] for j in by_class[p.b]}
    got |= {(i, j): own[c] for c, ids in by_class.items() for i in ids for j in ids if i < j and own[c] >= least}
    assert len(want) > some and got == pytest.approx(want)
    # pairs of names only, each once
    assert len(found) == len({(p.a, p.b) for p in found}) and all(p.a in by_class and p.b in by_class for p in found)
    links = {r.id: (r["class"], r.n_links) for r in R.record_links(members, pairs, least).collect()}
    assert {i: n for i, (_, n) in links.items()} == {r[0]: sum(r[0] in p for p in want) for r in rows}


def test_single_values_and_places(spark):
    """Without ``within`` all records meet; a null value equals null and no other, whatever its type."""
    rows = [(1, ["a", "b"], 0), (2, ["a", "b"], None), (3, ["b", "a"], None), (4, ["c"], 0)]
    df = spark.createDataFrame(rows, "id int, f array<string>, n int")
    recs = R.records(df, "id", {"f": 0.6}, {"n": 0.4})
    got = {(p.a, p.b): p.similarity for p in R.record_pairs(recs, {"f": 0.6}, {"n": 0.4}, 0.5).collect()}
    assert got == pytest.approx({(1, 2): 0.6, (1, 3): 0.6, (2, 3): 1.0})
    assert [p.asDict() for p in R.record_pairs(recs, {"f": 0.6}, {"n": 0.4}, 0.9).collect()] == [{"a": 2, "b": 3, "similarity": 1.0, "f_similarity": 1.0, "n_similarity": 1.0}]


def test_empty_and_refused(spark):
    none = spark.createDataFrame([], SCHEMA)
    members, pairs = R.similar_records(none, "id", SETS, SAME, 0.5, "project")
    assert members.collect() == [] and pairs.collect() == [] and R.record_links(members, pairs).collect() == []
    with pytest.raises(ValueError, match="alone"):  # title, tags and kind reach 0.7 without the body
        R.lead_bound(SETS, SAME, 0.7, ["body"])
    with pytest.raises(ValueError, match="fields"):
        R.records(none, "id", {})


def test_action_and_reason(spark):
    rows = [
        (0.9, True, 0.7, "bug", "bug", ["a", "b"], ["b"], ["f"], ["f"], "delete-older", "similar titles, both bugs, shared tags: b, same feature: f"),
        (0.9, False, 0.6, "bug", "fix", ["b", "a"], ["a", "b"], None, ["f"], "merge", "shared tags: b, a"),
        (0.8, True, 0.5, None, None, [], ["b"], [], [], "merge", "both unknowns"),
        (0.5, True, 0.1, "bug", None, None, None, None, None, "keep-both", "50% similar"),
    ]
    df = spark.createDataFrame(rows, "s double, same boolean, t double, k string, l string, g array<string>, h array<string>, e array<string>, f array<string>, action string, reason string")
    c = F.col
    out = df.select("action", "reason", match_action(c("s"), c("same")).alias("x"), match_reason(c("s"), c("t"), (c("k"), c("l")), (c("g"), c("h")), (c("e"), c("f"))).alias("y"))
    assert [(r.x, r.y) for r in out.collect()] == [(r.action, r.reason) for r in out.collect()]
