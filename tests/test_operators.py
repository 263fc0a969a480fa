from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quernstone.functions import strings as C
from quernstone.functions import text as X
from quernstone.operators import graph as G
from quernstone.operators import relational as R
from quernstone.operators import retrieval as S
from quernstone.operators import similarity as M
from quernstone.operators.components import connected_components


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def union_find(pairs):
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    return {x: find(x) for x in top}


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 230)]
    got = {r.node: r.component for r in connected_components(edges(spark, pairs), "src", "dst").collect()}
    want = {k: v for k, v in union_find(pairs).items() if k in got}
    assert got == want
    assert connected_components(edges(spark, []), "src", "dst").count() == 0
    assert connected_components(edges(spark, [(1, 1), (None, 2)]), "src", "dst").count() == 0


def test_pagerank(spark):
    e = edges(spark, [(1, 2), (1, 3), (2, 3), (3, 1), (4, 3), (3, 5)]).withColumn("weight", F.lit(1.0))
    got = {r.node: r.score for r in G.pagerank(e).collect()}
    assert sum(got.values()) == pytest.approx(1)
    out = {1: [2, 3], 2: [3], 3: [1, 5], 4: [3], 5: []}
    score = dict.fromkeys(out, 0.2)
    for _ in range(200):
        new = dict.fromkeys(out, 0.15 / 5)
        for n, to in out.items():
            for t in to or out:
                new[t] += 0.85 * score[n] / len(to or out)
        score = new
    assert got == pytest.approx(score, abs=1e-5)


def test_strong_components_and_phases(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1), (7, 7), (8, 9)])
    got = {r.node: r.component for r in G.strong_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 9}
    scores = spark.createDataFrame([(n, 1, 0.1) for n in range(1, 10)], "node long, ca int, score double")
    phase = {r.component: (r["size"], r.level, round(r.risk, 3)) for r in G.phases(e, scores).collect()}
    assert phase[4] == (2, 0, 30.0) and phase[1] == (3, 1, 30.0) and phase[6] == (1, 2, 20.0)


def test_levels_and_reach(spark):
    nodes = spark.createDataFrame([(n,) for n in range(1, 7)], "node long")
    e = edges(spark, [(2, 1), (3, 2), (3, 1), (4, 99), (5, 6), (6, 5)])
    assert {r.node: r.level for r in G.levels(nodes, e).collect()} == {1: 0, 2: 1, 3: 2, 4: 0}
    ready = G.ready_nodes(nodes, e, nodes.where("node = 1"))
    assert {r.node for r in ready.collect()} == {2}
    near = G.reach(e, nodes.where("node = 3"), 2)
    assert {(r.node, r.depth) for r in near.collect()} == {(3, 0), (2, 1), (1, 1)}


def test_coupling(spark):
    got = {r.node: (r.ca, r.ce, r.instability) for r in G.coupling(edges(spark, [(1, 2), (1, 2), (3, 2), (2, 4)])).collect()}
    assert got == {1: (0, 1, 1.0), 2: (2, 1, pytest.approx(1 / 3)), 3: (0, 1, 1.0), 4: (1, 0, 0.0)}


def test_strings(spark):
    df = spark.createDataFrame([("martha", "marhta"), ("", ""), ("", "x"), ("abc", "abc"), ("abc", "xyz"), ("dixon", "dicksonx")], "a string, b string")
    m = C.measures(spark, F.col("a"), F.col("b"))
    got = {(r.a, r.b): r for r in df.select("a", "b", *[c.alias(k) for k, c in m.items()]).collect()}
    assert got["martha", "marhta"].jaro == pytest.approx(0.944444, abs=1e-6)
    assert got["martha", "marhta"].jaro_winkler == pytest.approx(0.961111, abs=1e-6)
    assert got["dixon", "dicksonx"].jaro == pytest.approx(0.766667, abs=1e-6)
    assert got["martha", "marhta"].lcs == pytest.approx(5 / 6)
    assert got["", ""].jaccard == got["", ""].dice == got["", ""].lcs == 1
    assert got["", "x"].jaccard == got["", "x"].jaro == got["", "x"].cosine == 0
    assert got["abc", "abc"].combined == pytest.approx(1) and got["abc", "xyz"].combined == 0
    for r in got.values():
        assert r.jaccard <= r.dice + 1e-12


def test_text_functions(spark):
    df = spark.createDataFrame([("Decided to use tRPC for type safety in API routes. See src/a/b.ts and features/booking/x",)], "t string")
    r = df.select(X.extract_tags(F.col("t")).alias("tags"), X.extract_features(F.col("t")).alias("features"), X.extract_files(F.col("t")).alias("files"), X.first_match(F.col("t"), X.TYPE_KEYWORDS).alias("kind"), X.entropy(F.lit("aabb")).alias("bits"), X.redact(F.lit("abcdefghijklmnop")).alias("red"), X.redact(F.lit("short")).alias("all"), X.complexity(F.lit("if (a && b) { for (;;) {} }")).alias("cx")).first()
    assert {"api", "trpc", "ts"} <= set(r.tags) and r.features == ["booking"] and r.files == ["src/a/b.ts"]
    assert r.kind == "decision" and r.bits == 1.0 and r.red == "abcd********mnop" and r.all == "*****" and r.cx == 4
    assert X.like_pattern("50%_x", "contains") == r"%50\%\_x%"
    assert X.sanitize_query('foo AND "bar" -baz*') == "foo bar baz"
    named = spark.createDataFrame([("API_KEY", "a1b2c3d4e5f6g7h8i9j0k1l2m3n4o5p6"), ("color", "a1b2c3d4e5f6g7h8i9j0k1l2m3n4o5p6"), ("API_KEY", "a" * 33)], "n string, v string")
    assert [x[0] for x in named.select(X.named_secret(F.col("n"), F.col("v"))).collect()] == ["generic-api-key", None, None]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, [1.0])], "id long, v array<double>")
    got = [(r.id, r.similarity) for r in S.nearest(df, "id", "v", [1.0, 0.0], 9).collect()]
    assert got == [(1, 1.0), (2, 0.0), (4, 0.0), (3, -1.0)]
    assert [r.similarity for r in S.nearest(df.where("id < 3"), "id", "v", [1.0, 0.0], 9, similarity=S.l2_similarity).collect()] == [1.0, 0.0]
    full = S.fuse(spark.createDataFrame([(1, 4.0), (2, 2.0)], "id long, score double"), spark.createDataFrame([(2, 1.0), (7, 0.5)], "id long, similarity double"), "id", full=True)
    assert {r.id: r.score for r in full.collect()} == {1: 50.0, 2: 75.0, 7: 25.0}


def test_similar_pairs(spark):
    rng = random.Random(2)
    sets = [(k, sorted({rng.randrange(40) for _ in range(rng.randrange(1, 14))})) for k in range(80)] + [(100, []), (101, [])]
    sets += [(200 + k, sets[k][1] + [99 + k]) for k in range(20)]
    df = spark.createDataFrame(sets, "id long, s array<long>")
    members, reps = M.classes(df, "id", "s")
    got = {(r.a, r.b): round(r.similarity, 9) for r in M.similar_pairs(reps, "class", "set", 0.8).collect()}
    first: dict = {}
    for i, s in sets:
        first.setdefault(tuple(s), i)
    want = {}
    for a, x in ((i, set(s)) for s, i in first.items()):
        for b, y in ((i, set(s)) for s, i in first.items()):
            if a < b and x and y and len(x & y) / len(x | y) >= 0.8:
                want[a, b] = round(len(x & y) / len(x | y), 9)
    assert got == want and want
    assert {r.id: r["class"] for r in members.collect()} == {i: first[tuple(s)] for i, s in sets}


def test_clusters(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (7, 9, 1.0)], "a long, b long, similarity double")
    got = {r.component: (r["size"], round(r.mean_similarity, 6)) for r in M.clusters(pairs).collect()}
    assert got == {1: (3, 0.85), 7: (2, 1.0)}


def test_abstract_tokens(spark):
    from quernstone.functions import code

    src = 'function go(x) { const a = new Foo(1, "s"); return a.load(x.id) ; }'
    r = spark.createDataFrame([(src,)], "c string").select(code.abstract_tokens(F.col("c")).alias("t"), code.env_severity(F.lit("STRIPE_MODE")).alias("e"), code.fingerprint_complexity(F.array(*[F.lit(x) for x in "if ( V ) { { F ( ) } }".split()])).alias("c")).first()
    assert " ".join(r.t) == "function F ( V ) { const V = new F ( N , S ) ; return V . M ( V . P ) ; }"
    assert r.e == "high" and r.c == 49


def test_overlaps(spark):
    rng = random.Random(9)
    iv = [(k, k % 3, s := rng.randrange(300), s + rng.randrange(120)) for k in range(90)]
    df = spark.createDataFrame(iv, "id long, k long, s long, e long")
    got = {(r.a, r.b) for r in R.overlaps(df, "k", "id", "s", "e", 25).collect()}
    want = {(a[0], b[0]) for a in iv for b in iv if a[1] == b[1] and a[0] < b[0] and a[2] <= b[3] and b[2] <= a[3]}
    assert got == want
    assert R.overlaps(df, "k", "id", "s", "e", 25).count() == len(want)


def test_upsert_and_zero_fill(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "id long, x string, y int")
    new = spark.createDataFrame([(2, None, 7), (3, "c", 8)], "id long, x string, y int")
    assert {tuple(r) for r in R.upsert(base, new, ["id"]).collect()} == {(1, "a", 5), (2, "b", 7), (3, "c", 8)}
    counts = spark.createDataFrame([("a", 2)], "k string, n long")
    assert {tuple(r) for r in R.zero_filled(counts, "k", "n", ["a", "b"]).collect()} == {("a", 2), ("b", 0)}


def test_null_keys(spark):
    """Null groups and null values keep their rows."""
    df = spark.createDataFrame([(1, None, 5), (2, "a", None), (3, "a", 7), (4, None, 9)], "id long, g string, v int")
    got = {r.id: r.p for r in R.percentile_n(df, ["g"], "v", "p").collect()}
    assert got == {1: 0, 4: 50, 2: 0, 3: 50}
    assert R.percentile_n(df, [], "v", "p").count() == 4


def test_nearest_many(spark):
    rng = random.Random(2)
    rows = [(k, [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)]) for k in range(60)] + [(100, None), (101, [1.0, 2.0]), (102, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(4)
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5, 9) if any(a) and any(b) else 0.0
    known = [r for r in rows if r[0] is not None and r[1]]
    for block in (2, 100):
        got = {}
        for r in S.nearest_many(df, df.where("id % 20 = 0 or id = 101"), "id", "v", 5, 0.1, block=block).collect():
            got.setdefault(r.query_id, []).append(round(r.similarity, 9))
        for i, q in known:
            if i % 20 == 0 or i == 101:
                want = sorted((s for _, v in known if len(v) == len(q) and (s := cos(q, v)) >= 0.1), reverse=True)[:5]
                assert sorted(got.get(i, []), reverse=True) == want
    assert S.nearest_many(df, df.limit(0), "id", "v", 5).count() == 0


def test_env_severity(spark):
    from quernstone.functions import code

    want = {"DATABASE_URL": "critical", "PUBLIC_HOST": "low", "LOG_LEVEL": "medium", "NEXT_PUBLIC_TOKEN": "medium", "TURSO_X": "high", "HREF": "medium", "": "low", "__": "low", "A_B": "low", "PRIVATE_KEY": "critical", "CLIENT_PRIVATE_KEY": "high"}
    df = spark.createDataFrame([(k,) for k in want], "name string")
    assert {r.name: r.s for r in df.select("name", code.env_severity(F.col("name")).alias("s")).collect()} == want
    shape = spark.createDataFrame([("const a = `x ${b}`; if (null) f.g(true)",)], "c string").select(code.abstract_tokens(F.col("c")).alias("t")).first().t
    assert shape == ["const", "V", "=", "S", ";", "if", "(", "X", ")", "V", ".", "M", "(", "B", ")"]
