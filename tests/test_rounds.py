"""Queries on odd or grown tables, against plain versions."""

from __future__ import annotations

import random

from quernstone.catalog import queries


def test_cross_file_pairs_counts_links(spark, tmp_path):
    """One row for each part, whatever the size of its shape's group; links as all pairs would give them."""
    rng = random.Random(1)
    parts = [(k, rng.choice(["b1", "b2", "b3", None]), rng.choice(["t1", "t2", None]), rng.choice([None, -3, 0, 1, 11, 12, 23, 24, 25, 26, 50])) for k in range(300)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.p_partkey: (r["class"], r.n_links) for r in queries()["cross_file_pairs"](spark, str(tmp_path)).collect()}
    linked = lambda a, b: None not in (*a, *b) and a[2] == b[2] and a[1] != b[1] and min(a[3], b[3]) > 0 and min(a[3], b[3]) / max(a[3], b[3]) >= 0.92
    assert got == {a[0]: (min(b[0] for b in parts if b[1:] == a[1:]), sum(linked(a, b) for b in parts)) for a in parts}


def test_tasks_stay_small(spark, sf_dir, monkeypatch):
    """Edges and signals are dealt into more partitions when there are more rows, with the same results."""
    from quernstone.plans import sizes
    from quernstone.queries.records import symbol_edges

    names = ("edge_count", "import_signals")
    before = {n: sorted(map(tuple, queries()[n](spark, sf_dir).collect())) for n in names}
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    monkeypatch.setattr(sizes, "TASK_ROWS", 100)
    for n in names:
        assert sorted(map(tuple, queries()[n](spark, sf_dir).collect())) == before[n]
    assert symbol_edges(spark, sf_dir).rdd.getNumPartitions() >= lines // 100
    assert queries()["import_signals"](spark, sf_dir).rdd.getNumPartitions() >= lines // 100


def test_nation_pairs_are_joined_once(spark, sf_dir):
    """What works on the links between nations reads them, not the tables that they come from."""
    from quernstone.queries.graphs import nation_edges

    assert not [f for f in nation_edges(spark, sf_dir).inputFiles() if "lineitem" in f or "orders" in f]


def test_pagerank_with_many_nodes(spark, monkeypatch):
    """Nodes beyond what is broadcast: edges are dealt by their source, and scores stay the same."""
    from quernstone.operators import graph as G
    from quernstone.plans import sizes

    edges = spark.createDataFrame([(k, (k * 7 + j) % 50, float(j + 1)) for k in range(40) for j in range(3)], "src long, dst long, weight double")
    near = {r.node: round(r.score, 9) for r in G.pagerank(edges, max_rounds=5).collect()}
    monkeypatch.setattr(sizes, "FEW_ROWS", 1)
    monkeypatch.setattr(G, "FEW_ROWS", 1)
    monkeypatch.setattr(sizes, "TASK_ROWS", 10)
    assert {r.node: round(r.score, 9) for r in G.pagerank(edges, max_rounds=5).collect()} == near


def test_near_stage_takes_simhash(spark, tmp_path, monkeypatch):
    """Without any candidate of MinHash, SimHash still links near copies; its links below 0.8 don't count."""
    import corpus_pipeline
    from quernstone.llm import near_duplicates as N

    rng = random.Random(3)
    texts = []
    for k in range(30):
        words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
        texts += [" ".join(words), " ".join([*words[:-1], f"last{k}"])]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents"))
    docs = spark.read.parquet(str(tmp_path / "documents"))
    monkeypatch.setattr(N, "candidate_links", lambda keys, heads: keys.select(keys.uid.alias("a"), keys.uid.alias("b")).limit(0))
    got = sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").collect())
    near = {k for k in range(0, 60, 2) if (_bits(texts[k]) ^ _bits(texts[k + 1])).bit_count() <= 4}
    assert near and got == [k for k in range(60) if k % 2 == 0 or k - 1 not in near]
    monkeypatch.setattr(N, "verified", lambda rows, links, least, width: links.limit(0))
    assert corpus_pipeline.near_stage(spark, docs, "").count() == 60


def _bits(text):
    from quernstone.llm.simhash import fingerprint

    return fingerprint(text, 5)


def test_frequent_tokens_come_last(spark):
    """Tokens of most sets, counted by slots, are put behind the rare ones; pairs are those of all pairs."""
    from quernstone.operators import similarity as M

    rng = random.Random(5)
    rows = [(k, sorted({*range(8), *(rng.randrange(1 << 40) for _ in range(12))})) for k in range(300)]
    rows += [(1000 + k, sorted({*rows[k][1][:19], 1 << 50})) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, tokens array<bigint>")
    first = M._prefixes(df, 0.8)
    assert first.where("t < 8").count() == 0
    counts = {r.slot: r.n for r in M._slot_counts(df).collect()}
    assert sum(counts.values()) == sum(len(t) for _, t in rows)
    got = {(r.a, r.b) for r in M.similar_pairs(df, "id", "tokens", 0.8).collect()}
    sets = {k: set(t) for k, t in rows}
    assert got == {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}


def test_measures_are_dealt_out(spark, sf_dir):
    """Texts of one small file are measured by several tasks, equal pairs of a batch once."""
    from quernstone.functions import strings as C
    from quernstone.queries.texts import _neighbours

    assert spark.read.parquet(f"{sf_dir}/part.parquet").rdd.getNumPartitions() == 1
    parts = {r.p: r.n for r in _neighbours(spark, sf_dir).selectExpr("spark_partition_id() AS p").groupBy("p").agg({"p": "count"}).toDF("p", "n").collect()}
    assert len(parts) > 1
    calls = []
    measure = lambda a, b: calls.append((a, b)) or 1.0
    import pandas as pd
    from pyspark.sql import functions as F

    taken = []
    old, F.pandas_udf = F.pandas_udf, lambda f, kind: lambda a, b: taken.append(f)
    try:
        C._pairwise(measure, None, None)
    finally:
        F.pandas_udf = old
    assert taken[0](pd.Series(["a", "a", None]), pd.Series(["b", "b", "b"])).tolist() == [1.0] * 3
    assert sorted(calls) == [("", "b"), ("a", "b")]


def test_index_writes_in_small_batches(spark, tmp_path, monkeypatch):
    """Python gets a bucket's pieces in batches of bounded bytes while the index is written."""
    from quernstone.operators import text_index as T

    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    old = T._with_stems
    plain = spark.conf.get(key, None)

    def watch(terms):
        seen.append(spark.conf.get(key, None))
        return old(terms)

    monkeypatch.setattr(T, "_with_stems", watch)
    T.TextIndex.build(spark.createDataFrame([(1, "some words")], "doc_id long, text string"), "doc_id", ["text"], str(tmp_path / "index"))
    assert seen == ["9000000"] and spark.conf.get(key, None) == plain
