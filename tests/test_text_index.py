"""The stored text index against a plain BM25, through appends, removals and compaction."""

from __future__ import annotations

import math
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernstone.functions.stemming import stem
from quernstone.operators import search as Q
from quernstone.operators import text_index as T
from quernstone.operators.text_index import TextIndex

# Words and stems as published with the algorithm.
PUBLISHED = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat
troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit
rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam
predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl
triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer
airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt
homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas
controll control roll roll generalizations gener oscillators oscil"""

SCHEMA = "id long, title string, body string, kind string, rows int, term string"


SMALL = {"buckets": 4, "block": 8, "held": 300, "split": 5}


def test_stems():
    words = PUBLISHED.split()
    assert [stem(w) for w in words[::2]] == words[1::2]
    assert [stem(w) for w in ("", "a", "is", "éte", "abc1", "s" * 65)] == ["", "a", "is", "éte", "abc1", "s" * 65]


def texts(seed, n, first=0):
    rng = random.Random(seed)
    vocabulary = ["alpha", "alphas", "Beta", "betas", "gamma", "licensed", "license", "é1", "x"]
    out = []
    for k in range(first, first + n):
        words = lambda m: " ".join(rng.choices(vocabulary, [9, 3, 5, 2, 1, 1, 1, 1, 5], k=rng.randint(0, m)))
        out.append((k, words(4), words(40), rng.choice("ab"), 1, "clash"))
    return out


def odd():
    return [(9000, None, None, None, None, None), (9001, "", " ,;\n", "a", 0, ""), (9002, "alpha", "gamma " * 20_000, "b", 0, ""), (9003, "same", "same", "a", 0, ""), (9004, "same", "same", "a", 0, "")]


def plain_bm25(rows, terms, weights, prefix, stems):
    docs = {r[0]: [re.findall(r"[^\W_]+", (x or "").lower()) for x in r[1:3]] for r in rows}
    mean = sum(len(w) for d in docs.values() for w in d) / len(docs)
    by = stem if stems else (lambda w: w)
    fits = (lambda w, t: by(w).startswith(t)) if prefix else (lambda w, t: by(w) == t)
    score = dict.fromkeys(docs, 0.0)
    hit = {k: 0 for k in docs}
    for t in map(by, terms):
        tf = {k: sum(w * sum(fits(x, t) for x in field) for w, field in zip(weights, d, strict=True)) for k, d in docs.items()}
        df = sum(v > 0 for v in tf.values())
        idf = max(math.log((len(docs) - df + 0.5) / (df + 0.5)), 1e-6)
        for k, v in tf.items():
            if v:
                hit[k] += 1
                score[k] += idf * v * 2.2 / (v + 1.2 * (0.25 + 0.75 * sum(map(len, docs[k])) / mean))
    return {k: (round(v, 9), hit[k]) for k, v in score.items() if hit[k]}


def best(scores, k):
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]


WAYS = [(["alpha", "gamma"], {"prefix": False}), (["alph", "be", "é"], {"prefix": True}), (["licensing", "alpha"], {"prefix": False, "stems": True}), (["same"], {"prefix": False}), (["nowhere"], {"prefix": True})]


def check(index, rows, weights=(1.0, 1.0), ways=WAYS[:1]):
    w = dict(zip(("title", "body"), weights, strict=True))
    for terms, how in ways:
        want = plain_bm25(rows, terms, weights, how["prefix"], how.get("stems", False))
        got = {r.id: round(r.score, 9) for r in index.search(terms, weights=w, **how).collect()}
        assert got == pytest.approx({k: s for k, (s, _) in want.items()}, abs=1e-8)
        if ways is not WAYS:
            continue
        every = {r.id for r in index.search(terms, weights=w, every=True, **how).collect()}
        assert every == {k for k, (_, n) in want.items() if n == len(terms)}
        top = [(r.id, r.score) for r in index.search(terms, weights=w, k=5, **how).collect()]
        assert [s for _, s in top] == pytest.approx([s for _, s in best({k: s for k, (s, _) in want.items()}, 5)], abs=1e-6)
        assert all(want[i][0] == pytest.approx(s, abs=1e-6) for i, s in top)


def test_index(spark, tmp_path):
    rows = texts(1, 150) + odd()
    index = TextIndex.build(spark.createDataFrame(rows, SCHEMA).repartition(3), "id", ["title", "body"], str(tmp_path / "ix"), **SMALL)
    check(index, rows, (3.0, 0.5), WAYS)
    # one that is opened again
    check(TextIndex(spark, str(tmp_path / "ix"), "id", ["title", "body"], **SMALL), rows)
    among = spark.createDataFrame([(k,) for k in range(0, 150, 7)], "id long")
    want = plain_bm25(rows, ["alpha"], (1.0, 1.0), False, False)
    got = {r.id: round(r.score, 9) for r in index.search(["alpha"], prefix=False, among=among).collect()}
    assert got == pytest.approx({k: s for k, (s, _) in want.items() if k % 7 == 0 and k < 150})
    assert index.search([]).collect() == [] and index.search([]).columns == ["id", "score"]


def test_index_changes(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    a, b, c = texts(2, 60), texts(3, 40, 60), odd()
    index = TextIndex.build(frame(a), "id", ["title", "body"], str(tmp_path / "ix"), **SMALL)
    index.append(frame(b + c))
    index.remove(frame(b[:25]))
    check(index, a + b[25:] + c)
    new = [(k, "gamma gamma", "alphas", "z", 1, "") for k, *_ in a[:5]]
    index.replace(frame(a[:5]), frame(new))
    check(index, new + a[5:] + b[25:] + c)
    # an unfinished write isn't seen
    spark.createDataFrame([(7,)], "row long").write.parquet(str(tmp_path / "ix/removed/segment=99"))
    check(index, new + a[5:] + b[25:] + c)
    index.compact()
    check(index, new + a[5:] + b[25:] + c)
    index.append(frame(b[:3]))
    check(index, new + a[5:] + b[25:] + c + b[:3])
    assert len(index._live) == 2


def test_index_empty(spark, tmp_path):
    index = TextIndex.build(spark.createDataFrame([], SCHEMA), "id", ["title", "body"], str(tmp_path / "ix"))
    assert index.search(["alpha"]).collect() == []
    rows = texts(5, 20)
    index.append(spark.createDataFrame(rows, SCHEMA))
    check(index, rows)


def test_index_skips(spark, tmp_path):
    """Blocks that can't hold one of the best are not read, and neither are other terms."""
    rows = [(k, "", "alpha " + "x " * (k % 50), "a", 0, "") for k in range(800)]
    index = TextIndex.build(spark.createDataFrame(rows, SCHEMA).coalesce(1), "id", ["body"], str(tmp_path / "ix"), **SMALL)
    top = index.search(["alpha"], prefix=False, k=4)
    assert [r.id for r in top.collect()] == [0, 50, 100, 150]
    blocks, kept = index.skipped
    assert blocks >= 90 and kept <= 10
    postings = spark.read.parquet(str(tmp_path / "ix/postings"))
    assert postings.where("term = 'alpha'").agg(F.sum("n")).first()[0] == 800
    plan = top._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan and "In(term, [alpha])" in plan.replace("EqualTo(term,alpha)", "In(term, [alpha])")
    bucket = postings.where("term = 'alpha'").select("bucket").distinct().collect()
    assert len(bucket) == 1 and postings.where("term = 'x'").select("bucket").distinct().count() == 1


def test_index_many_terms(spark, tmp_path, monkeypatch):
    """A prefix of more words than a filter names."""
    monkeypatch.setattr(T, "MAX_TERMS", 3)
    rows = [(k, "", f"a{k} a{k + 1} b", "a", 0, "") for k in range(30)]
    index = TextIndex.build(spark.createDataFrame(rows, SCHEMA), "id", ["title", "body"], str(tmp_path / "ix"), **SMALL)
    got = {r.id: round(r.score, 9) for r in index.search(["a", "b"]).collect()}
    assert got == pytest.approx({k: s for k, (s, _) in plain_bm25(rows, ["a", "b"], (1.0, 1.0), True, False).items()})
    monkeypatch.setattr(T, "MAX_BLOCKS", 0)
    wide = [(k, "", "alpha " + "x " * (k % 7), "a", 0, "") for k in range(100)]
    index = TextIndex.build(spark.createDataFrame(wide, SCHEMA).coalesce(1), "id", ["body"], str(tmp_path / "ix2"), buckets=4, block=4, held=300, split=3)
    assert [r.id for r in index.search(["alpha"], prefix=False, k=3).collect()] == [0, 7, 14] and index.skipped


def test_rules(spark, tmp_path):
    rows = [(1, "use zod", None, 3, 1), (2, "zod zod use", None, 5, 2), (3, "use zod", 9, 9, 3), (4, "use zod", None, 7, 4), (5, "other", None, 8, 5), (6, "other", None, 8, 6)]
    rules = spark.createDataFrame(rows, "id long, text string, superseded_by long, usage_count int, created int")
    index = TextIndex.build(rules, "id", ["text"], str(tmp_path / "ix"))
    assert {r.id for r in Q.search_rules(index, rules, ["zod", "use"]).collect()} == {1, 2, 4}
    assert [r.id for r in Q.rules_for_tags(index, rules, ["zod"]).collect()] == [2, 4, 1]  # equal scores by use
    assert [r.id for r in Q.rules_for_tags(index, rules, []).collect()] == [6, 5, 4, 2, 1]
    found = Q.filtered_search(index, rules.where("id > 1").select("id", "created"), ["zod"], 2).collect()
    assert len(found) == 2 and 2 in {r.id for r in found} and all(r.relevance > 0 for r in found)
    assert [(r.id, r.relevance) for r in Q.filtered_search(index, rules.where("id < 4").select("id", "created"), [], 2, F.col("created")).collect()] == [(3, 0.0), (2, 0.0)]


def test_words_of_plain_texts(spark):
    """Words that Python finds in texts of Latin-1 are those of the pattern; other texts keep the pattern."""
    every = "".join(chr(c) for c in range(256))
    rows = [every, "", " ", "É", "a", "Ab\0c", "é¼ÅÞß÷×ªº²µÿ", every.upper(), "x" * 70, "ÀB", "c", "ΣΑΣ Ünï", "İx I", " dash—Été"]
    rows += [f"{chr(c)}{chr(383 - c)} {chr(c)}" for c in range(128, 256)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "id long, text string").coalesce(1)
    want = {tuple(r) for r in df.selectExpr("id", r"explode(regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)', 1)) AS w").groupBy("w", "id").count().collect()}
    got = T._unpacked(T._packed(df, "id", ["text"], 0, 4, 16, 1000, 8), "long")
    assert {(r.term, i, n) for r in got.collect() for i, n in zip(r.rows, r.tfs, strict=True)} == want
    assert T._plain_words(pa.array(rows[:11]).slice(3, 4))[0].tolist() == [1, 1, 2, 2]
    terms = ["", "a", "é", "x" * 64, "y" * 65, "ключ", "z" * 500]
    assert T._crc32(pa.array(terms)).tolist() == [zlib.crc32(x.encode()) for x in terms]
    assert T._crc32(pa.array(terms).slice(2, 3)).tolist() == [zlib.crc32(x.encode()) for x in terms[2:5]]


def test_postings_are_dealt_evenly(spark, tmp_path, monkeypatch):
    """Tasks get the same number of buckets, or parts of one, however large the input."""
    rows = spark.createDataFrame([(k, f"a{k} b{k % 7} c") for k in range(200)], "id long, text string").repartition(8)
    index = TextIndex(spark, str(tmp_path / "ix"), "id", ["text"], buckets=8)
    packed = T._packed(rows, "id", ["text"], 0, 8, 16, 32, 8).cache()
    n, size = packed.where("bucket >= 0").count(), packed.selectExpr("sum(octet_length(data))").first()[0]
    for most, tasks, buckets in ((10 * size, 4, 2), (-(-size // 32), 32, 1)):
        monkeypatch.setattr(T, "TASK_BYTES", most)
        dealt = index._by_bucket(packed, size)
        held = dealt.select(F.spark_partition_id().alias("p"), "bucket").distinct().groupBy("p").count().collect()
        assert dealt.rdd.getNumPartitions() == tasks and dealt.count() == n
        assert {r["count"] for r in held} == {buckets} and len(held) > tasks * 3 // 4
    packed.unpersist()


def test_many_words_shuffle_no_postings(spark, tmp_path, monkeypatch):
    """Beyond the words that a filter names, postings meet the dictionary's words without being shuffled."""
    monkeypatch.setattr(T, "MAX_TERMS", 3)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rows = [(k, "", f"a{k} a{k + 1} b", "a", 0, "") for k in range(30)]
    index = TextIndex.build(spark.createDataFrame(rows, SCHEMA), "id", ["title", "body"], str(tmp_path / "ix"), **SMALL)
    plans, plain = [], T.shared_table
    monkeypatch.setattr(T, "shared_table", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or plain(df, name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.id: round(r.score, 9) for r in index.search(["a", "b"]).collect()}
        monkeypatch.setattr(T, "BROADCAST_TERMS", 0)
        assert {r.id: round(r.score, 9) for r in index.search(["a", "b"]).collect()} == pytest.approx(got)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == pytest.approx({k: s for k, (s, _) in plain_bm25(rows, ["a", "b"], (1.0, 1.0), True, False).items()})
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0] and "StringStartsWith(term,a)" in plans[0]
    assert "SortMergeJoin" in plans[1]
