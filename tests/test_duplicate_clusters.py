"""Clusters of near duplicates count every document and every pair of documents, against all pairs."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from quernstone.catalog import oracle_sql, queries
from quernstone.operators import similarity as M


def shingles(text):
    ws = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def plain_clusters(sets):
    """{component: (size, mean similarity)} of {id: set}, by comparing each two rows."""
    top, near = {k: k for k in sets}, {}
    for a in sets:
        for b in sets:
            if a < b and sets[a] & sets[b] and len(sets[a] & sets[b]) >= (0.8 - 1e-9) * len(sets[a] | sets[b]):
                near[a, b] = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for _ in sets:
        for a, b in near:
            top[a] = top[b] = min(top[a], top[b])
    size, sims = defaultdict(int), defaultdict(list)
    for k in sets:
        size[top[k]] += 1
    for (a, _), s in near.items():
        sims[top[a]].append(s)
    return {k: (size[k], sum(v) / len(v)) for k, v in sims.items()}


def documents(spark, path, texts):
    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")


def found(spark, d, name):
    rows = queries()[name](spark, str(d)).collect()
    assert len({r.component for r in rows}) == len(rows)
    return {r.component: (r["size"], r.mean_similarity) for r in rows}


def close(want):
    return {k: (n, pytest.approx(s, abs=1e-6)) for k, (n, s) in want.items()}


def grown(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def test_copies_count(spark, tmp_path):
    """Copies alone are a cluster, copies of near duplicates count in theirs; texts without a word have none."""
    rng, texts = random.Random(4), []
    for k in range(14):
        words = grown(rng, 60)
        texts += [" ".join(words)] * (1 + k % 4)
        for j in range(k % 3):
            words = [*words[: 3 * j], *words[3 * j + 1 :], f"end{k}"]
            texts += [" ".join(words)] * (1 + (k + j) % 3)
    texts += ["Two  words", "two words!", "two words more", "é", "É", None, None, "", "", "...", "..."]
    rng.shuffle(texts)
    texts = dict(enumerate(texts))
    documents(spark, tmp_path, texts)
    want = plain_clusters({k: shingles(t) for k, t in texts.items()})
    assert {n for n, s in want.values() if s == 1} and any(s < 1 for _, s in want.values())
    assert found(spark, tmp_path, "duplicate_clusters") == close(want)


def test_clusters_of_the_tables(spark, sf_dir, duck):
    """The same groups and sizes as SQL gives, the same means as all pairs."""
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    got = found(spark, sf_dir, "duplicate_clusters")
    assert got == close(plain_clusters({k: shingles(t) for k, t in texts.items()}))
    assert {k: n for k, (n, _) in got.items()} == dict(duck.sql(f"SELECT component, n FROM ({oracle_sql()['least_group_similarity']})").fetchall())


def test_counted_by_classes(spark):
    """A million copies of one row and a thousand of a near one are counted, not paired; strings can be ids."""
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8)], "a string, b string, similarity double")
    copies = spark.createDataFrame([("a", 1_000_000), ("b", 1000), ("z", 3)], "class string, n long")
    got = {r.component: (r["size"], r.mean_similarity) for r in M.clusters(pairs, copies).collect()}
    own, ab, bc = 1_000_000 * 999_999 // 2 + 1000 * 999 // 2, 10**9, 1000
    assert got == {"a": (1_001_001, pytest.approx((own + 0.9 * ab + 0.8 * bc) / (own + ab + bc))), "z": (3, 1.0)}
    none = M.clusters(pairs.limit(0), copies.limit(0))
    assert none.collect() == []


def test_candidates_count_documents(spark, tmp_path):
    """Five documents are enough, be they copies, near copies or both; four aren't."""
    rng, texts, n = random.Random(6), {}, 0
    for copies, near in [(5, 0), (4, 0), (3, 2), (2, 2), (1, 4), (1, 3), (0, 0)]:
        words = grown(rng, 80)
        for t in [" ".join(words).upper()] + [" ".join(words)] * (copies - 1) + [" ".join([*words, f"end{j}"]) for j in range(near)]:
            texts[n], n = t, n + 1
    documents(spark, tmp_path, texts)
    want = plain_clusters({k: shingles(t) for k, t in texts.items()})
    got = found(spark, tmp_path, "skill_candidates")
    assert [n for n, _ in got.values()] == [5, 5, 5] and got == close({k: v for k, v in want.items() if v[0] >= 5})
