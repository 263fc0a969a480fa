"""The stored vector index against a scan of all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators.vector_index import VectorIndex
from quernstone.queries import retrieval

SCHEMA = "id long, v array<float>, cell int, n int, label string"


def plain(rows, queries, k, dims):
    held = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, v, *_ in queries:
        if v is None or len(v) != dims:
            continue
        v = np.array(v, np.float32).astype(float)
        cos = lambda u: float(u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v))) if u.any() and v.any() else 0.0  # noqa: E731, B023
        out[q] = sorted(((-cos(u), i) for i, u in held))[:k]
    return out


def clustered(n=1200, groups=12, dims=16):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(groups, dims))
    return [(k, [float(x) for x in centres[k % groups] + 0.2 * rng.normal(size=dims)], 1, 2, "x") for k in range(n)]


def test_cells(spark, tmp_path):
    rows = clustered()
    odd = [(5000, None, 1, 1, ""), (5001, [1.0], None, None, None), (5002, rows[0][1][:-1] + [None], 1, 1, ""), (5003, [0.0] * 16, 1, 1, ""), (None, rows[0][1], 1, 1, ""), rows[3], rows[3], (5004, [float("nan")] * 16, 1, 1, "")]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(4)
    index = VectorIndex.build(df, "id", "v", str(tmp_path / "ix"), cells=24)
    asked = rows[::40] + odd[:2] + [odd[3]]
    queries = spark.createDataFrame(asked, SCHEMA)
    want = plain(rows + odd, asked, 10, 16)
    exact = index.exact(queries, "id", "v", 10).collect()
    got = {}
    for r in exact:
        got.setdefault(r.query_id, []).append((-r.similarity, r.id))
    assert set(got) == set(want)
    for q in want:
        assert [s for s, _ in sorted(got[q])] == pytest.approx([s for s, _ in want[q]], abs=1e-12)
        assert q == 5003 or {i for _, i in got[q]} == {i for _, i in want[q]}
    pairs = lambda found: {(r.query_id, r.id) for r in found if r.query_id != 5003}
    near = pairs(index.search(queries, "id", "v", 10).collect())
    assert len(near & pairs(exact)) >= 0.9 * len(pairs(exact))
    assert index.recall >= 0.95 and index.visits < 12
    assert index.share_read(queries, "id", "v") < 0.5
    # stored by cell, in blocks, every row once
    blocks = spark.read.parquet(str(tmp_path / "ix/blocks"))
    assert blocks.agg(F.sum("n")).first()[0] == 1203 and blocks.select("cell").distinct().count() > 10
    again = VectorIndex(spark, str(tmp_path / "ix"))
    assert pairs(again.search(queries, "id", "v", 10).collect()) == near


def test_cells_hot(spark, tmp_path):
    """A third of all rows is one vector: its cell is in blocks of bounded size, and ties go by id."""
    rows = [(k, [1.0, 2.0, 3.0], 1, 1, "") for k in range(1500)] + [(2000 + k, [float(k % 13), float(k % 7), 1.0], 1, 1, "") for k in range(1500)]
    index = VectorIndex.build(spark.createDataFrame(rows, SCHEMA), "id", "v", str(tmp_path / "ix"))
    assert spark.read.parquet(str(tmp_path / "ix/blocks")).agg(F.max("n")).first()[0] <= 1024
    got = index.search(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1, 1, "")], SCHEMA), "id", "v", 5).orderBy("id").collect()
    assert [r.id for r in got] == [0, 1, 2, 3, 4]


def test_cells_small(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    empty = VectorIndex.build(none, "id", "v", str(tmp_path / "a"))
    assert empty.search(none, "id", "v").collect() == []
    one = VectorIndex.build(spark.createDataFrame([(1, [1.0, 0.0], 1, 1, ""), (2, None, 1, 1, "")], SCHEMA), "id", "v", str(tmp_path / "b"))
    assert [(r.query_id, r.id) for r in one.search(spark.createDataFrame([(9, [0.5, 0.5], 1, 1, "")], SCHEMA), "id", "v").collect()] == [(9, 1)]
    assert one.search(none, "id", "v").collect() == []


def test_query_recall(spark, sf_dir):
    near, exact = ({(r.query_id, r.vec_id) for r in q(spark, sf_dir).collect()} for q in (retrieval.knn_cells, retrieval.knn_all_cells))
    assert len(near & exact) >= 0.9 * len(exact)
