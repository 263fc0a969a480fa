"""Ranked text search, vector search and their fusion."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.plans import map_arrow, shared_table

#: Parameters of BM25, and the least weight of a term that most rows contain.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
_TOKEN = r"[\p{L}\p{N}]"


def query_terms(text: str, least: int = 1, most: int | None = None) -> list[str]:
    """Distinct lower-cased words of a search text."""
    from quernstone.functions.text import sanitize_query

    words = [w for w in sanitize_query(text).lower().split() if len(w) >= least]
    return list(dict.fromkeys(words))[:most]


def _frequency(text: Column, term: str, prefix: bool) -> Column:
    quoted = "".join("\\" + c if not c.isalnum() else c for c in term)
    tail = f"{_TOKEN}*" if prefix else ""
    # most rows lack the term, which a plain search tells much faster than the pattern
    found = F.regexp_count(F.lower(text), F.lit(f"(?<!{_TOKEN}){quoted}{tail}(?!{_TOKEN})"))
    return F.when(F.lower(text).contains(term), found).otherwise(F.lit(0))


def bm25(df: DataFrame, row_id: str, fields: dict[str, float], terms: list[str], prefix: bool = True) -> DataFrame:
    """Rows with a term and their BM25 score, the sum over terms; fields weigh a term's frequency.

    Two scans and no shuffle of texts: the first gives the number of rows, the mean length and each
    term's row count (a handful of numbers for the driver), the second scores row by row.
    """
    length = sum((F.regexp_count(F.col(f), F.lit(f"{_TOKEN}+")) for f in fields), F.lit(0))
    tf = [sum((_frequency(F.col(f), t, prefix) * w for f, w in fields.items()), F.lit(0.0)) for t in terms]
    counted = df.select("*", length.alias("_dl"), *[x.alias(f"_tf{k}") for k, x in enumerate(tf)])
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("_dl").alias("dl"), *[F.count_if(F.col(f"_tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))]).first()
    score = F.lit(0.0)
    for k in range(len(terms)):
        idf = math.log((stats["n"] - stats[f"df{k}"] + 0.5) / (stats[f"df{k}"] + 0.5)) if stats["n"] else 0.0
        x = F.col(f"_tf{k}")
        score = score + max(idf, LEAST_IDF) * x * (K1 + 1) / (x + K1 * (1 - B + B * F.col("_dl") / (stats["dl"] or 1.0)))
    any_term = sum((F.col(f"_tf{k}") for k in range(len(terms))), F.lit(0.0)) > 0
    return counted.where(any_term).select(row_id, score.alias("score"))


def contains_search(df: DataFrame, fields: list[str], needle: str, score: float = 50.0) -> DataFrame:
    """Rows in which a field contains the text, in either case, with a flat score."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.lower(f).contains(needle.lower())
    return df.where(hit).withColumn("score", F.lit(score))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double; 0 if one of them has no length, null if dimensions differ."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm == 0, 0.0).otherwise(F.try_divide(_dot(a, b), norm)))


def l2_similarity(a: Column, b: Column) -> Column:
    """max(0, 1 - d^2 / 2) of the Euclidean distance: the cosine, for unit vectors."""
    d2 = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(0.0), 1 - d2 / 2)


def vector_literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def nearest(df: DataFrame, row_id: str, vector: str, wanted: list[float], k: int, least: float | None = None, strict: bool = False, similarity=cosine) -> DataFrame:
    """The ``k`` rows most similar to one vector; ties by id. Filter ``df`` before, not after."""
    scored = df.where(F.size(vector) == len(wanted)).select(row_id, similarity(F.col(vector), vector_literal(wanted)).alias("similarity"))
    if least is not None:
        scored = scored.where(F.col("similarity") > least if strict else F.col("similarity") >= least)
    return scored.orderBy(F.desc("similarity"), row_id).limit(k)


def nearest_many(df: DataFrame, queries: DataFrame, row_id: str, vector: str, k: int, least: float | None = None, strict: bool = False, measure: str = "cosine", block: int = 8192) -> DataFrame:
    """(query_id, row_id, similarity): the ``k`` rows most similar to each of ``queries``, ties by id.

    Queries are taken in blocks of ``block`` vectors, the bound of what is broadcast; each block meets all rows in one
    scan, where a task keeps its best ``k`` for each query. ``measure`` is ``cosine`` or ``l2`` (as ``l2_similarity``, rounded
    to 9 places). Null vectors and those of another dimension than the query's have no similarity.
    """
    spark = df.sparkSession
    rows = df.select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    schema = "query_id bigint, id bigint, similarity double"
    wanted = queries.select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")

    def one(asked: list) -> DataFrame:
        shared = spark.sparkContext.broadcast([(r.id, r.v) for r in asked])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_size: dict[int, list] = {}
            for i, v in shared.value:
                by_size.setdefault(len(v), []).append((i, v))
            sets = {n: (np.array([i for i, _ in x]), np.array([v for _, v in x]).reshape(len(x), n)) for n, x in by_size.items()}
            best = {n: [[(np.empty(0), np.empty(0, np.int64))] for _ in ids] for n, (ids, _) in sets.items()}
            for batch in batches:
                size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
                for n, (_, q) in sets.items():
                    at = np.flatnonzero(size == n)
                    part = batch.take(pa.array(at))
                    ids, e = part.column(0).to_numpy(), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n)
                    for b in range(0, len(q), 512):
                        sim = similarities(e, q[b : b + 512])
                        for j in range(sim.shape[1]):
                            s = sim[:, j]
                            ok = np.flatnonzero(s > least if strict else s >= least) if least is not None else np.arange(len(s))
                            held = best[n][b + j]
                            held.append((s[ok], ids[ok]))
                            s, i = (np.concatenate(x) for x in zip(*held, strict=True))
                            top = np.lexsort((i, -s))[:k]
                            best[n][b + j] = [(s[top], i[top])]
            for n, (ids, _) in sets.items():
                counts = [len(x[0][0]) for x in best[n]]
                if sum(counts):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, counts)), pa.array(np.concatenate([x[0][1] for x in best[n]])), pa.array(np.concatenate([x[0][0] for x in best[n]]))], names=["query_id", "id", "similarity"])

        def similarities(e: np.ndarray, q: np.ndarray) -> np.ndarray:
            dots, a, b = e @ q.T, (e * e).sum(axis=1), (q * q).sum(axis=1)
            if measure == "l2":
                return np.round(np.maximum(0.0, 1 - (a[:, None] + b - 2 * dots) / 2), 9)
            norm = np.sqrt(a)[:, None] * np.sqrt(b)
            return np.divide(dots, norm, out=np.zeros_like(dots), where=norm > 0)

        found = map_arrow(rows, run, schema)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
        return found.withColumn("_place", place).where(F.col("_place") <= k).select("query_id", F.col("id").alias(row_id), "similarity")

    out, held = None, []
    for r in wanted.toLocalIterator():
        held.append(r)
        if len(held) == block:
            part = shared_table(one(held), "nearest")
            out, held = part if out is None else out.union(part), []
    if held or out is None:
        part = one(held)
        out = part if out is None else out.union(part)
    return out


def fuse(text_hits: DataFrame, vector_hits: DataFrame, row_id: str, text_weight: float = 0.5, vector_weight: float = 0.5, full: bool = False) -> DataFrame:
    """Weighted sum of normalised text scores and similarities, times 100.

    Text scores are divided by their maximum, at least 1. Rows without a text hit are left
    out unless ``full``; without vector hits text scores alone decide.
    """
    top = text_hits.agg(F.max("score")).first()[0] or 0.0
    joined = text_hits.join(vector_hits, row_id, "full_outer" if full else "left")
    text = F.coalesce(F.col("score"), F.lit(0.0)) / max(top, 1.0)
    return joined.select(row_id, ((text * text_weight + F.coalesce("similarity", F.lit(0.0)) * vector_weight) * 100).alias("score"))
