"""Searches over a stored index: with filters, and for rules that are still in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.text_index import TextIndex

#: What a BM25 score is multiplied with to give a relevance.
RELEVANCE = 100.0


def filtered_search(index: TextIndex, rows: DataFrame, terms: list[str], k: int = 10, newest: Column | None = None, **how) -> DataFrame:
    """The best ``k`` of ``rows``, already filtered, with their ``relevance``: a hundred times the BM25 score.

    Scores come from the whole index, so filters don't change them. Without terms the rows that are
    first by ``newest`` come back, with a relevance of 0. ``how`` goes to ``TextIndex.search``.
    """
    if not terms:
        return rows.orderBy(*([newest.desc()] if newest is not None else []), index.row_id).limit(k).withColumn("relevance", F.lit(0.0))
    hits = index.search(terms, among=rows, k=k, **how)
    return rows.join(F.broadcast(hits), index.row_id).withColumn("relevance", F.col("score") * RELEVANCE).drop("score")


def search_rules(index: TextIndex, rules: DataFrame, terms: list[str], k: int = 10) -> DataFrame:
    """Rules in force that have all the terms, best first: (rule id, score). ``rules`` has superseded_by."""
    live = rules.where(F.col("superseded_by").isNull())
    return index.search(terms, prefix=False, every=True, among=live, k=k)


def rules_for_tags(index: TextIndex, rules: DataFrame, tags: list[str], k: int = 5) -> DataFrame:
    """Rules in force that have one of the tags, by score and then by use; without tags the most used, newest first.

    ``rules`` has superseded_by, usage_count and created.
    """
    live = rules.where(F.col("superseded_by").isNull())
    if not tags:
        return live.orderBy(F.desc("usage_count"), F.desc("created"), index.row_id).limit(k).select(index.row_id, F.lit(0.0).alias("score"), "usage_count")
    hits = index.search(tags, prefix=False)
    found = live.select(index.row_id, "usage_count").join(hits, index.row_id)
    return found.orderBy(F.desc("score"), F.desc("usage_count"), index.row_id).limit(k).select(index.row_id, "score", "usage_count")
