"""Corpus preparation: each stage works on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``docs`` is a table read
from Parquet. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.exact_dedup import exact_dedup
from quernstone.llm.kneser_ney import keep_quality
from quernstone.llm.mixing import mix_sources
from quernstone.llm.near_duplicates import near_classes
from quernstone.llm.pieces import piece_digests, read_model
from quernstone.llm.registry import default_model
from quernstone.llm.rows import keep_rows, number_rows, repeat_rows
from quernstone.plans import shared_table
from quernstone.sources import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the perplexity classifier rejects; trusted labels come from the table ``labels``."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    rows = number_rows(docs)
    return keep_rows(rows, exact_dedup(rows))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: SimHash of five-word shingles and MinHash, verified at Jaccard 0.8."""
    rows = number_rows(docs)
    return keep_rows(rows, near_classes(rows))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: taken words by size, rounded to 0, 1 or 2 copies."""
    rows = number_rows(docs)
    mix = mix_sources(rows)
    copies = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).otherwise(F.lit(0))
    return repeat_rows(rows, mix.select("row_uid", copies.cast("int").alias("copies")))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return piece_digests(docs, read_model(default_model()))


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("source_mix", mix_stage),
    ("piece_codec", encode_stage),
]

#: SQL cannot express the classifier, the near-duplicates or the encoder; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
