"""Parquet tables of a data folder; only Spark's readers touch the path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``, which may be any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
