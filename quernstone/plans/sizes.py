"""Partitions and broadcasts by counted rows, so that a task's memory doesn't grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a few numbers that a task hashes or sorts at once (about 200 MB with both halves of an aggregation).
TASK_ROWS = 1_000_000
#: Rows of two or three numbers that are broadcast (about 50 MB once hashed).
FEW_ROWS = 1_000_000


def dealt(df: DataFrame, rows: int, *keys: str, each: int | None = None) -> DataFrame:
    """``df``, known to have about ``rows`` rows, dealt by the keys into partitions of ``each`` (``TASK_ROWS``) at most.

    Joins and aggregations by these keys, or by more columns, then need no further shuffle.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(usual, -(-rows // (each or TASK_ROWS))), *keys)


def broadcast_few(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` broadcast if it was counted to be few rows, else as it is."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= FEW_ROWS else df
