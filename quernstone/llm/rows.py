"""Bring verdicts on rows back to whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.plans import shared_table

#: Row numbers are broadcast up to this many (about 20 MB once hashed); beyond, both sides are shuffled.
MAX_BROADCAST_ROWS = 200_000
#: The column of a row's number in ``number_rows``.
ROW = "__quernstone_row"


def _reads_files(docs: DataFrame) -> bool:
    """Whether ``docs`` is a scan of files with nothing but selections above, so that a file's row occurs once."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias") and node.children().size() == 1:
        node = node.children().head()
    return node.nodeName() in ("LogicalRelation", "Relation") or node.nodeName().startswith("Relation")


def number_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with a number in ``ROW`` that is a row's own in every scan.

    How a scan cuts its files depends on the cores alive at planning, so a place in one scan
    needn't be that of the next. Rows of files are numbered by file (a hash of 64 bits) and
    place in the file, which cost nothing; anything else is written once with its numbers.
    """
    if ROW in docs.columns:
        return docs
    if _reads_files(docs) and "_metadata" not in docs.columns:
        return docs.withColumn(ROW, F.xxhash64("_metadata.file_path").bitwiseXOR(F.col("_metadata.row_index")))
    return shared_table(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def row_number(docs: DataFrame) -> Column:
    """The number that ``docs`` brings along, else the place in this scan, which no other scan may rely on."""
    return F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()


def repeat_rows(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """The rows of ``docs``, from ``number_rows``, each as often as ``copies`` (row_uid, copies) says, without their numbers.

    Only rows that occur other than once are joined; they are broadcast if they were counted to be few.
    """
    other = copies.where("copies != 1").select(F.col("row_uid").alias(ROW), F.col("copies").cast("int").alias("__quernstone_copies"))
    other = shared_table(other, "copies")
    if other.count() <= MAX_BROADCAST_ROWS:
        other = F.broadcast(other)
    times = F.coalesce("__quernstone_copies", F.lit(1))
    again = docs.join(other, ROW, "left").where(times > 0).withColumn("__quernstone_again", F.explode(F.sequence(F.lit(1), times)))
    return again.select(*[c for c in docs.columns if c != ROW])


def keep_rows(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs``, from ``number_rows``, with ``kept`` in ``verdicts`` (row_uid, kept)."""
    return repeat_rows(docs, verdicts.select("row_uid", F.when(F.col("kept"), 1).otherwise(0).alias("copies")))
