"""Exact deduplication: a tree merge of sorted digest runs.

Every row gets a digest of its text without white space and belongs to one of
``2**run_bits`` runs. Level 0 sorts and merges each run (Spark aggregates a
struct buffer by sorting, so a run is a sorted list of digests); each further
level sends ``2**fan_in_bits`` runs to their common parent and merges them
there, until one entry for each digest is left at the root. An entry holds the
row that stays so far (most code points in the original text, then smallest
id) and the number of rows. A digest with a third of all rows is at most one
entry of each run after level 0, so no task ever meets the group.

The result goes down the same tree: the root's entries are joined to the
entries of level 0, which are few for any digest, and those to the rows on
(digest, run), which spreads a hot digest over all runs.

Entries are merged only where SHA-256, XXH64 and the length of the normalised
text all agree, which verifies equality without carrying texts through shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.rows import row_number
from quernstone.llm.text import squeeze
from quernstone.plans import shared_table

_KEY = ["_sha", "_xx", "_len"]


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_bits: int = 8) -> DataFrame:
    """One narrow row for each document, written once to the shared folder."""
    norm = F.col("_norm")
    rows = docs.select(row_number(docs).alias("_uid"), F.col(id_col).alias("_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("_chars"), squeeze(F.col(text_col)).alias("_norm"))
    rows = rows.select("_uid", "_id", "_chars", F.unhex(F.sha2(norm, 256)).alias("_sha"), F.xxhash64(norm).alias("_xx"), F.length(norm).alias("_len"))
    run = F.pmod(F.xxhash64(F.col("_uid")), F.lit(1 << run_bits)).cast("int")
    return shared_table(rows.withColumn("_run", run), "digests")


def tree_merge(rows: DataFrame, run_bits: int = 8, fan_in_bits: int = 4) -> tuple[DataFrame, DataFrame]:
    """(entries of level 0, entries of the root) of the merge tree over ``rows``."""
    best = F.struct((-F.col("_chars")).alias("c"), F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), F.col("_uid").alias("u"))
    level = leaves = rows.groupBy(*_KEY, "_run").agg(F.min(best).alias("_best"), F.count(F.lit(1)).alias("_n"))
    left = run_bits
    while left > 0:
        step = min(fan_in_bits, left)
        left -= step
        parent = F.shiftright("_run", step).alias("_run")
        level = level.select(*_KEY, parent, "_best", "_n").groupBy(*_KEY, "_run").agg(F.min("_best").alias("_best"), F.sum("_n").alias("_n"))
    return leaves, level.drop("_run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_bits: int = 8, fan_in_bits: int = 4) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, row_uid.

    Texts are equal when identical after deleting every white space character.
    Of equal texts the row with the most code points stays, then the smallest
    id (null last), then the first row read, so exactly one row of a group has
    ``kept``, also where whole rows repeat. Null texts count as empty, and
    empty texts form one group. An empty table gives an empty result. Columns
    other than the id and the text are ignored, whatever their names.
    ``row_uid`` is the row's number if ``docs`` comes from ``number_rows``, else its place in the scan.
    """
    rows = digest_rows(docs, id_col, text_col, run_bits)
    leaves, root = tree_merge(rows, run_bits, fan_in_bits)
    root = root.select(*_KEY, F.col("_best.i").alias("_keep"), F.col("_best.u").alias("_keep_uid"), "_n")
    down = leaves.select(*_KEY, "_run").join(root, _KEY)
    return rows.join(down, [*_KEY, "_run"]).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_uid") == F.col("_keep_uid")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
        F.col("_uid").alias("row_uid"),
    )
