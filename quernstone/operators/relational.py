"""Row and group operators that the queries compose."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_all(df: DataFrame, predicates: Iterable[Column]) -> DataFrame:
    """Rows that meet every predicate; one conjunction, so the scan can take all of it."""
    return df.where(reduce(lambda a, b: a & b, predicates, F.lit(True)))


def missing(df: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows without a partner, for backfills and orphan reports."""
    return df.join(other, on, "left_anti")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], prefer: Iterable[str] | None = None) -> DataFrame:
    """``base`` with ``changes`` merged in by key: new keys are added, given values replace old ones."""
    cols = [c for c in base.columns if c not in keys]
    prefer = set(cols if prefer is None else prefer)
    b, c = base.alias("b"), changes.alias("c")
    pick = [F.coalesce(*((F.col(f"c.{x}"), F.col(f"b.{x}")) if x in prefer else (F.col(f"b.{x}"), F.col(f"c.{x}")))).alias(x) for x in cols]
    return b.join(c, keys, "full_outer").select(*keys, *pick)


def update_when(df: DataFrame, hit: Column, values: dict[str, Column]) -> DataFrame:
    """In-place update as a rewrite: ``values`` where ``hit`` holds, old values elsewhere."""
    return df.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in values.items()})


def newest(df: DataFrame, group: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group; Spark limits groups before it shuffles."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def zero_filled(counts: DataFrame, key: str, value: str, domain: list[str]) -> DataFrame:
    """A count for every member of a fixed domain, 0 where nothing was counted."""
    spark = counts.sparkSession
    wanted = spark.createDataFrame([(d,) for d in domain], f"{key} string")
    return wanted.join(counts, key, "left").select(key, F.coalesce(value, F.lit(0)).alias(value))


def percentile_n(df: DataFrame, group: list[str], value: str, alias: str) -> DataFrame:
    """Share of rows with a smaller value, in whole percent; the denominator is n, not n - 1.

    Counted from the distinct values, so a group of any size is pre-aggregated before it meets. Nulls
    are a group of their own, and a null value is smaller than all others.
    """
    per = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group)
    below = F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    per = per.withColumn(alias, F.floor(F.coalesce(below, F.lit(0)) * 100 / F.sum("_n").over(w) + F.lit(0.5)).cast("long"))
    keys = [*group, value]
    return null_safe_join(df, per.drop("_n"), keys)


def null_safe_join(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the columns of ``other``, one row for each combination of ``keys``; null keys meet null keys."""
    renamed = other.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return df.join(renamed, same).drop(*[f"_{k}" for k in keys])


def overlaps(df: DataFrame, key: str, row_id: str, start: str, end: str, bucket: int) -> DataFrame:
    """Pairs (a, b), a < b, of one key whose closed intervals overlap.

    Intervals are dealt to every bucket of length ``bucket`` that they touch and meet by an
    equi-join on (key, bucket), not by all pairs of the key; a pair is reported in the bucket where the
    later one begins.
    """
    dealt = df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    a = dealt.select(key, "_b", F.col(row_id).alias("a"), F.col(start).alias("a_start"), F.col(end).alias("a_end"))
    b = dealt.select(key, "_b", F.col(row_id).alias("b"), F.col(start).alias("b_start"), F.col(end).alias("b_end"))
    hit = (F.col("a") < F.col("b")) & (F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end"))
    once = F.col("_b") == F.floor(F.greatest("a_start", "b_start") / bucket)
    return a.join(b, [key, "_b"]).where(hit & once).drop("_b")


def streaks(df: DataFrame, group: list[str], order: list[Column], failed: Column, alias: str = "streak") -> DataFrame:
    """Failures in a row up to and with each row; a success sets the count back to 0."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("_f", failed.cast("int")).withColumn("_island", F.sum(1 - F.col("_f")).over(w))
    inside = Window.partitionBy(*group, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn(alias, F.sum("_f").over(inside)).drop("_f", "_island")


def budget_prefix(df: DataFrame, group: list[str], order: list[Column], cost: Column, budget: float, header: float = 0) -> DataFrame:
    """The longest prefix of each group that fits a budget, ``header`` being spent first."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(cost).over(w) + header).where(F.col("spent") <= budget)


def proportional(df: DataFrame, category: str, order: list[Column], most: int) -> DataFrame:
    """About ``most`` rows: max(1, floor(share * most)) of each category, then the best of the rest."""
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    share = counts.select(category, F.greatest(F.lit(1), F.floor(F.col("_n") * most / F.col("_all"))).alias("_quota"))
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(category).orderBy(*order)))
    # no category can give more than all rows asked for
    ranked = ranked.where(F.col("_rn") <= most).join(share, category)
    first = (F.col("_rn") > F.col("_quota")).cast("int")
    return ranked.orderBy(first, *order).limit(most).drop("_rn", "_quota")
