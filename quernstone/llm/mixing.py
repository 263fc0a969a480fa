"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources share ``ratio`` times all tokens by weight; a target stops at
``max_epochs`` times its source's size and the excess is shared anew by weight
among the rest. That fixed point is min(cap, level * weight) with one level
for all, found from the sources ordered by cap / weight.

Schedule: slot i of the mix gets the golden-ratio point frac(i * 0.618...) in
32-bit fixed point, which is mapped through the cumulative targets to a
source. Any prefix of the schedule is therefore close to the target mix. One
slot for each source is put in front, so that small sources have one.
Slots are ranked per source in two levels (counts of slot ranges, then ranks in
a range), so no task sorts all slots of one source.

Blocks: the documents of a source, in hashed order, are a stream of tokens; it
is read round and round, at most ``max_epochs`` times. The target of a source is
cut into as many blocks of equal size (within one token) as the source has slots,
and the slot with rank r takes block r. Positions are prefix sums in two levels
(hash buckets, then rows in a bucket).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.rows import row_number
from quernstone.llm.text import words
from quernstone.plans import shared_table

#: The golden ratio's fractional part times 2**32, odd.
GOLDEN = 2654435769
_ONE = 1 << 32


def source_targets(sizes: DataFrame, ratio: float = 1.5, max_epochs: int = 2, weights: tuple = (5, 2, 1)) -> DataFrame:
    """(source, source_size, weight, cap, target, upto) from (source, source_size).

    Sources are ordered by code point with null last and weigh ``weights``, repeating.
    ``upto`` is the sum of targets up to and with the source in that order.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))))
    s = sizes.select("source", "source_size", pick.alias("weight"), (F.col("source_size") * max_epochs).alias("cap"))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everyone = Window.partitionBy()
    earlier = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("place", F.row_number().over(by_ratio)).withColumn("level", (F.sum("source_size").over(everyone) * ratio - earlier) / rest)
    # the first source that the level leaves below its cap sets the level for all
    s = s.withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
    s = s.withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("place").alias("r"), F.col("level").alias("l")))).over(everyone)["l"])
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    s = s.withColumn("target", target)
    return s.select("source", "source_size", "weight", "cap", "target", F.sum(F.floor("target")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))


def schedule(targets: DataFrame, block_tokens: int = 1024, range_bits: int = 10, cell_bits: int = 12) -> DataFrame:
    """(slot, source, rank): the order in which the mix takes blocks.

    Slots and sources meet by an equi-join on the leading ``cell_bits`` bits of
    the point; the bounds of a source decide within the cell.
    """
    spark = targets.sparkSession
    total = targets.agg(F.max("upto")).first()[0] or 0
    slots = math.ceil(total / block_tokens)
    i = F.col("id")
    low, high = i.bitwiseAND(F.lit(0xFFFF)), F.shiftright(i, 16).bitwiseAND(F.lit(0xFFFF))
    # i * GOLDEN mod 2**32, in two halves so that no product overflows
    point = F.pmod(low * GOLDEN + F.pmod(high * GOLDEN, F.lit(1 << 16)) * (1 << 16), F.lit(_ONE))
    points = spark.range(slots).select(i.alias("slot"), point.alias("point"))
    cell_size = _ONE >> cell_bits
    to_fixed = lambda c: F.floor(c.cast("double") / F.lit(float(max(total, 1))) * _ONE).cast("long")
    bounds = targets.where(F.floor("target") > 0).select("source", to_fixed(F.col("upto") - F.floor("target")).alias("lo"), F.when(F.col("upto") == total, F.lit(_ONE)).otherwise(to_fixed(F.col("upto"))).alias("hi"))
    cells = bounds.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / cell_size), F.floor((F.col("hi") - 1) / cell_size))))
    hit = points.withColumn("cell", F.floor(F.col("point") / cell_size)).join(cells, "cell").where("point >= lo and point < hi").select("slot", "source")
    first = targets.where(F.floor("target") > 0).select(F.lit(-1).cast("long").alias("slot"), "source")
    chosen = first.union(hit).withColumn("part", F.shiftright("slot", range_bits))
    counts = chosen.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("source").alias("_s"), F.col("part").alias("_p"), F.coalesce(before, F.lit(0)).alias("before"))
    in_part = F.row_number().over(Window.partitionBy("source", "part").orderBy("slot")) - 1
    ranked = chosen.withColumn("in_part", in_part)
    return ranked.join(counts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p"))).select("slot", "source", (F.col("before") + F.col("in_part")).alias("rank"))


def _key(c):
    return F.concat(F.when(c.isNull(), "n").otherwise("s"), F.coalesce(c, F.lit("")))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", ratio: float = 1.5, max_epochs: int = 2, weights: tuple = (5, 2, 1), block_tokens: int = 1024, bucket_bits: int = 12) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken, row_uid.

    ``size`` counts the words of the text (null: 0) and ``taken`` those that the
    mix takes, at most ``max_epochs`` times the size. A null source is a source
    of its own. Rows with equal ids are told apart by their place in the scan,
    so repeated rows each take their share. An empty table gives an empty result
    and a source without words the target 0. Further columns are ignored. The
    hash order depends on ids and sizes alone: reruns agree.
    """
    rows = docs.select(row_number(docs).alias("_uid"), F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"))
    mixed = F.md5(F.coalesce(F.col("_id").cast("string"), F.lit("null")).cast("binary"))
    rows = rows.select("*", mixed.alias("_order"))
    bucket = F.conv(F.substring("_order", 1, 4), 16, 10).cast("int")
    rows = shared_table(rows.withColumn("_bucket", F.shiftright(bucket, 16 - bucket_bits)), "mix-sizes")
    per_bucket = shared_table(rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_size")), "mix-buckets")
    targets = shared_table(source_targets(per_bucket.groupBy("source").agg(F.sum("_size").alias("source_size")), ratio, max_epochs, weights), "mix-targets")

    slots = schedule(targets, block_tokens)
    per_source = slots.groupBy("source").agg(F.count(F.lit(1)).alias("n_slots"))
    per_source = targets.alias("t").join(per_source.alias("p"), F.col("t.source").eqNullSafe(F.col("p.source")), "left").select(_key(F.col("t.source")).alias("_s"), "source_size", "target", F.floor("target").alias("length"), F.coalesce("n_slots", F.lit(0)).alias("n_slots"))

    before = F.sum("_size").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = per_bucket.select(_key(F.col("source")).alias("_s"), "_bucket", F.coalesce(before, F.lit(0)).alias("bucket_start")).join(per_source, "_s")
    within = F.sum("size").over(Window.partitionBy("_s", "_bucket").orderBy("_order", "_id", "_uid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = rows.withColumn("_s", _key(F.col("source"))).withColumn("_in", within).join(starts, ["_s", "_bucket"]).withColumn("_a", F.col("bucket_start") + F.col("_in"))

    # block r of a source covers [r * base + min(r, extra), ...): sizes differ by one token at most
    base, extra = F.floor(F.try_divide("length", "n_slots")), F.pmod(F.col("length"), F.nullif(F.col("n_slots"), F.lit(0)))
    placed = placed.withColumn("_base", F.coalesce(base, F.lit(0))).withColumn("_extra", F.coalesce(extra, F.lit(0)))
    long_part = F.col("_extra") * (F.col("_base") + 1)
    block_of = lambda x: F.when(x < long_part, F.floor(F.try_divide(x, F.col("_base") + 1))).otherwise(F.col("_extra") + F.coalesce(F.floor(F.try_divide(x - long_part, F.nullif(F.col("_base"), F.lit(0)))), F.lit(0)))
    start_of = lambda r: r * F.col("_base") + F.least(r, F.col("_extra"))
    epoch = F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))
    keep = ["_uid", "_id", "_s", "size", "source_size", "target", "length", "_base", "_extra"]
    parts = placed.select(*keep, "_a", epoch.alias("_epoch")).withColumn("_from", F.col("_a") + F.col("_epoch") * F.col("source_size"))
    parts = parts.withColumn("_to", F.least(F.col("_from") + F.col("size"), F.col("length")))
    ranks = F.when(F.col("_to") > F.col("_from"), F.sequence(block_of(F.col("_from")), block_of(F.col("_to") - 1)))
    parts = parts.select(*keep, "_from", "_to", F.explode_outer(ranks).alias("rank"))
    overlap = F.least(F.col("_to"), start_of(F.col("rank") + 1)) - F.greatest(F.col("_from"), start_of(F.col("rank")))
    parts = parts.select("_uid", "_id", "_s", "size", "source_size", "target", "rank", overlap.alias("overlap"))
    taken = parts.join(slots.select(_key(F.col("source")).alias("_s"), "rank", "slot"), ["_s", "rank"], "left")
    return taken.groupBy("_uid", "_id", "size", "source_size", "target").agg(F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("overlap"))), F.lit(0)).alias("taken")).select(
        F.col("_id").alias(id_col), "size", "source_size", "target", "taken", F.col("_uid").alias("row_uid"),
    )
