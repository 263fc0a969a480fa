"""Similar records: a weighted sum of set similarities of several fields, joined without comparing all pairs."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.similarity import measured_pairs, similar_pairs
from quernstone.plans import shared_table

#: Low bits of a token that tell its field, and so how many fields a record may have.
_FIELD_BITS = 3
MAX_FIELDS = 1 << _FIELD_BITS


def records(rows: DataFrame, row_id: str, sets: dict[str, float], same: dict[str, float] | None = None, within: str | None = None) -> DataFrame:
    """(id, place, tokens, key) in a shared table: the form in which records are compared.

    ``sets`` names array columns and ``same`` columns of single values, with their weights. All fields of a record are
    one set of hashes whose low bits tell the field; a single value is a set of one. ``place`` hashes ``within``: records
    of different places, null being one, are never compared. Records with one ``key`` are alike in every field.

    Null arrays count as empty and nulls in arrays are passed over; a null single value equals another. Rows without an
    id are left out, and of rows that share an id one stays, chosen by its content. Other columns are ignored.
    """
    same = same or {}
    if not sets or len(sets) + len(same) > MAX_FIELDS:
        raise ValueError(f"there must be a set, and {MAX_FIELDS} fields at most")
    token = lambda k, *x: F.shiftleft(F.xxhash64(*x), _FIELD_BITS).bitwiseOR(F.lit(k).cast("long"))
    each = lambda c, k: F.transform(c, lambda x: token(k, x))
    fields = []
    for k, name in enumerate([*sets, *same]):
        if name in sets:
            present = F.filter(F.coalesce(F.col(name), F.array().cast(rows.schema[name].dataType)), lambda x: x.isNotNull())
            fields.append(F.array_distinct(each(present, k)))
        else:
            fields.append(F.array(token(k, F.col(name).isNull(), F.col(name))))
    place = F.xxhash64(F.col(within).isNull(), F.col(within)) if within else F.lit(0).cast("long")
    out = rows.where(F.col(row_id).isNotNull()).select(F.col(row_id).alias("id"), place.alias("place"), F.array_sort(F.concat(*fields)).alias("tokens"))
    out = out.withColumn("key", F.md5(F.concat_ws(" ", F.col("place").cast("string"), F.transform("tokens", lambda x: x.cast("string"))).cast("binary")))
    one = out.groupBy("id").agg(F.min_by(F.struct("place", "tokens", "key"), "key").alias("r"))
    return shared_table(one.select("id", "r.place", "r.tokens", "r.key"), "records")


def _of_field(k: int) -> Column:
    """The tokens of the field of this number."""
    return F.filter("tokens", lambda x: x.bitwiseAND(F.lit(MAX_FIELDS - 1).cast("long")) == k)


def lead_bound(sets: dict[str, float], same: dict[str, float], least: float, leads: list[str]) -> float:
    """The set similarity that one of the ``leads`` at least has in every pair of records of similarity ``least``.

    If all leads were below it, even full agreement of all other fields would not reach ``least``.
    """
    others = sum(w for f, w in {**sets, **same}.items() if f not in leads)
    bound = (least - others) / sum(sets[f] for f in leads)
    if bound <= 0:
        raise ValueError(f"fields other than {leads} can reach {least} alone")
    return min(bound, 1.0)


def record_pairs(recs: DataFrame, sets: dict[str, float], same: dict[str, float] | None = None, least: float = 0.5, leads: list[str] | None = None, among: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity, <field>_similarity of each field), a < b: all pairs of ``records`` of one place from ``least`` on.

    A field's similarity is the Jaccard similarity of its sets, 0 if one is empty, or 1 for equal single values, else 0;
    ``similarity`` is the sum of these times their weights, in the order of the fields.

    Exact: candidates are the pairs that are similar enough in one of the ``leads`` (all sets unless told), by the bound
    of ``lead_bound``, each found by a set join with a prefix filter; every field of a candidate is then measured where
    its records meet. Leave sets of few, frequent tokens out of the leads: others must then agree more. ``among`` (id)
    names the records to be paired; ``record_classes`` gives one for each class of equal ones.
    """
    same = same or {}
    names, weights = [*sets, *same], [*sets.values(), *same.values()]
    leads = list(leads or sets)
    bound = lead_bound(sets, same, least, leads)
    found = []
    for f in leads:
        own = F.transform(_of_field(names.index(f)), lambda x: F.xxhash64("place", x))
        found.append(similar_pairs(recs.select("id", own.alias("set")), "id", "set", bound, among).select("a", "b"))
    pairs = shared_table(reduce(DataFrame.union, found).distinct(), "record-candidates")
    n = len(names)

    def measure(x: np.ndarray, y: np.ndarray) -> tuple:
        count = lambda t: np.bincount(t & (MAX_FIELDS - 1), minlength=n)
        both = count(np.intersect1d(x, y, assume_unique=True))
        return tuple((both / np.maximum(count(x) + count(y) - both, 1)).tolist())

    parts = [f"{f}_similarity" for f in names]
    out = measured_pairs(recs.select("id", "tokens"), pairs, measure, parts)
    total = reduce(Column.__add__, [F.col(f"`{p}`") * F.lit(float(w)) for p, w in zip(parts, weights, strict=True)])
    return out.select("a", "b", total.alias("similarity"), *[F.col(f"`{p}`") for p in parts]).where(F.col("similarity") >= least)


def record_classes(recs: DataFrame, sets: dict[str, float], same: dict[str, float] | None = None) -> DataFrame:
    """(id, class, own) of ``records``, in a shared table: those alike in every field are a class, named by its smallest id.

    ``own`` is the similarity of two records of the class: empty sets have nothing in common, so it may be below the
    sum of all weights.
    """
    same = same or {}
    own = reduce(Column.__add__, [(F.size(_of_field(k)) > 0).cast("double") * F.lit(float(w)) for k, w in enumerate([*sets.values(), *same.values()])])
    named = recs.groupBy("key").agg(F.min("id").alias("class"))
    return shared_table(recs.select("id", "key", own.alias("own")).join(named, "key").select("id", "class", "own"), "record-classes")


def record_links(members: DataFrame, pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, class, n_links): how many other records each is similar to, from classes and pairs of class names alone.

    A group of copies costs one row a copy: its members are counted, not paired.
    """
    size = members.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.any_value("own").alias("own"))
    ends = pairs.select(F.col("a").alias("class"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    outside = ends.join(size.select(F.col("class").alias("other"), "n"), "other").groupBy("class").agg(F.sum("n").alias("outside"))
    inside = F.when(F.col("own") >= least, F.col("n") - 1).otherwise(F.lit(0))
    links = size.join(outside, "class", "left").select("class", (inside + F.coalesce("outside", F.lit(0))).alias("n_links"))
    return members.select("id", "class").join(links, "class").select("id", "class", "n_links")


def similar_records(rows: DataFrame, row_id: str, sets: dict[str, float], same: dict[str, float] | None = None, least: float = 0.5, within: str | None = None, leads: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): ``record_classes`` of all rows, and ``record_pairs`` between the records that name their class."""
    recs = records(rows, row_id, sets, same, within)
    members = record_classes(recs, sets, same)
    return members, record_pairs(recs, sets, same, least, leads, members.where("id = class").select("id"))
