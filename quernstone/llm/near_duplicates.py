"""Near-duplicates by five-word shingles with a Jaccard similarity of 0.8.

Candidates come first from SimHash, as in ``simhash.py``: texts whose fingerprints differ in
at most four bits are tied by the anchors of its covering code. But SimHash distances of such
pairs reach 13 of 64 bits, which no covering of fingerprints reaches at a bearable number of
copies. More candidates therefore come from MinHash: 80 minima of the shingles' hashes in 20
bands of four, so that a pair at 0.8 shares a band but for one in 40,000. Up to eight of a band are tied each to each, larger bands to one of their
rows, chosen by the texts. A link counts only if the exact Jaccard similarity of the two
texts' shingle sets is high enough; ``connected_components`` makes classes of links.

Where a large band's rows aren't all of one class then, links between the classes may be
missing. All rows of such bands are searched exactly: sets at 0.8 or more have one of the
rarest fifth of their shingles in common, so rows of different classes that share one meet,
unless places in that order or differing bits rule the similarity out, and are verified as before.
So no link that a band can show is lost, and a class is never written as all its pairs.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.rows import row_number
from quernstone.llm.simhash import anchor_links, fingerprints
from quernstone.operators.components import connected_components
from quernstone.plans import map_arrow, shared_table

BANDS, BAND_ROWS = 20, 4
#: Up to so many rows of a band, all pairs are candidates.
ALL_PAIRS = 8
#: Slots of the counts that order shingles by rarity; any order gives the same links.
SLOTS = 1 << 20
#: Bits that bound from below in how many shingles two texts differ.
BITS = 512
_RNG = np.random.default_rng(42)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Distinct hashes of the text's word shingles, sorted; a shorter text is one shingle, one without words has none.

    Words are as in ``simhash.fingerprint``.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    found = {digest(b" ".join(words[i : i + width])) for i in range(max(1, len(words) - width + 1))}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A hash for each band of the minima; ``hashes`` must not be empty."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 4096):
        mixed = hashes[k : k + 4096] * _TIMES[:, None] + _PLUS[:, None]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, mixed.min(axis=1))
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def rarest(hashes: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The rarest shingles of a text, so many that every text at ``least`` or more has one of its own in common.

    Two sets share at least ``least`` times the larger one's size, so that in any one order of all shingles the
    first n - ceil(least * n) + 1 of each have one in common. ``counts`` (by slot) only makes that order a good one.
    """
    many = len(hashes) - math.ceil((least - 1e-9) * len(hashes)) + 1
    return hashes[np.lexsort((hashes, counts[hashes & np.uint64(len(counts) - 1)]))[:many]]


def parity_bits(hashes: np.ndarray) -> np.ndarray:
    """``BITS`` bits, each whether an odd number of the shingles falls on it; two texts differ in at least as many shingles as bits."""
    odd = np.bincount((hashes >> np.uint64(32)).astype(np.int64) % BITS, minlength=BITS) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def key_heads(keys: DataFrame) -> DataFrame:
    """(key, n, head) of every key with n > 1 rows, from (key, uid, sig); the head is chosen by the texts, not the row numbers."""
    pick = F.struct(F.xxhash64("key", "sig").alias("h"), F.col("uid").alias("u"))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(pick).alias("m")).where("n > 1").select("key", "n", F.col("m.u").alias("head"))


def candidate_links(keys: DataFrame, heads: DataFrame) -> DataFrame:
    """(a, b), a < b: every row of a key with its head, in small keys with each."""
    met = keys.join(heads, "key")
    small = met.where(F.col("n") <= ALL_PAIRS).groupBy("key").agg(F.collect_list("uid").alias("all")).select(F.explode("all").alias("uid"), "all").select("uid", F.explode("all").alias("head"))
    links = met.where(F.col("n") > ALL_PAIRS).select("uid", "head").union(small).where("uid != head")
    return links.select(F.least("uid", "head").alias("a"), F.greatest("uid", "head").alias("b")).distinct()


def open_rows(keys: DataFrame, heads: DataFrame, comps: DataFrame) -> DataFrame:
    """(uid, component) of the rows of large keys whose rows aren't all of one component yet."""
    large = keys.join(heads.where(F.col("n") > ALL_PAIRS).select("key"), "key").select("key", "uid")
    large = shared_table(large.join(comps.select(F.col("node").alias("uid"), "component"), "uid", "left").select("key", "uid", F.coalesce("component", "uid").alias("component")), "near-large")
    mixed = large.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
    return large.join(mixed, "key", "left_semi").select("uid", "component").distinct()


def shingle_counts(rows: DataFrame, width: int) -> np.ndarray:
    """How many of the texts have a shingle of each of ``SLOTS`` slots; no more than ``SLOTS`` numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                n[shingles(text.as_py(), width) & np.uint64(SLOTS - 1)] += 1
        slots = np.flatnonzero(n)
        for k in range(0, len(slots), 1 << 16):
            part = slots[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(n[part])], names=["slot", "n"])

    got = map_arrow(rows.select("text"), count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.uint32)
    out[got["slot"].to_numpy()] = np.minimum(got["n"].to_numpy(), np.iinfo(np.uint32).max)
    return out


def rare_links(rows: DataFrame, least: float, width: int) -> DataFrame:
    """(a, b), a < b, of (uid, component, text): all pairs of two components that can reach ``least``.

    They share one of their rarest shingles, so many are left from there on that the similarity is possible, and their
    ``parity_bits`` differ in no more than it allows. Of each shingle's rows, those of its commonest component meet only
    those of others.
    """
    shared = rows.sparkSession.sparkContext.broadcast(shingle_counts(rows, width))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = [shingles(text, width) for text in part.column(2).to_pylist()]
                heads = [rarest(s, counts, least) for s in sets]
                many = np.array([len(h) for h in heads])
                at = np.repeat(np.arange(len(sets)), many)
                place = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                size = np.array([len(s) for s in sets])[at]
                token = np.concatenate(heads).view(np.int64)
                odd = np.array([parity_bits(s) for s in sets])[at].ravel()
                bits = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * (BITS // 64), odd)
                uid, component = (part.column(i).take(pa.array(at)) for i in range(2))
                yield pa.RecordBatch.from_arrays([pa.array(token), uid, component, pa.array(size), pa.array(size - place), bits], names=names)

    names = ["token", "uid", "component", "size", "left", "bits"]
    schema = ", ".join(f"{n} array<bigint>" if n == "bits" else f"{n} bigint" for n in names)
    rare = shared_table(map_arrow(rows.select("uid", "component", "text"), spread, schema), "near-rare")
    top = rare.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.max(F.struct("n", "component")).alias("m"), F.count(F.lit(1)).alias("k"))
    met = shared_table(rare.join(top.where("k > 1").select("token", F.col("m.component").alias("top")), "token"), "near-met")
    x, y = met.where("component != top").alias("x"), met.alias("y")
    apart = functools.reduce(operator.add, [F.bit_count(F.col("x.bits")[i].bitwiseXOR(F.col("y.bits")[i])) for i in range(BITS // 64)])
    able = (F.least("x.left", "y.left") >= (F.col("x.size") + F.col("y.size")) * (least / (1 + least)) - 1e-6) & (
        apart <= (F.col("x.size") + F.col("y.size")) * ((1 - least) / (1 + least)) + 1e-6
    )
    once = (F.col("y.component") == F.col("y.top")) | (F.col("x.uid") < F.col("y.uid"))
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component")) & able & once)
    return pairs.select(F.least("x.uid", "y.uid").alias("a"), F.greatest("x.uid", "y.uid").alias("b")).distinct()


def verified(rows: DataFrame, links: DataFrame, least: float, width: int) -> DataFrame:
    """The links (a, b) between rows (uid, text) whose exact similarity is at least ``least``."""
    links = shared_table(links, "near-candidates")
    ends = links.select(F.explode(F.array("a", "b")).alias("uid")).distinct()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = [shingles(text, width).tobytes() for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["uid", "set"])

    sets = shared_table(map_arrow(rows.select("uid", "text").join(ends, "uid", "left_semi"), gather, "uid bigint, set binary"), "near-sets")
    of = lambda end: sets.select(F.col("uid").alias(end), F.col("set").alias(f"set_{end}"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(2), batch.column(3), strict=True)
            good = [jaccard(*(np.frombuffer(x.as_buffer(), np.uint64) for x in pair)) >= least - 1e-9 for pair in both]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = links.join(of("a"), "a").join(of("b"), "b").select("a", "b", "set_a", "set_b")
    return shared_table(map_arrow(both, verify, "a bigint, b bigint"), "near-links")


def simhash_links(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(a, b), a < b, of the rows of ``docs``, from ``number_rows``: candidates whose fingerprints differ in at most four bits.

    Rows of one fingerprint are tied to one of them, and fingerprints by ``anchor_links``, so no group is written as all its pairs.
    """
    rows = fingerprints(docs, id_col, text_col, width)
    first = F.min(F.struct(F.col("id").isNull().alias("z"), F.col("id").alias("i"), F.col("uid").alias("u"))).alias("first")
    points = shared_table(rows.groupBy("fp").agg(first).select("fp", F.col("first.u").alias("head")), "near-points")
    same = rows.join(points, "fp").select("uid", "head")
    of = lambda end, name: points.select(F.col("fp").alias(end), F.col("head").alias(name))
    close = anchor_links(points.select("fp")).join(of("a", "uid"), "a").join(of("b", "head"), "b").select("uid", "head")
    return same.union(close).where("uid != head").select(F.least("uid", "head").alias("a"), F.greatest("uid", "head").alias("b"))


def near_components(rows: DataFrame, least: float = 0.8, width: int = 5, first: DataFrame | None = None) -> DataFrame:
    """(node, component) of rows (uid, text) that a Jaccard similarity of at least ``least`` links to others.

    ``rows`` is scanned more than once, so uid must be stored with it. ``first`` (a, b) are candidates from elsewhere.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                uids, sigs, keys = [], [], [np.empty(0, np.int64)]
                for uid, text in zip(batch.column(0).slice(k, 512).to_pylist(), batch.column(1).slice(k, 512).to_pylist(), strict=True):
                    if len(h := shingles(text, width)):
                        uids.append(uid)
                        sigs.append(xxhash.xxh64_intdigest(h.tobytes()))
                        keys.append(bands(h))
                again = [pa.array(np.repeat(of, BANDS)) for of in (np.array(uids, np.int64), np.array(sigs, np.uint64).view(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *again], names=["key", "uid", "sig"])

    keys = shared_table(map_arrow(rows.select("uid", "text"), sign, "key bigint, uid bigint, sig bigint"), "near-bands")
    heads = shared_table(key_heads(keys), "near-heads")
    found = candidate_links(keys, heads)
    links = verified(rows, found if first is None else first.union(found).distinct(), least, width)
    comps = connected_components(links, "a", "b")
    rest = shared_table(rows.select("uid", "text").join(open_rows(keys, heads, comps), "uid").select("uid", "component", "text"), "near-open")
    more = verified(rows, rare_links(rest, least, width), least, width)
    return connected_components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), "a", "b")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, width: int = 5) -> DataFrame:
    """(row_uid, kept) of the rows of ``docs``, from ``number_rows``, that are in a class of more than one.

    ``kept`` marks one row of each class, that of the smallest id (null last), then the first
    read. Rows that aren't given have no near-duplicate; texts without a word never have.
    """
    rows = docs.select(row_number(docs).alias("uid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    comps = near_components(rows, least, width, simhash_links(docs, id_col, text_col, width)).select(F.col("node").alias("uid"), "component")
    members = shared_table(rows.select("uid", "id").join(comps, "uid"), "near-members")
    heads = members.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("z"), F.col("id").alias("i"), F.col("uid").alias("u"))).alias("head"))
    return members.join(heads, "component").select(F.col("uid").alias("row_uid"), (F.col("uid") == F.col("head.u")).alias("kept"))
