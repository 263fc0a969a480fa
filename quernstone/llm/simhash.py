"""SimHash near-duplicates by covering with anchor points.

Fingerprints that differ in at most four of 64 bits differ in at most two of the 31
bits of one of two halves (two bits take no part). In a half, the anchors are the
words of the Hamming code of length 31: a covering code of radius 1 that is perfect,
so every word has one nearest anchor. A pair at distance two has a word midway, at
distance one from both, and that word's anchor lies within radius 1 + 1 of both: each
fingerprint is replicated to every anchor within distance two (one if it is an anchor
itself, else 16), and the pair meets at one. There are 2**26 anchors for each half.

Equal fingerprints are one point throughout. The members of an anchor are compared
in the task that holds them, by growing linked sets, so that an anchor with k members
gives at most k - 1 links and all pairs of a large group are never written out.
Links become classes by ``connected_components``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.rows import row_number
from quernstone.operators.components import connected_components
from quernstone.plans import map_arrow, shared_table

HALF_BITS = 31
_HALF = (1 << HALF_BITS) - 1
#: Above so many members, an anchor is first split by pieces of the other bits.
_SPLIT_ABOVE = 4096


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """SimHash of the text's word shingles as an unsigned integer.

    A-Z are lower-cased, words are runs of other characters than U+0020 and U+0009 to
    U+000D. Texts with fewer than ``width`` words have one shingle, the whole sequence;
    texts without a word have the fingerprint zero.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    begins = [0, *(ends[: n - width] + 1).tolist()]
    ends = ends[width - 1 :].tolist()
    total, count = np.zeros(64, np.int64), n - width + 1
    for k in range(0, count, 65536):
        h = np.array([digest(joined[b:e], seed) for b, e in zip(begins[k : k + 65536], ends[k : k + 65536], strict=True)], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > count, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(uid, id, fp) for each row, fp as a signed long; written once to the shared folder."""
    src = docs.select(row_number(docs).alias("uid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                fp = np.array([fingerprint(t, width, seed) for t in part.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp)], names=["uid", "id", "fp"])

    return shared_table(map_arrow(src, run, f"uid bigint, id {src.schema['id'].dataType.simpleString()}, fp bigint"), "fingerprints")


def _anchors(half: Column) -> Column:
    """Hamming code words within distance two of a 31-bit word.

    Bits have the positions 1 to 31, and the syndrome s is the XOR of the positions of
    the set bits. Turning bits i and i XOR s leads to a code word, for every i; position
    0 stands for no bit.
    """
    s = F.lit(0)
    for k in range(5):
        mask = sum(1 << (p - 1) for p in range(1, HALF_BITS + 1) if p >> k & 1)
        s = s.bitwiseOR(F.shiftleft(F.bit_count(half.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)), k))
    bit = lambda p: F.when(p == 0, F.lit(0).cast("long")).otherwise(F.expr("1L") * F.element_at(F.array(*[F.lit(1 << (q - 1)).cast("long") for q in range(1, HALF_BITS + 1)]), F.greatest(p, F.lit(1))))
    positions = F.array(*[F.lit(p) for p in range(HALF_BITS + 1)])

    def near(pair: Column) -> Column:
        x, s = pair["x"], pair["s"]
        some = F.filter(positions, lambda i: i < i.bitwiseXOR(s))
        return F.when(s == 0, F.array(x)).otherwise(F.transform(some, lambda i: x.bitwiseXOR(bit(i)).bitwiseXOR(bit(i.bitwiseXOR(s)))))

    return F.element_at(F.transform(F.array(F.struct(half.alias("x"), s.alias("s"))), near), 1)


def replicas(points: DataFrame) -> DataFrame:
    """(half, anchor, fp): every fingerprint at every anchor within reach, in both halves."""
    low = F.col("fp").bitwiseAND(F.lit(_HALF))
    high = F.shiftrightunsigned("fp", HALF_BITS).bitwiseAND(F.lit(_HALF))
    both = F.array(F.struct(F.lit(0).alias("half"), low.alias("x")), F.struct(F.lit(1).alias("half"), high.alias("x")))
    halves = points.select("fp", F.explode(both).alias("h")).select("fp", F.col("h.half").alias("half"), F.col("h.x").alias("x"))
    return halves.select("half", F.explode(_anchors(F.col("x"))).alias("anchor"), "fp")


def _differing(a: np.ndarray, b) -> np.ndarray:
    """Differing bits; signed values would be counted by magnitude."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _grow(fps: np.ndarray, most: int, links: list[tuple[int, int]]) -> None:
    """Spanning links of the sets that distances up to ``most`` connect."""
    rest = fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            a = queue.pop()
            near = _differing(rest, a) <= most
            if near.any():
                found = rest[near]
                links.extend((int(a), int(b)) for b in found)
                queue.extend(found)
                rest = rest[~near]


def member_links(fps: np.ndarray, half: int, most: int = 4) -> list[tuple[int, int]]:
    """Links between the distinct fingerprints at one anchor, at most a spanning forest of each piece.

    A large anchor is split by five pieces of the bits outside its half: fingerprints at
    distance up to four agree in one of them.
    """
    links: list[tuple[int, int]] = []
    if len(fps) <= _SPLIT_ABOVE or most > 4:
        _grow(fps, most, links)
        return links
    unsigned = fps.view(np.uint64)
    other = unsigned >> np.uint64(HALF_BITS) if half == 0 else unsigned & np.uint64(_HALF) | unsigned >> np.uint64(2 * HALF_BITS) << np.uint64(HALF_BITS)
    for piece in range(5):
        value = other >> np.uint64(7 * piece) & np.uint64(127 if piece < 4 else 31)
        order = np.argsort(value, kind="stable")
        for group in np.split(fps[order], np.flatnonzero(np.diff(value[order])) + 1):
            _grow(group, most, links)
    return links


def anchor_links(points: DataFrame, most: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect exactly what all links connect."""
    if most > 5:
        raise ValueError("two halves cover at most five differing bits")
    dealt = replicas(points).select((F.col("anchor") * 2 + F.col("half")).alias("key"), "fp").repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.int64)

        def links_of(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            links: list[tuple[int, int]] = []
            cuts = np.flatnonzero(np.diff(key)) + 1
            begins, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
            pairs = begins[ends - begins == 2]
            a, b = fp[pairs], fp[pairs + 1]
            close = _differing(a, b) <= most
            for k in np.flatnonzero(ends - begins > 2):
                links += member_links(fp[begins[k] : ends[k]], int(key[begins[k]] & 1), most)
            more = np.array(links, dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate((a[close], more[:, 0]))), pa.array(np.concatenate((b[close], more[:, 1])))], names=["a", "b"])

        for batch in batches:
            # the last anchor may go on in the next batch
            key, fp = np.concatenate((key, batch.column(0).to_numpy())), np.concatenate((fp, batch.column(1).to_numpy()))
            if len(key) and key[0] != key[-1]:
                cut = int(np.searchsorted(key, key[-1]))
                yield links_of(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        if len(key):
            yield links_of(key, fp)

    return map_arrow(dealt, run, "a bigint, b bigint")


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id, kept, row_uid.

    Null and blank texts have the fingerprint zero, which links like any other.
    ``component_id`` is the smallest id reachable through links (null only if all ids of
    the class are null); ``kept`` marks one row of each class, that of the smallest id, the
    first read where ids repeat. An empty table gives an empty result; further columns
    are ignored.
    """
    rows = fingerprints(docs, id_col, text_col, width, seed)
    first = F.min(F.struct(F.col("id").isNull().alias("z"), F.col("id").alias("i"), F.col("uid").alias("u"))).alias("first")
    points = shared_table(rows.groupBy("fp").agg(first), "points")
    comps = connected_components(anchor_links(points, most), "a", "b")
    labelled = points.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("label"), "first")
    labelled = shared_table(labelled, "labelled")
    heads = labelled.groupBy("label").agg(F.min("first").alias("head"))
    of_point = labelled.select("fp", "label").join(heads, "label").select("fp", "head")
    return rows.join(of_point, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("head.i").alias("component_id"), (F.col("uid") == F.col("head.u")).alias("kept"), F.col("uid").alias("row_uid"),
    )
