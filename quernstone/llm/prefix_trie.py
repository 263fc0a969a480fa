"""A trie over the turns of conversations, built from mergeable partial tries.

Texts are read once and go on as digests of 16 bytes. Conversations are dealt out by
ranges of their ids, and a prefix is known by a chained digest. Each range gives partial
tries, tables of nodes with the number of members, the smallest member and the list of
ids that end there; partial tries are merged by node, sixteen neighbouring ranges at a
time, until one is left. Ranges don't overlap, so lists are merged by writing one behind
the other; a list is held in pieces of bounded size, and the last merge digests the pieces
as a stream.

Sums over subtrees go from the bottom up. Every node belongs to its smallest member; as
the members of a prefix include those of all that follow it, the nodes of a conversation
are the lower end of its path. Each such conversation adds from its deepest node upwards
and gives every node of its path what lies below; adding these gives the subtrees' sums
in one step, however deep the trie is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.plans import map_arrow, shared_table

#: Nodes, and ids in all lists, that a partial trie holds before it is given out.
MAX_NODES = 100_000
#: Ids in a piece of a list.
PIECE = 1 << 16
#: Neighbouring partial tries that one merge brings together, as bits.
FAN_IN_BITS = 4
#: The node of the empty prefix.
ROOT = bytes(16)

_PATHS = "conv_id long, depth int, node binary, parent binary, bytes long, ends boolean, part int"
_PARTIAL = "node binary, parent binary, depth int, bytes long, part int, n long, conv_id long, lo long, ids binary"
_NODES = "node binary, parent binary, depth int, bytes long, n_convs long, conv_id long, n_ends long, ends_sha256 string"


def turn_keys(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, bytes): each turn as a digest of its role and text, numbered from 1.

    Turns stand in the order of ``turn`` (null first, equal ones by their digest); null roles and texts
    count as empty. Rows without a conv_id belong to no conversation and are left out. ``bytes``
    is the length of the text in UTF-8.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), "digest", "bytes")


def share_prefixes(keys: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """Conversations rebuilt on a common beginning: (conv_id, pos, digest, bytes), with a row of pos 0 for each.

    Conversation c takes the first h turns of c - c % family, h being crc32 of its decimal id % heads,
    and then its own turns after its first h. Each family has few members and lends few turns.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % heads
    convs = keys.select("conv_id").distinct()
    first = keys.where(F.col("pos") < heads).withColumnRenamed("conv_id", "base")
    lent = convs.withColumn("h", h).where("h > 0").join(first, (F.col("base") == F.col("conv_id") - F.col("conv_id") % family) & (F.col("pos") <= F.col("h")))
    own = keys.where(F.col("pos") > h)
    none = convs.select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    return lent.select("conv_id", "pos", "digest", "bytes").union(own).union(none)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 8 + len(r[-1]) // 256 if isinstance(r[-1], bytes) else 8
        if size >= 8 * most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def prefix_paths(keys: DataFrame) -> DataFrame:
    """A row for each conversation and prefix, the empty one included, written once in ranges of ids.

    ``keys`` are rows of ``turn_keys`` or ``share_prefixes``; a conversation without turns needs a row of pos 0.
    """
    rows = keys.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "digest", "bytes")

    def made(batches):
        from pyspark import TaskContext

        part, conv, held = TaskContext.get().partitionId(), None, None
        for c, digest, size in _stream(batches):
            if c != conv:
                if held:
                    yield (*held, True, part)
                conv, held = c, (c, 0, ROOT, None, 0)
            if digest is not None:
                yield (*held, False, part)
                _, depth, node, _, _ = held
                held = (c, depth + 1, hashlib.blake2b(node + digest, digest_size=16).digest(), node, size)
        if held:
            yield (*held, True, part)

    return shared_table(map_arrow(rows, lambda b: _batches(made(b), _arrow(_PATHS)), _PATHS), "trie-paths")


def partial_tries(paths: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """Tables of nodes, each of neighbouring conversations of one range, with at most ``max_nodes`` nodes and ids."""

    def made(batches):
        trie: dict[bytes, list] = {}
        now, ids = None, 0

        def out():
            for node, (parent, depth, size, n, conv, ends) in trie.items():
                yield node, parent, depth, size, now, n, conv, ends[0] if ends else None, np.array(ends, np.int64).tobytes()
            trie.clear()

        for conv, depth, node, parent, size, ends, part in _stream(batches):
            if part != now or len(trie) >= max_nodes or ids >= max_nodes:
                yield from out()
                now, ids = part, 0
            entry = trie.get(node)
            if entry is None:
                entry = trie[node] = [parent, depth, size, 0, conv, []]
            entry[3] += 1
            if ends:
                entry[5].append(conv)
                ids += 1
        yield from out()

    return map_arrow(paths.select("conv_id", "depth", "node", "parent", "bytes", "ends", "part"), lambda b: _batches(made(b), _arrow(_PARTIAL)), _PARTIAL)


def _together(batches) -> Iterator[list[tuple]]:
    """Rows of a node and part, one after another: (is it another group, row)."""
    last = None
    for r in _stream(batches):
        yield (r[0], r[4]) != last, r
        last = (r[0], r[4])


def merge_tries(partial: DataFrame, bits: int = FAN_IN_BITS, piece: int = PIECE) -> DataFrame:
    """One level of the merge: 2**bits neighbouring partial tries become one."""
    rows = partial.withColumn("part", F.shiftright("part", bits)).repartition("node", "part").sortWithinPartitions("node", "part", F.asc_nulls_first("lo"))

    def made(batches):
        held, ids = None, b""
        for other, (node, parent, depth, size, part, n, conv, lo, own) in _together(batches):
            if other:
                if held:
                    yield (*held, ids)
                held, ids = None, b""
            if held and lo is not None and len(ids) + len(own) > 8 * piece and ids:
                yield (*held, ids)
                held, ids = (node, parent, depth, size, part, 0, held[6], None), b""  # what follows is a further piece
            if not held:
                held = (node, parent, depth, size, part, 0, conv, None)
            held = (*held[:5], held[5] + n, min(held[6], conv), lo if held[7] is None else held[7])
            ids += own
        if held:
            yield (*held, ids)

    return map_arrow(rows, lambda b: _batches(made(b), _arrow(_PARTIAL)), _PARTIAL)


def finish_tries(partial: DataFrame) -> DataFrame:
    """The last merge: one row for each node, lists of ids digested in order."""
    rows = partial.withColumn("part", F.lit(0)).repartition("node").sortWithinPartitions("node", F.asc_nulls_first("lo"))

    def made(batches):
        held, digest, n_ends = None, None, 0

        def row():
            return (*held, n_ends, digest.hexdigest())

        for other, (node, parent, depth, size, _, n, conv, _, own) in _together(batches):
            if other:
                if held:
                    yield row()
                held, digest, n_ends = (node, parent, depth, size, 0, conv), hashlib.sha256(), 0
            held = (*held[:4], held[4] + n, min(held[5], conv))
            if own:
                text = ",".join(map(str, np.frombuffer(own, np.int64).tolist()))
                digest.update(f",{text}".encode() if n_ends else text.encode())
                n_ends += len(own) // 8
        if held:
            yield row()

    return map_arrow(rows, lambda b: _batches(made(b), _arrow(_NODES)), _NODES)


def merged_nodes(paths: DataFrame, bits: int = FAN_IN_BITS, max_nodes: int = MAX_NODES, piece: int = PIECE) -> DataFrame:
    """Partial tries of ``paths``, merged level by level to one row for each node, written once."""
    last = paths.agg(F.max("part")).collect()[0][0] or 0
    level = partial_tries(paths, max_nodes)
    while last >> bits:
        level, last = merge_tries(level, bits, piece), last >> bits
    return shared_table(finish_tries(level), "trie-nodes")


def roll_up(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """``nodes`` with parent_conv_id, n_children, n_leaves and saved_tokens."""
    long = lambda x: F.lit(x).cast("long")
    own = nodes.select("conv_id", "depth", "node", F.lit(0).alias("step"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaf"), "parent", "n_convs", "ends_sha256")
    walk = paths.select("conv_id", "depth", "node", F.lit(1).alias("step"), long(0).alias("saved"), long(0).alias("leaf"), F.lit(None).cast("binary").alias("parent"), long(None).alias("n_convs"), F.lit(None).cast("string").alias("ends_sha256"))
    up = Window.partitionBy("conv_id").orderBy(F.desc("depth"), "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("conv_id")
    is_own = F.col("step") == 0
    summed = own.union(walk).select(
        "*", F.sum("saved").over(up).alias("below"), F.sum("leaf").over(up).alias("leaves"), F.sum(1 - F.col("step")).over(up).alias("owned"), F.sum(1 - F.col("step")).over(whole).alias("all_owned"),
    ).where("owned > 0")
    # a node of the same conversation's chain has its parent there, too, but for the chain's upper end
    near = F.when(is_own, F.when(F.col("owned") == F.col("all_owned"), F.col("parent")).otherwise(F.col("node")))

    def part(node, leaves=0, saved=0, children=0, whole=False):
        kept = lambda c, kind: (F.col(c) if whole else F.lit(None).cast(kind)).alias(c)
        as_long = lambda x, name: (F.lit(x) if isinstance(x, int) else x).cast("long").alias(name)
        return F.struct(node.alias("node"), as_long(leaves, "leaves"), as_long(saved, "saved"), as_long(children, "children"), kept("conv_id", "long"), kept("depth", "int"), kept("n_convs", "long"), kept("ends_sha256", "string"), (near if whole else F.lit(None).cast("binary")).alias("near"))

    parts = F.when(is_own, F.array(part(F.col("node"), whole=True), part(F.col("parent"), children=1))).otherwise(F.array(part(F.col("node"), F.col("leaves"), F.col("below"))))
    rows = summed.select(F.explode(parts).alias("p")).select("p.*").where(F.col("node").isNotNull())
    one = [F.max(c).alias(c) for c in ("conv_id", "depth", "n_convs", "ends_sha256", "near")]
    out = rows.groupBy("node").agg(*one, F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    above = nodes.select(F.col("node").alias("near"), F.col("conv_id").alias("parent_conv_id"))
    return out.join(above.hint("merge"), "near", "left").drop("near")


def prefix_trie(keys: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the conversations in ``keys``, the empty one included.

    node, conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs (members),
    n_children, n_leaves and saved_tokens (over the subtree, itself included), ends_sha256 (of the
    ids of the members that end here, in ascending order). Equal conversations share all their
    nodes. Without conversations there is no node.
    """
    paths = prefix_paths(keys)
    return roll_up(merged_nodes(paths), paths)
