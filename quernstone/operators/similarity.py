"""Similar records: set joins with a prefix filter, groups and clusters."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators.components import connected_components
from quernstone.plans import cut, discard, map_arrow, shared_table

#: Links that are left when one task settles them in order, instead of further rounds (about 3 MB).
FEW_LINKS = 200_000
#: Sets that a token is in from which on it counts as frequent, and how many frequent slots of tokens are told apart (2 MB).
OFTEN, MAX_OFTEN = 100, 100_000
#: Slots that tokens are counted in (8 MB in a task).
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
#: Tokens of all sets of a block of those that meet to be compared (about 32 MB).
MET = 4_000_000
#: Ids that are broadcast (about 20 MB once hashed); beyond, both sides are shuffled.
MAX_BROADCAST_IDS = 200_000


def word_set(text: Column, longer_than: int = 2) -> Column:
    """Distinct lower-cased words of more than ``longer_than`` characters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > longer_than))


def shingle_set(text: Column, width: int = 5) -> Column:
    """Distinct hashes of the text's ``width``-word shingles; a shorter text is one shingle."""
    ws = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    whole = F.when(F.size(ws) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.array_join(ws, " "))))
    # words are hashed once, shingles from their words' hashes
    hashed = F.transform(F.array(F.transform(ws, lambda w: F.xxhash64(w))), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])))
    shingles = F.element_at(hashed, 1)
    return F.array_distinct(F.when(F.size(ws) < width, whole).otherwise(shingles))


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Set Jaccard of two arrays without repeats; null counts as 0, two empty ones as ``empty``."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.coalesce(F.when(union == 0, empty).otherwise(F.try_divide(both.cast("double"), union)), F.lit(0.0))


def dice(a: Column, b: Column, empty: float = 1.0) -> Column:
    total = F.size(a) + F.size(b)
    return F.coalesce(F.when(total == 0, empty).otherwise(F.try_divide(2.0 * F.size(F.array_intersect(a, b)), total)), F.lit(0.0))


def set_classes(df: DataFrame, row_id: str, tokens: str) -> tuple[DataFrame, DataFrame]:
    """((id, class), (class, tokens)): rows with the same set are one class, named by the smallest id.

    Sets are told apart by 96 bits of hashes and their size. The second table has all rows, also those that don't name their class; ``similar_pairs`` takes the names' ids
    as ``among``, so that no set is moved.
    """
    rows = shared_table(df.select(F.col(row_id).alias("class"), F.array_sort(tokens).alias("set")).withColumn("key", F.concat_ws("/", F.xxhash64("set"), F.hash("set"), F.size("set"))), "sets")
    keys = rows.select(F.col("class").alias("id"), "key")
    members = shared_table(keys.join(keys.groupBy("key").agg(F.min("id").alias("class")), "key").select("id", "class"), "members")
    return members, rows


def classes(df: DataFrame, row_id: str, tokens: str) -> tuple[DataFrame, DataFrame]:
    """((id, class), (class, tokens)): as ``set_classes``, with the sets of the rows that name their class alone."""
    members, rows = set_classes(df, row_id, tokens)
    return members, rows.join(names(members).select(F.col("id").alias("class")), "class", "left_semi").select("class", "set")


def names(members: DataFrame) -> DataFrame:
    """(id): the rows that name their class."""
    return members.where("id = class").select("id")


def _slots(tokens: np.ndarray) -> np.ndarray:
    """The slot of each token that it is counted in."""
    return (tokens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _slot_counts(s: DataFrame) -> DataFrame:
    """(slot, n): the number of sets with a token of each slot, each token counted; a task gives at most a row for each slot."""

    def run(batches):
        n = np.zeros(SLOTS, np.int64)
        for batch in batches:
            n += np.bincount(_slots(batch.column(0).flatten().to_numpy(zero_copy_only=False)), minlength=SLOTS)
        slots = np.flatnonzero(n)
        for k in range(0, len(slots), 1 << 16):
            part = slots[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(n[part])], names=["slot", "n"])

    return map_arrow(s.select("tokens"), run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))


def _prefixes(s: DataFrame, least: float) -> DataFrame:
    """(id, n, t, left): of each set's tokens, rare ones first, as many as two similar sets must share one of.

    ``left`` is the number of tokens from this one on: two sets whose first common token it is share no more.

    Any order that is the same for all sets will do, so only the tokens of slots with most sets, a bounded list, are
    put last by their number; all others stand by their hash. Tokens are counted by slot, in arrays, and never shuffled.
    """
    counts = shared_table(_slot_counts(s), "slot-counts")
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / SLOTS
    # a slot counts as frequent if it stands out from those that only rare tokens share
    many = counts.where(F.col("n") >= OFTEN + mean + 6 * math.sqrt(mean))
    often = [r["slot"] for r in many.orderBy(F.desc("n"), "slot").limit(MAX_OFTEN).collect()]
    discard(counts)
    by_count = np.array(often[::-1], np.int64)
    known = np.sort(by_count)
    place = np.argsort(by_count, kind="stable")  # of each known slot among those by their number
    sent = s.sparkSession.sparkContext.broadcast((known, place))

    def run(batches):
        known, place = sent.value
        for batch in batches:
            n = np.asarray(batch.column(1).value_lengths().to_numpy(zero_copy_only=False), np.int64)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), n)
            rank = np.full(len(flat), -1, np.int64)
            if len(known):
                slot = _slots(flat)
                at = np.minimum(np.searchsorted(known, slot), len(known) - 1)
                hit = known[at] == slot
                rank[hit] = place[at[hit]]
            order = np.lexsort((flat, rank, row))
            keep = n - np.ceil(n * least - 1e-9).astype(np.int64) + 1
            place_in_set = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            first = place_in_set < np.repeat(keep, n)
            own = order[first]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[own])), pa.array(n[row[own]]), pa.array(flat[own]), pa.array(n[row[own]] - place_in_set[first])], names=["id", "n", "t", "left"])

    return map_arrow(s.select("id", "tokens"), run, f"id {s.schema['id'].dataType.simpleString()}, n long, t long, left long")


def _signatures(s: DataFrame) -> DataFrame:
    """(id, n, bits): each set's size and a bit for each of 1,024 classes of tokens that it has one of.

    Two sets differ in as many tokens at least as their signatures in bits.
    """

    def run(batches):
        for batch in batches:
            n = np.asarray(batch.column(1).value_lengths().to_numpy(zero_copy_only=False), np.int64)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            bit, row = (flat >> np.uint64(54)).astype(np.int64), np.repeat(np.arange(len(n)), n)
            bits = np.zeros((len(n), 16), np.uint64)
            np.bitwise_or.at(bits, (row, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * 16, pa.int32()), pa.array(bits.reshape(-1).view(np.int64)))], names=["id", "n", "bits"])

    return map_arrow(s.select("id", "tokens"), run, f"id {s.schema['id'].dataType.simpleString()}, n long, bits array<long>")


def _of(s: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``s`` whose ids are in the pairs; the ids are broadcast if they were counted to be few."""
    ids = shared_table(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "pair-ids")
    return s.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids, "id", "left_semi")


def similar_pairs(sets: DataFrame, row_id: str, tokens: str, least: float, among: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity), a < b, of rows whose sets have a Jaccard similarity of at least ``least``.

    Exact, by prefix filtering: of two similar sets, in one order of all tokens, the prefixes of length
    n - ceil(least * n) + 1 share a token. Only these few tokens of a set are joined, and lengths
    must be within the factor ``least``; signatures rule most other candidates out, and sets are fetched for
    the rest alone. Collapse equal sets with ``classes`` first; ``among`` (id) names the rows to be paired.
    Empty sets are similar to nothing. Tokens are told apart by 64 bits: by their value if they are longs, else by their hash.
    """
    kind = sets.schema[tokens].dataType.elementType.simpleString()
    hashed = F.col("set") if kind == "bigint" else F.transform("set", lambda x: F.xxhash64(x))
    s = sets.select(F.col(row_id).alias("id"), F.col(tokens).alias("set")).where(F.size(tokens) > 0)
    s = (s if hasattr(sets, "shared_path") else shared_table(s, "similar-sets")).withColumn("tokens", hashed)
    prefix = _prefixes(s, least)
    if among is not None:
        prefix = prefix.join(among.select("id"), "id", "left_semi")
    a, b = prefix.toDF("a", "na", "t", "la"), prefix.toDF("b", "nb", "t", "lb")
    # at their first common token, two similar sets have enough tokens left to share
    enough = F.least("la", "lb") >= least / (1 + least) * (F.col("na") + F.col("nb")) - 1e-9
    near = a.join(b, "t").where((F.col("a") < F.col("b")) & (F.col("na") >= F.col("nb") * least - 1e-9) & (F.col("nb") >= F.col("na") * least - 1e-9) & enough).select("a", "b").distinct()
    near = shared_table(near, "candidates")
    signed = shared_table(_signatures(_of(s, near)), "signatures")
    differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    close = near.join(signed.toDF("a", "na", "sa"), "a").join(signed.toDF("b", "nb", "sb"), "b").where(differ <= (1 - least) / (1 + least) * (F.col("na") + F.col("nb")) + 1e-9).select("a", "b")
    close = shared_table(close, "close-pairs")
    discard(signed, near)
    return _verified(s.select("id", "tokens"), close).where(F.col("similarity") >= least - 1e-9)


def _verified(s: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, similarity) of the pairs, whose sets aren't empty."""

    def measure(x, y):
        both = len(np.intersect1d(x, y, assume_unique=True))
        return (both / (len(x) + len(y) - both),)

    return measured_pairs(s, pairs, measure, ["similarity"])


def measured_pairs(s: DataFrame, pairs: DataFrame, measure: Callable[[np.ndarray, np.ndarray], tuple], names: list[str]) -> DataFrame:
    """(a, b, and the named doubles that ``measure`` gives for their sorted tokens) of the pairs, ``s`` being (id, tokens).

    A set is sent to where pairs with it meet, not along with each pair. A pair belongs to the smallest id within two steps of its larger side, so pairs of a group of near copies meet in one
    place, also where not each two of them are paired; a place with more than ``MET`` tokens is cut into blocks by a hash, each two of which meet on their own.
    """
    kind = s.schema["id"].dataType.simpleString()
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select("b", "a"))
    low = both.groupBy("x").agg(F.least("x", F.min("y")).alias("low"))
    lower = both.join(low.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("low").alias("g"))
    placed = pairs.join(lower.withColumnRenamed("x", "b"), "b").select("g", "a", "b")
    each = lambda p: p.select(*[c for c in p.columns if c not in ("a", "b")], F.explode(F.array("a", "b")).alias("id")).distinct()
    used = _of(s, pairs)
    sizes = shared_table(used.select("id", F.size("tokens").alias("n")), "set-sizes")
    blocks = each(placed).join(sizes, "id").groupBy("g").agg((1 + F.floor(F.sum("n") / MET)).alias("blocks"))
    block = lambda x: F.pmod(F.xxhash64(x), F.col("blocks"))
    placed = placed.join(blocks, "g").select("g", F.least(block("a"), block("b")).alias("i"), F.greatest(block("a"), block("b")).alias("j"), "a", "b")
    placed = shared_table(placed, "placed-pairs")
    needed = each(placed).join(used, "id").select("g", "i", "j", F.col("id").alias("a"), F.lit(None).cast(kind).alias("b"), "tokens")
    rows = needed.union(placed.select("g", "i", "j", "a", "b", F.lit(None).cast("array<bigint>")))
    rows = rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", F.asc_nulls_first("b")).select("g", "i", "j", "a", "b", "tokens")

    def run(batches):
        place, held = None, {}
        for batch in batches:
            g, i, j, a, b = (c.to_pylist() for c in batch.columns[:5])
            lists = batch.column(5)
            out = []
            for k, here in enumerate(zip(g, i, j, strict=True)):
                if here != place:
                    place, held = here, {}
                if b[k] is None:
                    held[a[k]] = np.sort(np.array(lists[k].values.to_numpy(zero_copy_only=False)))
                else:
                    out.append((a[k], b[k], *measure(held[a[k]], held[b[k]])))
            if out:
                a, b, *found = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, batch.column(3).type), pa.array(b, batch.column(4).type), *[pa.array(x, pa.float64()) for x in found]], names=["a", "b", *names])

    return shared_table(map_arrow(rows, run, f"a {kind}, b {kind}, " + ", ".join(f"`{n}` double" for n in names)), "similar-pairs")


def clusters(pairs: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """(component, size, mean_similarity) of the components that pairs connect.

    With ``copies`` (class, n), the nodes of pairs are classes, of n rows with equal sets where named there and of one row elsewhere. Sizes and means are then
    those of rows and of all their pairs, copies being pairs with similarity 1, and copies alone are a component, too. They are counted by classes, so no rows are paired.
    """
    comp = connected_components(pairs, "a", "b")
    if copies is None:
        copies = comp.select(F.col("node").alias("class"), F.lit(1).cast("long").alias("n")).limit(0)
    node = comp.join(copies.withColumnRenamed("class", "node"), "node", "full").select("node", F.coalesce("component", "node").alias("component"), F.coalesce("n", F.lit(1)).alias("n"))
    node = shared_table(node, "cluster-nodes")
    linked = pairs.join(node.toDF("a", "component", "na"), "a").join(node.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    inner, across = F.col("n") * (F.col("n") - 1) / 2, (F.col("na") * F.col("nb")).cast("double")
    parts = node.select("component", "n", inner.alias("pairs"), inner.alias("sum"))
    parts = parts.union(linked.select("component", F.lit(0).cast("long"), across, across * F.col("similarity")))
    return parts.groupBy("component").agg(F.sum("n").alias("size"), (F.sum("sum") / F.sum("pairs")).alias("mean_similarity"))


def _settle_in_order(links: DataFrame) -> DataFrame:
    """(node): the members that the links a < b give, one after another; for a counted, small rest."""

    def run(batches):
        members: set[int] = set()
        for batch in batches:
            for a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if a not in members:  # all links to a came before, so a leads
                    members.add(b)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(members), pa.int64())], names=["node"])

    return map_arrow(links.select("a", "b").coalesce(1).sortWithinPartitions("a", "b"), run, "node long")


def leader_clusters(pairs: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(node, leader) of all nodes in ``pairs`` (a, b), a < b, as one pass in the order of ids would give it.

    In that pass a node that no earlier leader is similar to becomes a leader, and every other joins the
    first leader it is similar to. The leaders are the first maximal independent set in that order: a round
    takes all nodes without an unsettled earlier neighbour as leaders and their later neighbours as
    members, and drops both, until no link is left. When few links are left, one task settles them.
    """
    links = pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a < b").distinct()
    links = whole = shared_table(links, "links")
    members, steps = [], []
    while n := links.count():
        if n <= few:
            found = cut(_settle_in_order(links))
            members.append(found)
            break
        heads = links.select("a").distinct().join(links.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        found = cut(links.join(heads, "a", "left_semi").select(F.col("b").alias("node")).distinct())
        members.append(found)
        rest = links.join(found.select(F.col("node").alias("a")), "a", "left_anti").join(found.select(F.col("node").alias("b")), "b", "left_anti")
        links = cut(rest)
        steps.append(links)
    nodes = whole.select(F.col("a").alias("node")).union(whole.select("b")).distinct()
    if not members:
        return nodes.select("node", F.col("node").alias("leader"))
    member = members[0]
    for m in members[1:]:
        member = member.union(m)
    member = cut(member)
    # a member's leader may have been settled in a later round than the member
    joined = whole.join(member.select(F.col("node").alias("a")), "a", "left_anti").join(member.select(F.col("node").alias("b")), "b", "left_semi").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("leader"))
    discard(*members, *steps)
    leaders = nodes.join(member, "node", "left_anti").select("node", F.col("node").alias("leader"))
    return leaders.unionByName(joined)


def least_similarity(rows: DataFrame, group: str, tokens: str, floor: float = 0.0) -> DataFrame:
    """(group, n, n_sets, least): the least Jaccard similarity of two members of each group with two or more.

    Equal sets count as one with a number, so a group of copies costs nothing, and its least is 1. Distances to two
    sets of the group, its smallest and the one farthest from that, bound the distance of any two others (Jaccard
    distance keeps the triangle inequality); only pairs that could lie farther apart than the best so far are
    compared. Groups found below ``floor`` aren't searched on, and their ``least`` is that of a pair below it.
    Null sets count as empty; an empty set and another have 0 in common, two empty ones 1.
    """
    as_set = F.array_sort(F.coalesce(F.col(tokens), F.array().cast(rows.schema[tokens].dataType)))
    # a name that null groups have, too
    named = rows.select(F.to_json(F.struct(F.col(group).alias("g"))).alias("_group"), F.col(group).alias("value"), as_set.alias("set")).withColumn("key", F.md5(F.array_join(F.transform("set", lambda x: x.cast("string")), "\x00").cast("binary")))
    sets = shared_table(named.groupBy("_group", "key").agg(F.count(F.lit(1)).alias("n"), F.any_value("set").alias("set"), F.any_value("value").alias("value")), "group-sets")
    sizes = sets.groupBy("_group").agg(F.any_value("value").alias(group), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_sets")).where("n > 1")
    first = sets.groupBy("_group").agg(F.min_by("set", F.struct(F.size("set"), F.col("key"))).alias("pivot"))
    near = shared_table(sets.join(first, "_group").select("_group", "key", "set", jaccard(F.col("set"), F.col("pivot")).alias("s1")), "to-first")
    second = near.groupBy("_group").agg(F.min_by("set", F.struct("s1", "key")).alias("pivot"))
    both = shared_table(near.join(second, "_group").select("_group", "key", "set", "s1", jaccard(F.col("set"), F.col("pivot")).alias("s2")), "to-both")
    best = both.groupBy("_group").agg(F.least(F.min("s1"), F.min("s2")).alias("best"), F.min("s1").alias("far1"), F.min("s2").alias("far2"))
    # with s = 1 - distance: two sets can be less similar than ``best`` only if s + s' - 1 < best for both pivots
    could = lambda x, y, far: F.col(x) + F.col(y) - 1 < F.col(far) - 1e-12
    open_ = both.join(best.where((F.col("best") > 0) & (F.col("best") >= floor)), "_group").where(could("s1", "far1", "best") & could("s2", "far2", "best")).select("_group", "key", "s1", "s2", "best")
    pairs = open_.toDF("_group", "ka", "a1", "a2", "best").join(open_.drop("best").toDF("_group", "kb", "b1", "b2"), "_group").where((F.col("ka") < F.col("kb")) & could("a1", "b1", "best") & could("a2", "b2", "best")).select("_group", "ka", "kb")
    full = pairs.join(both.select("_group", F.col("key").alias("ka"), F.col("set").alias("sa")), ["_group", "ka"]).join(both.select("_group", F.col("key").alias("kb"), F.col("set").alias("sb")), ["_group", "kb"])
    found = full.groupBy("_group").agg(F.min(jaccard(F.col("sa"), F.col("sb"))).alias("found"))
    out = sizes.join(best.select("_group", "best"), "_group").join(found, "_group", "left")
    return out.select(group, "n", "n_sets", F.least("best", F.coalesce("found", "best")).alias("least"))


def token_links(df: DataFrame, row_id: str, file: str, text: str, least: float = 0.92, length_gap: float = 0.5) -> DataFrame:
    """(row_id, class, n_links): each row with the number of rows of other files that its text is similar to.

    Texts are similar if their lengths differ by at most ``length_gap`` of the longer and the sets of their
    words (between white space) have a Jaccard similarity of ``least`` or more. Rows of equal sets and lengths are
    one class, named by its smallest id; classes are joined, and links are counted by class and
    file, so copies are never paired row by row. Rows without a word have a class but no links; null files are one file.
    """
    words = F.array_distinct(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = df.select(F.col(row_id).alias("id"), F.col(file).alias("file"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("length"), F.array_sort(words).alias("words"))
    rows = rows.select("id", "file", "length", F.transform("words", lambda w: F.xxhash64(w)).alias("set"), F.sha2(F.array_join("words", " "), 256).alias("key"))
    rows = shared_table(rows, "token-rows")
    named = rows.select("id", "file", "length", "key", (F.size("set") > 0).alias("filled"))
    named = shared_table(named.withColumn("class", F.min("id").over(Window.partitionBy("key", "length"))).drop("key"), "token-classes")
    one = named.where(F.col("id") == F.col("class")).dropDuplicates(["class"])
    found = shared_table(similar_pairs(rows, "id", "set", least, one.select("id")).select("a", "b"), "token-pairs")
    size = one.select("class", "length")
    gated = found.join(size.toDF("a", "la"), "a").join(size.toDF("b", "lb"), "b").where(F.abs(F.col("la") - F.col("lb")) <= length_gap * F.greatest("la", "lb"))
    own = one.where("filled").select(F.col("class").alias("a"), F.col("class").alias("b"))
    links = shared_table(gated.select("a", "b").union(gated.select(F.col("b"), F.col("a"))).union(own), "token-links")
    by_file = shared_table(named.groupBy("class", "file").agg(F.count(F.lit(1)).alias("n")), "class-files")
    total = by_file.groupBy(F.col("class").alias("b")).agg(F.sum("n").alias("n"))
    around = links.join(total, "b").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("around"))
    # of those, the ones in the row's own file
    mine, theirs = by_file.select(F.col("class").alias("a"), "file"), by_file.select(F.col("class").alias("b"), F.col("file").alias("file2"), "n")
    same = mine.join(links, "a").join(theirs, (links["b"] == theirs["b"]) & F.col("file").eqNullSafe(F.col("file2"))).groupBy(F.col("a").alias("class"), "file").agg(F.sum("n").alias("same"))
    out = named.select("id", "file", "class").join(around, "class", "left").join(same.withColumnRenamed("class", "c2").withColumnRenamed("file", "f2"), (F.col("class") == F.col("c2")) & F.col("file").eqNullSafe(F.col("f2")), "left")
    return out.select(F.col("id").alias(row_id), "class", (F.coalesce("around", F.lit(0)) - F.coalesce("same", F.lit(0))).alias("n_links"))
