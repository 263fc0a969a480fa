"""Interpolated modified Kneser-Ney over word trigrams, estimated and applied in shards.

Words are hashed into 2**21 slots, so that a trigram is one number of 63 bits and all that
is kept for single words fits into arrays of a fixed size. Those arrays are all that is ever
broadcast; pairs and trigrams grow with the trusted text and stay in shards of a hash of
their pair, packed as sorted arrays (``packed.py``).

1. Statistics: tasks count their texts' trigrams u v w and deal them out by the pair (v, w).
   A shard then knows of every pair how many words stand in front, from which come the
   counts of single words, their contexts and all discounts.
2. Estimate: the trigrams are counted again, each pair gets its probability, and the trigrams
   go on, with that of (v, w), to the shard of their context (u, v), where totals and left
   mass are counted and the values of pairs and trigrams fall out.
3. Score: in back-off form a log probability is a sum of one value for each n-gram met, plus
   a constant for each word. A document sends each (x, y, z) of its words to the shard of
   (x, y), once; there the pair's and the trigram's values are looked up and summed.

The steps 2 and 3 run in rounds over ranges of shards, so that only one range's n-grams
are on disk at a time, whatever the corpus; texts are read once for each round. Values are
kept as 16-bit floats.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.packed import SCHEMA, by_shard, deal, exchange, hash_of, merged, pack, shard_of, starts, to_batches, unpack
from quernstone.plans import discard, map_arrow, shared_table

BITS = 21
SLOTS = 1 << BITS
NONE, EDGE, END = 0, 1, 2
_LOW = SLOTS - 1
#: Texts are handled in equal portions of about so many bytes, longer ones alone.
_PORTION = 3_000_000
#: Bytes are hashed in blocks of whole texts, of about so many bytes each, which bounds a worker's arrays.
_BLOCK = 400_000
#: Documents whose sums a task holds before it sends them on (about 50 MB).
_HELD = 2_000_000
_BASE = 0x9E3779B97F4A7C15
_FINISH = np.uint64(0xD6E8FEB86659FD93)

# Bytes that part words, and one of which may go in front of a word or behind it.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_OPENS = np.zeros(256, bool)
_OPENS[list(b"(\"'")] = True
_CLOSES = np.zeros(256, bool)
_CLOSES[list(b".,;:?!)\"'")] = True


class Slots:
    """Slots of the words of texts, worked out for many texts at once.

    A word is a run of other characters than white space, lower-cased, without one opening
    mark in front and one sentence mark behind; other signs belong to it. Its hash is a
    polynomial of its bytes, taken from sums over all bytes of the texts.
    """

    def __init__(self) -> None:
        self.powers = self.inverse = np.empty(0, np.uint64)

    def _reserve(self, n: int) -> None:
        if len(self.powers) < n:
            power = lambda x: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, x, np.uint64))))
            self.powers, self.inverse = power(_BASE), power(pow(_BASE, -1, 1 << 64))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slots, number of the text) of the words of texts that begin at ``offsets`` in ``data`` and end at the next."""
        n = len(data)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        inside = ~_SPACE[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        before = np.empty(n, bool)
        before[0], before[1:] = False, inside[:-1]
        begin = np.flatnonzero(inside & (~before | cut[:-1]))
        before[:-1], before[-1] = inside[1:], False
        end = np.flatnonzero(inside & (~before | cut[1:])) + 1
        text = np.searchsorted(offsets, begin, side="right") - 1
        begin = begin + (_OPENS[data[begin]] & (end - begin > 1))
        end = end - (_CLOSES[data[end - 1]] & (end - begin > 1))
        self._reserve(n)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.powers[:n] * (data.astype(np.uint64) + np.uint64(1)), out=sums[1:])
        h = (sums[end] - sums[begin]) * self.inverse[begin]
        h ^= h >> np.uint64(32)
        h *= _FINISH
        return ((h >> np.uint64(32)) % np.uint64(SLOTS - 3)).astype(np.int64) + 3, text

    def portions(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, slots, number of the text within the portion); null texts count as empty.

        A text is its words' slots between two edges in front and the end.
        """
        lower = pc.utf8_lower(pc.fill_null(column, "")).cast(pa.large_string())
        if not len(lower):
            return
        _, places, data = lower.buffers()
        offsets = np.frombuffer(places, np.int64)[lower.offset : lower.offset + len(lower) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        # a little more than an equal share, as portions end with a whole text; no tiny one is left over
        total = int(offsets[-1] - offsets[0])
        size = int(1.05 * total / max(1, math.ceil(total / _PORTION - 0.1))) + 1
        first = 0
        while first < len(lower):
            last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
            last = min(max(last, first + 1), first + 65535, len(lower))
            found, at = [], first
            while at < last:
                end = int(np.searchsorted(offsets, offsets[at] + _BLOCK, side="right")) - 1
                end = min(max(end, at + 1), last)
                slots, text = self.words(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
                found.append((slots, text + (at - first)))
                at = end
            slots, text = (np.concatenate(x) for x in zip(*found, strict=True))
            docs = last - first
            w = np.full(len(slots) + 3 * docs, EDGE, np.int64)
            w[np.arange(len(slots)) + 3 * text + 2] = slots
            sizes = np.bincount(text, minlength=docs) + 3
            w[np.cumsum(sizes) - 1] = END
            yield first, w, np.repeat(np.arange(docs), sizes)
            first = last


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and their counts."""
    keys = np.sort(keys)
    at = starts(keys)
    return keys[at], np.diff(np.append(at, len(keys)))


def trigram_rows(texts: DataFrame, shard_bits: int) -> DataFrame:
    """Packed (v w u, n) of the texts' trigrams u v w, dealt by (v, w); tasks count their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for batch in batches:
            for _, w, at in slots.portions(batch.column(0)):
                # a text without a word has nothing but the edges and the end
                inside = (at[2:] == at[:-2]) & ((w[1:-1] != EDGE) | (w[2:] != END))
                keys, n = _distinct((w[1:-1] << 2 * BITS | w[2:] << BITS | w[:-2])[inside])
                yield from to_batches(deal(0, shard_of(keys >> BITS, shard_bits), keys, n.astype(np.uint32)))

    return map_arrow(texts, run, SCHEMA)


def _shard_trigrams(rows: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams (v w u) of a shard with their counts; its pairs (v w), where they begin, and the number of words in front."""
    keys, n = merged([unpack(d, np.uint32) for _, d in rows])
    at = starts(keys)
    keys, n = keys[at], np.add.reduceat(n.astype(np.int64), at)
    begin = starts(keys >> BITS)
    return keys, n, keys[begin] >> BITS, begin, np.diff(np.append(begin, len(keys)))


def _discounts(c: np.ndarray) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of n-grams with counts 1 to 4; usual fallbacks where they are too few."""
    if not c[0] or not c[1]:
        return 0.5, 0.75, 0.9
    y = c[0] / (c[0] + 2 * c[1])
    d = [k - (k + 1) * y * c[k] / c[k - 1] if c[k - 1] else 0.9 * k for k in (1, 2, 3)]
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))  # type: ignore[return-value]


def _cut(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(n == 1, d[0], np.where(n == 2, d[1], d[2]))


@dataclass
class Words:
    """What the model keeps for single words, in arrays of ``SLOTS`` entries, and its discounts.

    ``q``: probability of the word. ``left``: mass that it leaves, as a context, to shorter n-grams (1 if
    never seen as such). ``total``: words counted after it. ``occurs``: its occurrences.
    """

    q: np.ndarray
    left: np.ndarray
    total: np.ndarray
    occurs: np.ndarray
    d2: tuple[float, float, float]
    d3: tuple[float, float, float]
    #: log probability of a word that the trusted texts don't have
    unknown: float


_RANGE_BITS = 5
#: counted for a word: pairs that end with it, its occurrences, and of the pairs that begin with it the words in front, and how many have one, two, more
_STATS = 6


def count_words(texts: DataFrame, shard_bits: int, partitions: int) -> Words:
    """Step 1, for a non-empty text table; ends with arrays of ``SLOTS`` entries on the driver."""

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((_STATS, SLOTS), np.int32)
        kinds = np.zeros(8, np.int64)
        for _, rows in by_shard(batches):
            _, n, pairs, begin, front = _shard_trigrams(rows)
            v, w = pairs >> BITS, pairs & _LOW
            np.add.at(sums[0], w, 1)
            np.add.at(sums[1], w, np.add.reduceat(n, begin))
            np.add.at(sums[2], v, front)
            np.add.at(sums, (2 + np.minimum(front, 3), v), 1)
            kinds[:4] += [np.count_nonzero(front == k) for k in (1, 2, 3, 4)]
            kinds[4:] += [np.count_nonzero(n == k) for k in (1, 2, 3, 4)]
        yield from summary(sums, kinds)

    def summary(sums: np.ndarray, kinds: np.ndarray) -> Iterator[pa.RecordBatch]:
        word = np.flatnonzero(sums.any(axis=0))
        rows = deal(0, (word >> BITS - _RANGE_BITS).astype(np.int32), word, *sums[:, word].astype(np.int64))
        yield from to_batches([*rows, (1 << _RANGE_BITS, 1, pack(np.arange(8), kinds))])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in by_shard(batches):
            kind = rows[0][0]
            parts = merged([unpack(d, *[np.int64] * (_STATS if kind == 0 else 1)) for _, d in rows])
            at = starts(parts[0])
            yield from to_batches([(shard, kind, pack(parts[0][at], *[np.add.reduceat(c, at) for c in parts[1:]]))])

    counted = map_arrow(exchange(trigram_rows(texts, shard_bits), partitions), stats, SCHEMA)
    # at most 2**21 entries in all, whatever the corpus
    table = shared_table(map_arrow(exchange(counted, min(partitions, 1 << _RANGE_BITS)), add_up, SCHEMA), "kn-words")
    sums, kinds = np.zeros((_STATS, SLOTS), np.int64), np.zeros(8, np.int64)
    for r in table.collect():
        if r.kind == 0:
            word, *found = unpack(r.data, *[np.int64] * _STATS)
            sums[:, word] = found
        else:
            kinds = unpack(r.data, np.int64)[1]
    discard(table)
    ends, occurs, total, *classes = sums
    d1 = _discounts(np.array([np.count_nonzero(ends == k) for k in (1, 2, 3, 4)]))
    d2, d3 = _discounts(kinds[:4]), _discounts(kinds[4:])
    seen, everything = ends > 0, int(ends.sum())
    rest = float(_cut(ends[seen], d1).sum()) / everything / (int(seen.sum()) + 1)
    q = np.where(seen, np.maximum(ends - _cut(ends, d1), 0) / everything, 0) + rest
    held = d2[0] * classes[0] + d2[1] * classes[1] + d2[2] * classes[2]
    left = np.where(total > 0, held / np.maximum(total, 1), 1.0)
    return Words(q.astype(np.float32), left.astype(np.float32), total.astype(np.float32), np.minimum(occurs, 2**32 - 1).astype(np.uint32), d2, d3, math.log(rest))


@dataclass
class WordModel:
    """A trained model: arrays for single words, and packed shards of pairs and trigrams in the shared folder.

    Rows of ``shards`` have kind 0, (x y; value, occurrences), and 1, (x y z; value, occurrences).
    """

    words: Words
    shards: list[DataFrame]
    shard_bits: int
    partitions: int

    def drop(self) -> None:
        """Delete the shards; the model can't score any more."""
        discard(*self.shards)


def _round(shard: np.ndarray, shard_bits: int, rounds: int) -> np.ndarray:
    """The round that a shard belongs to."""
    return shard.astype(np.int64) * rounds >> shard_bits


def estimate(texts: DataFrame, words: Words, shard_bits: int, partitions: int, rounds: int) -> list[DataFrame]:
    """Step 2: one table of packed shards for each round."""
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def one(r: int) -> DataFrame:
        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            # what goes on, from one shard after another: pairs and trigrams, each with a value and a count
            held: tuple[list, list] = ([], [])
            size = 0

            def hold(kind: int, keys: np.ndarray, context: np.ndarray, value: np.ndarray, n: np.ndarray) -> int:
                own = np.flatnonzero(_round(shard_of(context, shard_bits), shard_bits, rounds) == r)
                held[kind].append([keys[own], value[own], n[own]])
                return len(own)

            def dealt() -> Iterator[pa.RecordBatch]:
                for kind, parts in enumerate(held):
                    if parts:
                        keys, value, n = (np.concatenate(c) for c in zip(*parts, strict=True))
                        order = np.argsort(keys)
                        keys = keys[order]
                        yield from to_batches(deal(kind, shard_of(keys >> kind * BITS, shard_bits), keys, value[order], n[order]))
                        parts.clear()

            for _, rows in by_shard(batches):
                keys, n, pair, begin, front = _shard_trigrams(rows)
                v, w = pair >> BITS, pair & _LOW
                low = m.left[v] * m.q[w]
                p = np.maximum(front - _cut(front, m.d2), 0) / m.total[v] + low
                size += hold(0, pair, pair, np.log(p / low).astype(np.float16), np.add.reduceat(n, begin).astype(np.uint32))
                times = np.diff(np.append(begin, len(keys)))
                context = (keys & _LOW) << BITS | np.repeat(v, times)
                size += hold(1, context << BITS | np.repeat(w, times), context, np.repeat(np.log(p).astype(np.float16), times), n.astype(np.uint32))
                if size > 2_000_000:
                    yield from dealt()
                    size = 0
            yield from dealt()

        def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for shard, rows in by_shard(batches):
                none = [np.empty(0, np.int64), np.empty(0, np.float16), np.empty(0, np.uint32)]
                of = lambda kind: merged([unpack(d, np.float16, np.uint32) for k, d in rows if k == kind] or [none])  # noqa: E731, B023
                (pair, gain, occurs), (key, logp, n) = of(0), of(1)
                begin = starts(key >> BITS)
                context = key[begin] >> BITS
                size = np.diff(np.append(begin, len(key)))
                cut = _cut(n, m.d3)
                if len(key):
                    total = np.add.reduceat(n.astype(np.float64), begin)
                    left = np.add.reduceat(cut, begin) / total
                    own = np.maximum(n - cut, 0) / np.repeat(total, size)
                    value = np.log1p(own / (np.repeat(left, size) * np.exp(logp.astype(np.float64))))
                else:
                    total = left = value = np.empty(0)
                both = np.union1d(pair, context)
                short, times = np.zeros(len(both)), np.zeros(len(both), np.uint32)
                short[at := np.searchsorted(both, context)] = np.log(left)
                times[at] = total
                short[at := np.searchsorted(both, pair)] += gain
                times[at] = occurs
                yield from to_batches([(shard, 0, pack(both, short.astype(np.float16), times)), (shard, 1, pack(key, value.astype(np.float16), n))])

        counted = map_arrow(exchange(trigram_rows(texts, shard_bits), partitions), pairs, SCHEMA)
        return shared_table(map_arrow(exchange(counted, partitions), values, SCHEMA), "kn-shards")

    return [one(r) for r in range(rounds)]


def train_words(trusted: DataFrame, text_col: str = "text", rounds: int = 4, shard_words: int = 1 << 17) -> WordModel | None:
    """The model of all rows of ``trusted``, or None if they have no text.

    Shards hold about ``shard_words`` trigrams at most.
    """
    spark = trusted.sparkSession
    texts = trusted.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.trim("text") != "")
    chars = texts.agg(F.sum(F.length("text"))).first()[0]
    if not chars:
        return None
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shard_bits = min(24, max(15, int(chars / 6 / shard_words)).bit_length())
    words = count_words(texts, shard_bits, partitions)
    return WordModel(words, estimate(texts, words, shard_bits, partitions, rounds), shard_bits, partitions)


def _single_words(rows: DataFrame, words: Words) -> DataFrame:
    """(uid, id, lang, trusted, words, novel, s, e) of rows (uid, id, lang, trusted, text): what the single words give."""
    value = np.where(words.occurs > 0, np.log(words.q) - words.unknown, 0) + np.log(words.left)
    occurs = words.occurs.copy()
    occurs[EDGE] = 2**32 - 1
    shared = rows.sparkSession.sparkContext.broadcast((value.astype(np.float32), occurs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, occurs = shared.value
        slots = Slots()
        for batch in batches:
            own = batch.column(3).to_numpy(zero_copy_only=False)
            for first, w, at in slots.portions(batch.column(4)):
                docs = int(at[-1]) + 1
                part = batch.slice(first, docs)
                words = np.bincount(at) - 2
                # one of the two edges is never a word's context alone
                s = np.bincount(at, value[w]) - value[EDGE]
                e = s.copy()
                mine = np.flatnonzero(own[first : first + docs])
                if len(mine):
                    inside = np.isin(at, mine)
                    pair, n = _distinct(at[inside] << BITS | w[inside])
                    word, doc = pair & _LOW, pair >> BITS
                    alone = np.where(occurs[word] > n, 0, value[word] * n)
                    e -= np.bincount(doc, alone, docs)
                same = at[2:] == at[:-2]
                mixed = hash_of((w[:-2] << 2 * BITS | w[1:-1] << BITS | w[2:])[same]) >> np.uint64(16)
                novel = np.sort(at[2:][same].astype(np.uint64) << np.uint64(48) | mixed)
                novel = np.bincount((novel[starts(novel)] >> np.uint64(48)).astype(np.int64), minlength=docs)
                blank = words == 1
                columns = [pa.array(x, t, mask=blank) for x, t in ((words, pa.int32()), (novel, pa.int32()), (s, pa.float64()), (e, pa.float64()))]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(4)], *columns], names=["uid", "id", "lang", "trusted", "words", "novel", "s", "e"])

    return map_arrow(rows.select("uid", "id", "lang", "trusted", "text"), run, f"uid bigint, id {rows.schema['id'].dataType.simpleString()}, lang string, trusted boolean, words int, novel int, s double, e double")


def _document_rows(rows: DataFrame, shard_bits: int, r: int, rounds: int) -> DataFrame:
    """Packed entries (x y z; number of the document) of a portion's documents in the shards of a round, behind their uids.

    Kind 2: least uid, size of the packed (uid, trusted) of the portion, these, the entries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for batch in batches:
            uids = batch.column(0).to_numpy()
            trusted = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
            for first, w, at in slots.portions(batch.column(2)):
                # behind the last word there is none
                third = np.append(w[2:], NONE)
                third[w[1:] == END] = NONE
                inside = w[:-1] != END
                pair = (w[:-1] << BITS | w[1:])[inside]
                shard = shard_of(pair, shard_bits)
                own = np.flatnonzero(_round(shard, shard_bits, rounds) == r)
                keys, doc, shard = pair[own] << BITS | third[inside][own], at[:-1][inside][own], shard[own]
                order = np.argsort(keys)
                # a document's number in the order of uids, so that the uids pack well
                mine = uids[first : first + int(at[-1]) + 1]
                by_uid = np.argsort(mine)
                place = np.empty(len(mine), np.uint16)
                place[by_uid] = np.arange(len(mine))
                head = pack(mine[by_uid] - mine.min(), trusted[first : first + len(mine)][by_uid])
                head = int(mine.min()).to_bytes(8, "little", signed=True) + len(head).to_bytes(8, "little") + head
                yield from to_batches([(s, 2, head + data) for s, _, data in deal(2, shard[order], keys[order], place[doc[order]])])

    return map_arrow(rows.select("uid", "trusted", "text"), run, SCHEMA)


def _found(keys: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the keys are in the sorted model, and whether they are."""
    if not len(model):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(model, keys), len(model) - 1)
    return at, model[at] == keys


def _packed_sums(held: dict[int, list]) -> list[tuple]:
    """Rows (portion, 0, packed (uid; s, e)) of the sums held of each portion, without those that are zero."""
    rows = []
    for least, (uid, s_sum, e_sum) in held.items():
        some = np.flatnonzero((s_sum != 0) | (e_sum != 0))
        if len(some):
            # in the order of unsigned numbers, as keys are packed
            keys = (uid + np.int64(least))[some].view(np.uint64)
            order = np.argsort(keys)
            portion = int(hash_of(np.array([least]))[0] >> np.uint64(33))
            rows.append((portion, 0, pack(keys[order], s_sum[some][order].astype(np.float32), e_sum[some][order].astype(np.float32))))
    return rows


def _look_up(batches: Iterator[pa.RecordBatch], most: int = _HELD) -> Iterator[pa.RecordBatch]:
    """Packed (uid; s, e) sums of a portion's entries in one shard after another, dealt by portion: the model's rows come before the documents'.

    Every portion meets every shard, so a task holds sums of ``most`` documents and one portion at most, then sends
    them on; ``_add_up`` adds what comes in several parts.
    """
    shard, model = None, {}
    held: dict[int, list] = {}
    n_held = 0
    for batch in batches:
        for s, kind, data in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if s != shard:
                shard, model = s, {}
            if kind < 2:
                key, value, n = unpack(data, np.float16, np.uint32)
                model[kind] = key, value.astype(np.float32), n
                continue
            if not model:
                continue
            least, size = int.from_bytes(data[:8], "little", signed=True), int.from_bytes(data[8:16], "little")
            uid, trusted = unpack(data[16 : 16 + size], np.uint8)
            keys, doc = unpack(data[16 + size :], np.uint16)
            doc = doc.astype(np.int64)
            if least not in held:
                if n_held >= most:
                    yield from to_batches(_packed_sums(held))
                    held, n_held = {}, 0
                held[least] = [uid, np.zeros(len(uid)), np.zeros(len(uid))]
                n_held += len(uid)
            sums = held[least]
            for of, entry in ((0, keys >> BITS), (1, keys)):
                known, value, occurs = model[of]
                at, hit = _found(entry, known)
                hit = np.flatnonzero(hit)
                at, d = at[hit], doc[hit]
                gain = value[at]
                sums[1] += np.bincount(d, gain, len(uid))
                sums[2] += np.bincount(d, gain, len(uid))
                # what a trusted document alone has brought into the model doesn't count for it
                mine = trusted[d] != 0
                group, n = _distinct(at[mine] * len(uid) + d[mine])
                at, d = group // len(uid), group % len(uid)
                alone = occurs[at] <= n
                sums[2] -= np.bincount(d[alone], (value[at] * n)[alone], len(uid))
    yield from to_batches(_packed_sums(held))


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, s2, e2) of a portion's packed sums."""
    for _, rows in by_shard(batches):
        uid, s, e = merged([unpack(d, np.float32, np.float32) for _, d in rows])
        at = starts(uid)
        yield pa.RecordBatch.from_arrays([pa.array(uid[at]), *[pa.array(np.add.reduceat(x.astype(np.float64), at)) for x in (s, e)]], names=["uid", "s2", "e2"])


def word_scores(rows: DataFrame, model: WordModel) -> DataFrame:
    """(uid, id, lang, trusted, words, novel, mean, mean_elsewhere) of rows (uid, id, lang, trusted, text), in a shared table.

    ``rows`` is read once for each round, so uids must be the same in every scan. ``mean`` is the mean
    negative log probability of a word with the text's end, in nats, null for null and blank texts;
    ``mean_elsewhere`` for a trusted text is that by the n-grams which other trusted texts have too, for others the same.
    """
    single = shared_table(_single_words(rows, model.words), "kn-single")
    rounds, sums = len(model.shards), []
    texts = rows.where(F.trim("text") != "")
    for r, shards in enumerate(model.shards):
        met = exchange(shards.union(_document_rows(texts, model.shard_bits, r, rounds)), model.partitions)
        found = exchange(map_arrow(met, _look_up, SCHEMA), model.partitions)
        sums.append(shared_table(map_arrow(found, _add_up, "uid bigint, s2 double, e2 double"), "kn-sums"))
    longer = reduce(DataFrame.union, sums).groupBy("uid").agg(F.sum("s2").alias("s2"), F.sum("e2").alias("e2"))
    mean = lambda c: -(F.col(c) + F.coalesce(F.col(c + "2"), F.lit(0.0))) / F.col("words") - model.words.unknown
    out = single.join(longer, "uid", "left").select("uid", "id", "lang", "trusted", "words", "novel", mean("s").alias("mean"), mean("e").alias("mean_elsewhere"))
    out = shared_table(out, "kn-scores")
    discard(single, *sums)
    return out
