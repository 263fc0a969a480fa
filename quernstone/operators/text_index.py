"""A stored inverted index: texts are read once, searches read the rows of their terms.

An index is a folder of three Parquet tables. ``postings`` has a row for each field, term and
block of up to 1,024 documents of like length, with the documents' ids, frequencies and lengths
as arrays, in folders by a hash of the term and sorted by term within a file; of a term that few
documents of a chunk of blocks have, one row for the whole chunk. ``terms`` is the dictionary:
each term with its stem and the number of its documents, sorted by stem, so that prefixes and
stems are found without the postings. ``segments`` says which segments count: an append or a
removal writes a segment of its own and enters it there last, so that readers never see half
of it.

A task turns a chunk of documents into postings before anything is shuffled; what is shuffled
is one compressed piece for each chunk and bucket of terms.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.stemming import stem
from quernstone.operators.retrieval import K1, LEAST_IDF, B
from quernstone.plans import discard, map_arrow, shared_table, writing

#: Documents of a block, and of a chunk, which a task holds before it gives its postings out (or so many words).
BLOCK, HELD, HELD_WORDS = 1024, 8192, 2_000_000
#: Documents of a chunk from which on a term has a row for each block; and the number that stands for all blocks.
SPLIT, WHOLE = 128, 255
#: Compressed bytes of postings that one task sorts and writes, about; a bucket of more goes to several tasks.
TASK_BYTES = 16_000_000
#: Terms that one search names in its filters; beyond, they are broadcast to the postings, and beyond
#: ``BROADCAST_TERMS`` postings are shuffled to be joined with the dictionary.
MAX_TERMS, BROADCAST_TERMS = 1000, 250_000
#: Blocks that one search names in its filters; beyond, they are joined.
MAX_BLOCKS = 10_000
_WORDS = r"([\p{L}\p{N}]+)"
#: Texts of Latin-1's characters alone have no match.
_BEYOND_LATIN = r"[^\x00-\xFF]"
#: Letters, in lower case, and digits by their bytes, and by their second bytes behind C2 and C3; 0 for other bytes.
_LOWER = np.array([ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 0 for b in range(256)], np.uint8)
_LOWER_C2, _LOWER_C3 = (
    np.array([chr(b + more).lower().encode()[1] if 128 <= b < 192 and unicodedata.category(chr(b + more))[0] in "LN" else 0 for b in range(256)], np.uint8) for more in (0, 64)
)
_DICTIONARY = "field tinyint, term string, stem string, n long"
_POSTINGS = "field tinyint, term string, block long, n long, most int, shortest long, rows array<{kind}>, tfs array<int>, sizes array<int>"
#: Columns of an index's tables; {kind} is the type of ids.
_TABLES = {
    "postings": _POSTINGS + ", segment int, bucket int",
    "terms": _DICTIONARY + ", segment int",
    "removed": "row {kind}, segment int",
    "segments": "n long, words long, replaces int, kind string, segment int",
}

#: CRC-32 of each byte, from which those of longer texts come.
_CRC = np.array([zlib.crc32(bytes([b ^ 0xFF])) ^ 0xFF000000 for b in range(256)], np.uint32)


def _plain_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of words of each text and all words, as ``_WORDS`` finds them in lower case; texts are of Latin-1's characters."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or bounds[0] == bounds[-1]:
        return np.zeros(len(texts), np.int64), pa.array([], pa.string())
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    low = _LOWER[raw]
    for lead, table in ((0xC2, _LOWER_C2), (0xC3, _LOWER_C3)):
        at = np.flatnonzero(raw == lead)
        low[at + 1] = second = table[raw[at + 1]]
        low[at] = np.where(second, lead, 0)
    bounds = bounds - bounds[0]
    inside = low != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = bounds[:-1][bounds[:-1] < bounds[-1]]
    first[starts] = inside[starts]  # a word ends with its text
    begin = np.flatnonzero(first)
    size = np.add.reduceat(inside, begin, dtype=np.int32) if len(begin) else np.empty(0, np.int32)
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(low[inside]))
    return np.diff(np.searchsorted(begin, bounds)), words


def _read_words(found: pa.Array, plain: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of words of each text, text of each word, words): of a text either its words or, in Latin-1, itself is given."""
    is_plain = np.flatnonzero(plain.is_valid().to_numpy(zero_copy_only=False))
    counts = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    n_plain, words = _plain_words(plain.cast(pa.string()).take(pa.array(is_plain)))
    owner = np.concatenate((np.repeat(np.arange(len(counts)), counts), np.repeat(is_plain, n_plain)))
    counts[is_plain] = n_plain
    return counts, owner, pa.concat_arrays([found.flatten().cast(pa.string()), words])


def _invert(total: np.ndarray, owners: list[np.ndarray], words: list[pa.Array], ids: pa.Array, chunk: int, size_of_block: int, split: int) -> Iterator[pa.RecordBatch]:
    """Postings of a chunk of documents, those of like length (``total``) together: ``words`` and their documents by field."""
    n = len(ids)
    order = np.argsort(total, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    by_rank, size = ids.take(pa.array(order)), total[order].astype(np.int32)
    for field, (owner, flat) in enumerate(zip(owners, words, strict=True)):
        if not len(flat):
            continue
        coded = flat.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        key, tf = np.unique(code * n + rank[owner], return_counts=True)
        code, place, tf = key // n, key % n, tf.astype(np.int32)
        part = np.where(np.bincount(code)[code] >= split, place // size_of_block, WHOLE)
        group = code * (WHOLE + 1) + part
        begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        offsets = pa.array(np.append(begin, len(key)), pa.int32())
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(begin), field), pa.int8()), coded.dictionary.take(pa.array(code[begin])), pa.array((chunk << 8) + part[begin]), pa.array(np.diff(np.append(begin, len(key))), pa.int64()), pa.array(np.maximum.reduceat(tf, begin), pa.int32()), pa.array(size[place[begin]].astype(np.int64)),
            pa.ListArray.from_arrays(offsets, by_rank.take(pa.array(place))), pa.ListArray.from_arrays(offsets, pa.array(tf)), pa.ListArray.from_arrays(offsets, pa.array(size[place])),
        ], names=["field", "term", "block", "n", "most", "shortest", "rows", "tfs", "sizes"])


def _crc32(terms: pa.Array) -> np.ndarray:
    """CRC-32 of the terms' bytes, as of ``zlib``; all terms go on by a byte at a time, long ones by themselves."""
    bounds = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1].astype(np.int64)
    data = np.frombuffer(terms.buffers()[2] or b"", np.uint8)
    begin, size = bounds[:-1], np.diff(bounds)
    out = np.full(len(terms), 0xFFFFFFFF, np.uint32)
    active = np.flatnonzero(size <= 64)
    for step in range(64):
        active = active[size[active] > step]
        if not len(active):
            break
        out[active] = _CRC[(out[active] ^ data[begin[active] + step]) & 0xFF] ^ (out[active] >> 8)
    out ^= 0xFFFFFFFF
    for i in np.flatnonzero(size > 64):
        out[i] = zlib.crc32(data[begin[i] : bounds[i + 1]].tobytes())
    return out


def _pieces(batch: pa.RecordBatch, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, compressed rows) of postings; a term's bucket is the CRC-32 of its bytes modulo their number."""
    bucket = (_crc32(batch.column(1)) % buckets).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    batch = batch.take(pa.array(order))
    for b in range(buckets):
        if bounds[b] < bounds[b + 1]:
            own = batch.slice(bounds[b], bounds[b + 1] - bounds[b])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(own)
            yield b, sink.getvalue().to_pybytes()


def _packed(df: DataFrame, row_id: str, fields: list[str], segment: int, buckets: int, size_of_block: int, most_held: int, split: int) -> DataFrame:
    """(bucket, chunk, n, words, data): the chunks' postings in pieces; a piece of bucket -1 counts documents and words."""
    columns = []
    for k, f in enumerate(fields):
        text = F.coalesce(F.col(f).cast("string"), F.lit(""))
        latin = F.is_valid_utf8(text) & ((F.octet_length(text) == F.char_length(text)) | ~text.rlike(_BEYOND_LATIN))
        columns += [F.when(~latin, F.regexp_extract_all(F.lower(text), F.lit(_WORDS), 1)).alias(f"w{k}"), F.when(latin, text).alias(f"t{k}")]

    def run(batches):
        from pyspark import TaskContext

        held, docs, count, chunk = [], 0, 0, (segment << 40) + (TaskContext.get().partitionId() << 16)

        def out():
            nonlocal held, docs, count, chunk
            ids = pa.concat_arrays([x for x, _ in held])
            begin = np.cumsum([0, *[len(x) for x, _ in held]])
            total = np.sum([np.concatenate([own[k][0] for _, own in held]) for k in range(len(fields))], axis=0)
            owners = [np.concatenate([own[k][1] + at for (_, own), at in zip(held, begin[:-1], strict=True)]) for k in range(len(fields))]
            flat = [pa.concat_arrays([own[k][2] for _, own in held]) for k in range(len(fields))]
            held = []
            yield piece(-1, len(ids), int(total.sum()), b"")
            for made in _invert(total, owners, flat, ids, chunk, size_of_block, split):
                for b, data in _pieces(made, buckets):
                    yield piece(b, 0, 0, data)
            chunk, docs, count = chunk + 1, 0, 0

        def piece(bucket, n, n_words, data):
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([chunk], pa.int64()), pa.array([n], pa.int64()), pa.array([n_words], pa.int64()), pa.array([data], pa.binary())], names=["bucket", "chunk", "n", "words", "data"])

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                read = [_read_words(batch.column(2 * k + 1), batch.column(2 * k + 2)) for k in range(len(fields))]
                held.append((batch.column(0), read))
                docs += batch.num_rows
                count += sum(len(words) for _, _, words in read)
                if docs + 256 > most_held or count >= HELD_WORDS:
                    yield from out()
        if held:
            yield from out()

    return map_arrow(df.select(F.col(row_id).alias("id"), *columns), run, "bucket int, chunk long, n long, words long, data binary")


def _unpacked(packed: DataFrame, kind: str) -> DataFrame:
    """The rows of the pieces, with their bucket, where the pieces are."""

    def run(batches):
        for batch in batches:
            for bucket, data in zip(batch.column(0), batch.column(1), strict=True):
                for rows in pa.ipc.open_stream(data.as_py()):
                    for at in range(0, rows.num_rows, 20_000):
                        part = rows.slice(at, 20_000)
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, bucket.as_py()), pa.int32())], names=[*part.schema.names, "bucket"])

    return map_arrow(packed.where("bucket >= 0").select("bucket", "data"), run, _POSTINGS.format(kind=kind) + ", bucket int")


def _with_stems(terms: DataFrame) -> DataFrame:
    """The dictionary's distinct terms with their stems; no text gets here."""

    def run(batches):
        for b in batches:
            words = b.column(1)
            yield pa.RecordBatch.from_arrays([b.column(0), words, pa.array([stem(w) for w in words.to_pylist()], pa.string()), b.column(2)], names=["field", "term", "stem", "n"])

    return map_arrow(terms.select("field", "term", "n"), run, _DICTIONARY)


def _weight(tf: Column, size: Column, idf: float, mean: float) -> Column:
    """A term's part of BM25; it grows with the frequency and falls with the length."""
    return F.lit(max(idf, LEAST_IDF) * (K1 + 1)) * tf / (tf + K1 * (1 - B + B * size / mean))


class TextIndex:
    """Search of the texts in ``fields`` by BM25.

    Rows are known by their ids: rows of one id are one document. Null texts count as empty, and
    documents without a word count among all. Words are runs of letters and digits in lower case.
    """

    def __init__(self, spark: SparkSession, path: str, row_id: str, fields: list[str], buckets: int = 32, block: int = BLOCK, held: int = HELD, split: int = SPLIT) -> None:
        self.spark, self.path, self.row_id, self.fields = spark, path.rstrip("/"), row_id, list(fields)
        if held // block >= WHOLE:
            raise ValueError(f"a chunk has fewer than {WHOLE} blocks")
        self.buckets, self.block, self.held, self.split = buckets, block, held, split
        #: (blocks with a term, blocks that could hold one of the best) of the last search that could skip.
        self.skipped: tuple[int, int] | None = None
        self._live: list = []
        self._kind = "long"

    @classmethod
    def build(cls, df: DataFrame, row_id: str, fields: list[str], path: str, **sizes) -> TextIndex:
        """A new index of ``df`` in the folder ``path``, which all executors must reach."""
        index = cls(df.sparkSession, path, row_id, fields, **sizes)
        index._kind = df.schema[row_id].dataType.simpleString()
        index._write(df, 0)
        return index

    def append(self, df: DataFrame) -> None:
        """Add documents whose ids the index doesn't have."""
        self._write(df, self._next())

    def remove(self, df: DataFrame) -> None:
        """Take documents out; ``df`` has them as they were added, so that counts stay exact."""
        k = self._next()
        df.select(F.col(self.row_id).alias("row")).write.parquet(f"{self.path}/removed/segment={k}")
        self._write(df, k, sign=-1)

    def replace(self, old: DataFrame, new: DataFrame) -> None:
        self.remove(old)
        self.append(new)

    def compact(self) -> None:
        """Write what is live as one segment, which takes the place of all before it."""
        k, (n, words) = self._next(), self._refresh()
        live = self._entries(self._table("postings")).groupBy("field", "term", "block", "bucket").agg(
            F.count(F.lit(1)).alias("n"), F.max("tf").alias("most"), F.min("size").cast("long").alias("shortest"), F.sort_array(F.collect_list(F.struct("size", "row", "tf"))).alias("e"),
        ).select("field", "term", "block", "n", "most", "shortest", F.col("e.row").alias("rows"), F.col("e.tf").alias("tfs"), F.col("e.size").alias("sizes"), "bucket")
        self._store(live.repartition("bucket", self._spread(F.shiftright("block", 8), n)), k)
        self._enter(k, n, words, replaces=k)

    # --- writing ---

    def _next(self) -> int:
        self._refresh()
        return max(r["segment"] for r in self._live) + 1

    @staticmethod
    def _spread(chunk: Column, n: int) -> Column:
        """A term of most documents goes to as many tasks as there are millions of documents."""
        return F.pmod(F.xxhash64(chunk), F.lit(1 + n // (1 << 20)))

    def _write(self, df: DataFrame, k: int, sign: int = 1) -> None:
        packed = shared_table(_packed(df, self.row_id, self.fields, k, self.buckets, self.block, self.held, self.split), "postings")
        n, words, size = packed.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in (F.col("n"), F.col("words"), F.octet_length("data"))]).first()
        if sign > 0:
            self._store(_unpacked(self._by_bucket(packed, size), self._kind), k)
        else:
            self._store_terms(_unpacked(packed, self._kind), k, sign)
        self._enter(k, sign * n, sign * words)
        discard(packed)

    def _by_bucket(self, packed: DataFrame, size: int) -> DataFrame:
        """The pieces of ``size`` bytes in all, each task with as many buckets, or parts of one, as any other."""
        parts = max(1, -(-size // (TASK_BYTES * self.buckets)))
        usual = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        tasks = min(self.buckets * parts, max(usual, -(-size // TASK_BYTES)))
        share = F.col("bucket") * parts + F.pmod(F.xxhash64("chunk"), F.lit(parts))
        return packed.where("bucket >= 0").repartitionById(tasks, (share % tasks).cast("int"))

    def _store(self, rows: DataFrame, k: int) -> None:
        with writing(self.spark):  # a bucket's pieces go to Python a few at a time
            rows.sortWithinPartitions("bucket", "term", "field", "block").write.partitionBy("bucket").option("parquet.enable.dictionary#rows.list.element", "false").parquet(f"{self.path}/postings/segment={k}")
        self._store_terms(self._read("postings").where(F.col("segment") == k), k, 1)

    def _store_terms(self, postings: DataFrame, k: int, sign: int) -> None:
        counts = postings.groupBy("field", "term").agg((F.sum("n") * sign).alias("n"))
        with writing(self.spark):
            _with_stems(counts.repartitionByRange("term")).sortWithinPartitions("stem", "term").write.parquet(f"{self.path}/terms/segment={k}")

    def _enter(self, k: int, n: int, words: int, replaces: int = 0) -> None:
        row = self.spark.createDataFrame([(n, words, replaces, self._kind)], "n long, words long, replaces int, kind string").coalesce(1)
        row.write.parquet(f"{self.path}/segments/segment={k}")

    # --- reading ---

    def _refresh(self) -> tuple[int, int]:
        """See which segments count now; the number of their documents and of the words in them."""
        rows = self._read("segments").collect()
        base = max(r["replaces"] for r in rows)
        self._live, self._kind = [r for r in rows if r["segment"] >= base], rows[0]["kind"]
        return sum(r["n"] for r in self._live), sum(r["words"] for r in self._live)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(_TABLES[name].format(kind=self._kind)).parquet(f"{self.path}/{name}")

    def _table(self, name: str) -> DataFrame:
        return self._read(name).where(F.col("segment").isin([r["segment"] for r in self._live]))

    def _removed(self) -> DataFrame | None:
        """(row, segment) of removals that count, if there are any."""
        return self._table("removed") if any(r["n"] < 0 for r in self._live) else None

    def _entries(self, postings: DataFrame) -> DataFrame:
        """A row for each live document of the postings: row, tf, size and the postings' other columns."""
        kept = [c for c in postings.columns if c not in ("rows", "tfs", "sizes")]
        out = postings.select(*kept, F.explode(F.arrays_zip("rows", "tfs", "sizes")).alias("e")).select(*kept, F.col("e.rows").alias("row"), F.col("e.tfs").alias("tf"), F.col("e.sizes").alias("size"))
        removed = self._removed()
        if removed is not None:
            gone = removed.groupBy("row").agg(F.max("segment").alias("until"))
            out = out.join(gone, "row", "left").where(F.col("until").isNull() | (F.col("segment") > F.col("until"))).drop("until")
        return out

    def dictionary(self, where: Column | bool = True) -> DataFrame:
        """(field, term, stem, n): live terms with the number of documents that have them in the field."""
        self._refresh()
        found = self._table("terms").where(where if isinstance(where, Column) else F.lit(where))
        if len(self._live) == 1:  # whose terms are distinct
            return found.select("field", "term", "stem", "n")
        return found.groupBy("field", "term", "stem").agg(F.sum("n").alias("n")).where("n > 0")

    def expand(self, terms: list[str], prefix: bool = True, stems: bool = False) -> DataFrame:
        """(i, field, term, n, bucket): the dictionary's terms that the i-th wanted term stands for."""
        by = F.col("stem") if stems else F.col("term")
        hits = [by.startswith(t) if prefix else by == t for t in (stem(t) if stems else t for t in terms)]
        which = F.array_compact(F.array(*[F.when(h, F.lit(i)) for i, h in enumerate(hits)]))
        found = self.dictionary(reduce(lambda a, b: a | b, hits))
        return found.select(F.explode(which).alias("i"), "field", "term", "n", (F.crc32("term") % self.buckets).cast("int").alias("bucket"))

    def search(self, terms: list[str], weights: dict[str, float] | None = None, prefix: bool = True, stems: bool = False, every: bool = False, among: DataFrame | None = None, k: int | None = None) -> DataFrame:
        """(row id, score): documents with a term (``every``: with all) and their BM25 score.

        A term stands for itself, or for all words with that ``prefix``, or with its stem (``stems``; with both,
        all words whose stem begins with its stem). ``weights`` weigh the fields' frequencies.
        ``among`` holds ids: others are left out, which changes no score. With ``k``, the best k by score and
        then id come back; where every term is one word of the dictionary, blocks that can't hold
        any of them are skipped by their largest frequency and least length.
        """
        self.skipped = None
        n, words = self._refresh()
        postings = self._table("postings")
        if not terms or not n:
            return self.spark.createDataFrame([], f"`{self.row_id}` {self._kind}, score double")
        mean = words / n or 1.0
        found = self.expand(terms, prefix, stems)
        few = found.limit(MAX_TERMS + 1).collect()
        if len(few) <= MAX_TERMS:
            postings = postings.where(F.col("bucket").isin(sorted({r["bucket"] for r in few})) & F.col("term").isin(sorted({r["term"] for r in few})))
            found = F.broadcast(self.spark.createDataFrame([tuple(r) for r in few], found.schema))
        else:
            if prefix and not stems:  # rows of other words aren't even read
                postings = postings.where(reduce(lambda a, b: a | b, [F.col("term").startswith(t) for t in terms]))
            found = F.broadcast(found) if found.count() <= BROADCAST_TERMS else found
        by_field = F.element_at(F.array(*[F.lit(float((weights or {}).get(f, 1.0))) for f in self.fields]), F.col("field") + 1)
        postings = postings.join(found.select("i", "field", "term"), ["field", "term"]).withColumn("weight", by_field)
        single = len(few) <= MAX_TERMS and len({r["i"] for r in few}) == len(few)
        if single:
            counts = [sum(r["n"] for r in few if r["i"] == i) for i in range(len(terms))]
            if k is not None and among is None and not every and self._removed() is None:
                postings = self._promising(postings, terms, counts, n, mean, k)
            hits = self._pivot(postings, len(terms))
        else:
            hits = shared_table(self._pivot(postings, len(terms)), "hits")
            counts = list(hits.agg(*[F.count_if(F.col(f"tf{i}") > 0) for i in range(len(terms))]).first())
        if every:
            for i in range(len(terms)):
                hits = hits.where(F.col(f"tf{i}") > 0)
        out = hits.select(F.col("row").alias(self.row_id), self._score(counts, n, mean).alias("score"))
        if among is not None:
            out = out.join(among.select(self.row_id), self.row_id, "left_semi")
        return out if k is None else out.orderBy(F.desc("score"), self.row_id).limit(k)

    def _pivot(self, postings: DataFrame, n_terms: int) -> DataFrame:
        entries = self._entries(postings.select("segment", "i", "weight", "rows", "tfs", "sizes"))
        return entries.groupBy("row").agg(F.max("size").alias("size"), *[F.sum(F.when(F.col("i") == i, F.col("tf") * F.col("weight")).otherwise(0.0)).alias(f"tf{i}") for i in range(n_terms)])

    @staticmethod
    def _score(counts: list[int], n: int, mean: float) -> Column:
        out = F.lit(0.0)
        for i, df in enumerate(counts):
            out = out + _weight(F.col(f"tf{i}"), F.col("size"), math.log((n - df + 0.5) / (df + 0.5)) if 0 <= df <= n else 0.0, mean)
        return out

    def _promising(self, postings: DataFrame, terms: list[str], counts: list[int], n: int, mean: float, k: int) -> DataFrame:
        """The postings of blocks that could hold one of the best ``k``; rows of whole chunks stay, which are short.

        The columns with a block's largest frequencies and least length bound the score of its documents. The
        blocks with the highest bounds are scored first, and the score of their k-th document is one that the
        rest must reach. A document of another block keeps what rows of whole chunks give it, which is less.
        """
        largest = [F.sum(F.when(F.col("i") == i, F.col("most") * F.col("weight")).otherwise(0.0)).alias(f"tf{i}") for i in range(len(terms))]
        whole = F.col("block") % (WHOLE + 1) == WHOLE
        chunk = F.shiftright("block", 8).alias("chunk")
        short = postings.where(whole).groupBy(chunk).agg(F.min("shortest").alias("chunk_size"), *largest)
        short = short.select("chunk", "chunk_size", *[F.col(f"tf{i}").alias(f"chunk_tf{i}") for i in range(len(terms))])
        long = postings.where(~whole).groupBy("block", chunk).agg(F.min("shortest").alias("block_size"), *[x.alias(f"block_tf{i}") for i, x in enumerate(largest)])
        bounds = long.join(short, "chunk", "left").select("block", F.least("block_size", "chunk_size").alias("size"), *[(F.col(f"block_tf{i}") + F.coalesce(f"chunk_tf{i}", F.lit(0.0))).alias(f"tf{i}") for i in range(len(terms))])
        bounds = bounds.select("block", self._score(counts, n, mean).alias("bound"))
        first = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(2 + 2 * k // self.block).collect()]
        best = self._pivot(postings.where(whole | F.col("block").isin(first)), len(terms)).select(self._score(counts, n, mean).alias("score")).orderBy(F.desc("score")).limit(k).collect()
        if len(best) < k:
            return postings
        # bounds and scores add the same parts, which may be rounded otherwise
        kept = bounds.where(F.col("bound") >= best[-1]["score"] * (1 - 1e-9)).select("block")
        few = [r["block"] for r in kept.limit(MAX_BLOCKS + 1).collect()]
        self.skipped = (bounds.count(), len(few) if len(few) <= MAX_BLOCKS else kept.count())
        if len(few) <= MAX_BLOCKS:
            return postings.where(whole | F.col("block").isin(few))
        return postings.where(whole).unionByName(postings.where(~whole).join(kept, "block", "left_semi").select(*postings.columns))
