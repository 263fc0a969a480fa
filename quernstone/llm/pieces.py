"""SentencePiece BPE by a table of last tokens.

A BPE encoding is unique, and so is the encoding of every prefix of a text; a
sequence of tokens is the encoding of its text exactly if every two neighbours
are compatible, that is if BPE leaves the two side by side when given their
joint text. The last token of each prefix is therefore found from left to right:
of the pieces that end here (all suffix matches of an Aho-Corasick automaton),
it is the one that is compatible with the last token of the prefix before it.
The ids are then recovered backwards through the table. This is linear in
the text, for a "word" of any length.

No piece has the space mark after another character, so nothing ever merges
across the front of a space run, and a text splits there into segments that are
encoded on their own. Segments repeat, so each worker keeps a bounded table of
those it has met (it is emptied when full; results don't depend on it).

Runs of two or more space marks are the one place where merges of equal rank
compete; their front part is merged by the queue that the rule describes.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from hashlib import sha256

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.plans import map_arrow

MARK = "▁"
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def read_model(path: str) -> bytes:
    """The model file, read on the driver and sent to executors (it is half a MB)."""
    with open(path, "rb") as f:
        return f.read()


class Pieces:
    """Vocabulary, merge order and the encoder of one BPE model with byte fallback."""

    def __init__(self, model: bytes, most_kept: int = 200_000):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces:
            raise ValueError("only BPE models without normalisation and with a dummy prefix are supported")
        if any(p.type == 4 for p in proto.pieces):
            raise ValueError("models with user-defined pieces are not supported")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.bytes_at = next(i for i, p in enumerate(proto.pieces) if p.type == 6)
        self.piece = [p.piece for p in proto.pieces]
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a space mark inside")
        # rank of a merge: the higher the score the earlier; a piece of one character needs none
        self.rank = {p: (-s if len(p) > 1 else float("-inf")) for p, s in self.score.items()}
        self.parts: dict[str, tuple[str, str]] = {}
        self.fits: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            # a piece that BPE never makes is left out
            if len(p) == 1 or p.strip(MARK) == "" or len(self.merge(p, True)) == 1:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.known: dict[str, str] = {}
        self.spelt: dict[str, str] = {}
        self.most_kept = most_kept

    def merge(self, text: str, note: bool = False) -> list[str]:
        """BPE by the merge queue: best score first, then leftmost."""
        sym: list[str | None] = list(text)
        left, right = list(range(-1, len(sym) - 1)), list(range(1, len(sym) + 1))
        queue: list[tuple[float, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(sym) and (s := self.score.get(sym[i] + sym[j])) is not None:
                heapq.heappush(queue, (-s, i, j, len(sym[i]) + len(sym[j])))

        for i in range(len(sym) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, size = heapq.heappop(queue)
            if sym[i] is None or sym[j] is None or len(sym[i]) + len(sym[j]) != size:
                continue
            if note and size == len(text):
                self.parts[text] = (sym[i], sym[j])
            sym[i], sym[j] = sym[i] + sym[j], None
            right[i] = right[j]
            if right[j] < len(sym):
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [s for s in sym if s is not None]

    def compatible(self, a: str, b: str) -> bool:
        """Whether BPE leaves ``a`` and ``b`` side by side in their joint text.

        Both pieces are taken apart again, the later merge first. At every step
        the two symbols that touch must not form a piece whose merge would have
        come before the step that was just undone.
        """
        rank, parts, score = self.rank, self.parts, self.score
        limit, by_right, fine = float("inf"), True, True
        while True:
            joint = a + b
            if joint in score:
                r = rank[joint]
                # of equal merges the left one comes first: the joint one lies right of an undone left part
                if r < limit or r == limit and by_right:
                    fine = False
                    break
            ra, rb = rank.get(a, float("-inf")), rank.get(b, float("-inf"))
            pa_, pb = parts.get(a), parts.get(b)
            if pa_ is None and pb is None:
                break
            if pb is None or pa_ is not None and ra > rb:
                limit, by_right, a = ra, False, pa_[1]
            else:
                limit, by_right, b = rb, True, pb[0]
        return fine

    def learn(self, a: int, b: int) -> bool:
        """``compatible`` of two ids, kept in a bounded table."""
        if len(self.fits) > 400_000:
            self.fits.clear()
        fine = self.fits[a << 16 | b] = self.compatible(self.piece[a], self.piece[b])
        return fine

    def table_encode(self, text: str) -> list[int]:
        """Ids of a text in which space marks stand alone, through the prefix table.

        A character without a piece never merges: it is spelt in bytes, and what
        stands before and after it is encoded on its own.
        """
        ids, out, start = self.ids, [], 0
        for k, c in enumerate(text):
            if c not in ids:
                out += self.last_tokens(text[start:k])
                out += [self.bytes_at + b for b in c.encode("utf-8", "replace")]
                start = k + 1
        return out + self.last_tokens(text[start:]) if start else self.last_tokens(text)

    def last_tokens(self, text: str) -> list[int]:
        """Ids of characters that all have pieces; ``last[k]`` is the last token of the first k."""
        n = len(text)
        last = [-1] * (n + 1)
        fits = self.fits
        for end, (i, size) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            if end == size:
                last[end] = i
            elif (before := last[end - size]) >= 0:
                fine = fits.get(before << 16 | i)
                if fine is None:
                    fine = self.learn(before, i)
                if fine:
                    last[end] = i
        out, piece = [], self.piece
        while n:
            out.append(last[n])
            n -= len(piece[last[n]])
        out.reverse()
        return out

    def tokens(self, segment: str) -> list[int]:
        word = segment.lstrip(MARK)
        run = len(segment) - len(word)
        if run < 2:
            return self.table_encode(segment)
        mark = self.ids[MARK]
        tail = self.table_encode(MARK + word) if word else [mark]
        front, tail = (run, tail[1:]) if tail[0] == mark else (run - 1, tail)
        return [self.ids[t] for t in self.merge(MARK * front)] + tail

    def plain(self, ids: list[int]) -> str:
        """Text of ids, space marks as spaces; byte pieces are read as UTF-8."""
        out, held = [], bytearray()
        for i in ids:
            if self.bytes_at <= i < self.bytes_at + 256:
                held.append(i - self.bytes_at)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.piece[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def segment(self, text: str) -> str:
        """Ids of a segment joined by commas; one that is partly spelt in bytes leaves its text in ``spelt``."""
        ids = self.tokens(text)
        if min(ids) < self.bytes_at + 256:
            if len(self.spelt) >= self.most_kept:
                self.spelt.clear()
            self.spelt[text] = self.plain(ids)
        return ",".join(map(str, ids))

    def encoded(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by commas, decoded text) of a whole text.

        Pieces alone give their segment back; only segments that are partly spelt in bytes are
        decoded. The decoded text has lost the dummy prefix.
        """
        if not text:
            return 0, "", ""
        known, said, odd = self.known, [], []
        segments = _SEGMENT.findall(MARK + text.replace(" ", MARK))
        for k, s in enumerate(segments):
            found = known.get(s)
            if found is None:
                found = self.segment(s)
                if s in self.spelt:
                    odd.append((k, self.spelt[s]))
                elif len(s) <= 64:
                    if len(known) >= self.most_kept:
                        known.clear()
                    known[s] = found
            said.append(found)
        ids = ",".join(said)
        for k, plain in odd:
            segments[k] = plain
        return ids.count(",") + 1, ids, "".join(segments).replace(MARK, " ")[1:]

    def encode(self, text: str) -> list[int]:
        said = self.encoded(text)[1]
        return [int(x) for x in said.split(",")] if said else []


_LOADED: dict[bytes, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """The encoder of a model, made once in each Python worker."""
    key = sha256(model).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def piece_digests(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 for each input row.

    Null texts count as empty: no ids, empty decoded text. Repeated rows are
    encoded as often as they occur; an empty table gives an empty result; other
    columns are ignored. Texts of any length are encoded whole.
    """
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                counts, ids, plain = [], [], []
                for text in part.column(1).to_pylist():
                    n, said, back = pieces.encoded(text)
                    counts.append(n)
                    ids.append(sha256(said.encode()).hexdigest())
                    plain.append(sha256(back.encode("utf-8", "replace")).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(plain, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    id_type = src.schema["id"].dataType.simpleString()
    return map_arrow(src, run, f"id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def piece_ids(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the encoding itself."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                ids = pa.array([pieces.encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["id", "ids"])

    return map_arrow(src, run, f"id {src.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)
