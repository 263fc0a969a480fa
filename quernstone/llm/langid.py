"""Language identification by compression.

For each language a raw-content zstandard dictionary is made of a bounded sample of
labelled documents, of whole texts in the order of a hash. A text is coded with every dictionary, and the
language that gives the fewest bytes is the answer; where the best two are close,
the answer is marked as rejected. All of a text is read; it is coded as its distinct
lower-cased words in order, in blocks, so that a text can't become its own
dictionary and repetition doesn't drown the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.plans import map_arrow

_WORD = re.compile(r"[^\W\d_]+")
#: In front of every block: makes even a short block worth compressing, so that its size tells languages apart.
_PAD = bytes(64)


def normal_words(text: str) -> bytes:
    """The distinct words of a text in lower case, in the order in which they first occur."""
    return " ".join(dict.fromkeys(_WORD.findall(text.lower()))).encode("utf-8", "replace")


def language_samples(docs: DataFrame, lang_col: str, text_col: str, per_language: int) -> dict[str, list[str]]:
    """Up to about ``per_language`` whole texts for each language, in the order of a hash of the text.

    Texts are chosen by that hash, so equal texts count once however often they occur; the bound on
    the number of texts is what limits the sample that reaches the driver.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    mark = F.xxhash64("text")
    # distinct texts of each language, counted by their hashes
    counts = {r[0]: r[1] for r in rows.select("lang", mark.alias("mark")).distinct().groupBy("lang").agg(F.count(F.lit(1))).collect()}
    if not counts:
        return {}
    share = F.pmod(mark, F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = None
    for lang, n in sorted(counts.items()):
        hit = (F.col("lang") == lang) & (share < per_language / n)
        chosen = hit if chosen is None else chosen | hit
    # one row for each hash before anything is sent on
    kept = rows.where(chosen).groupBy("lang", mark.alias("mark")).agg(F.first("text").alias("text")).orderBy("lang", "mark")
    found: dict[str, list[str]] = {lang: [] for lang in counts}
    for lang, _, text in kept.collect():
        found[lang].append(text)
    return found


class Coders:
    """One zstandard coder for each language."""

    def __init__(self, dictionaries: dict[str, bytes], block: int = 2048):
        self.block = block
        # btopt with matches from 3 bytes on: short shared syllables count
        params = zstandard.ZstdCompressionParameters(window_log=18, hash_log=17, chain_log=17, search_log=3, min_match=3, target_length=0, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.coders = {lang: zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for lang, d in sorted(dictionaries.items())}

    def sizes(self, data: bytes) -> dict[str, int]:
        parts = [_PAD + data[k : k + self.block] for k in range(0, len(data), self.block)]
        return {lang: sum(len(c.compress(p)) for p in parts) for lang, c in self.coders.items()}

    def classify(self, text: str | None, order: dict[str, int]) -> tuple[str, float, bool]:
        """(language, score, rejected). Ties go to the language with more labelled documents."""
        if not self.coders or text is None or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        sizes = self.sizes(normal_words(text))
        best = min(sizes, key=lambda x: (sizes[x], order[x]))
        others = [s for lang, s in sizes.items() if lang != best]
        margin = min(others, default=sizes[best] * 2) - sizes[best]
        return best, 1.0 / (1.0 + sum(2.0 ** -min(60, s - sizes[best]) for s in others)), margin < max(2, sizes[best] // 100)


def dictionaries(samples: dict[str, list[str]], size: int) -> dict[str, bytes]:
    """Dictionaries of the samples' distinct words, in the order of the texts, up to the word that fills ``size`` bytes."""
    out = {}
    for lang, texts in samples.items():
        words = dict.fromkeys(w for t in texts for w in _WORD.findall(t.lower()))
        data = " ".join(words).encode("utf-8", "replace")
        data = data if len(data) <= size else data[: data.rfind(b" ", 0, size)]
        if len(data) >= 8:
            out[lang] = data
    return out


def identify_language(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 64, dictionary_bytes: int = 65536) -> DataFrame:
    """(id, lang_pred, score, rejected) for each row of ``docs``.

    Only the text decides. ``labelled`` gives the languages: null texts and null
    languages there are left out. Null texts, texts without a letter and runs
    without any labelled text give ``und`` with score 0. Repeated rows are
    answered as often as they occur; an empty table gives an empty result.
    """
    samples = language_samples(labelled, lang_col, text_col, per_language)
    dicts = dictionaries(samples, dictionary_bytes)
    order = {lang: k for k, lang in enumerate(sorted(dicts, key=lambda x: (-len(samples[x]), x)))}
    shared = docs.sparkSession.sparkContext.broadcast((dicts, order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, order = shared.value
        coders = Coders(found)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                said = [coders.classify(t, order) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64()), pa.array([s[2] for s in said], pa.bool_())], names=["id", "lang_pred", "score", "rejected"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(src, run, f"id {src.schema['id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text leaves 1 by 3. A null id is not held out, nor learnt from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1
