"""Quality rules with a verdict for each host.

Rule measures are plain expressions over one text. Rule failures are summed by
host, each host's failure rate is shrunk towards the corpus rate with a beta
prior fitted to all hosts by the method of moments, and the verdict of a host
is joined back to its documents. The join key carries a salt, and the small
verdict table is repeated for each salt, so a host with a third of all rows is
spread over ``salts`` join keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.text import SPACE_CLASS, bind, squeeze, words
from quernstone.plans import shared_table


def repeated_words(ws: Column, width: int = 8) -> Column:
    """Number of words that lie in a ``width``-word window which occurs at least twice in the text.

    Words and windows are compared by XXH64. Texts without a repeated window,
    the usual case, stop after one distinct count; else the windows are sorted
    with their positions, and covered words are counted from the gaps between
    repeated windows.
    """
    w = F.lit(width)

    def count(hashes: Column) -> Column:
        ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
            n = F.size(s)
            twice = F.filter(F.sequence(F.lit(0), n - 1), lambda i: same(i, i - 1) | same(i, i + 1))
            places = F.array_sort(F.transform(twice, lambda i: F.get(s, i)["i"]))
            return bind(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(w, F.coalesce(F.get(p, k + 1) - x, w))), F.lit(0), lambda a, x: a + x))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(bind(ranked, covered))

    windows = lambda a: F.transform(F.sequence(F.lit(1), F.size(a) - width + 1), lambda i: F.xxhash64(F.slice(a, i, width)))
    return F.when(F.size(ws) < width, F.lit(0)).otherwise(bind(F.transform(ws, lambda x: F.xxhash64(x)), lambda a: bind(windows(a), count)))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return bind(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))


def measures(text: Column) -> dict[str, Column]:
    """The measures of one text; ``words`` is an array."""
    return {"ws": words(text), "word_chars": F.length(squeeze(text)).cast("long"), "n_symbols": F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long"), "n_dup_lines": duplicate_lines(text).cast("long")}


def host_verdicts(docs: DataFrame, host: str, failed: str, max_rate: float = 0.5) -> DataFrame:
    """(host, n_docs, n_failed, rate, bad) for each host, null hosts as one group.

    ``rate`` is the posterior mean (failed + a) / (docs + a + b). With m the
    corpus failure rate and v the variance of host rates weighted by documents,
    a + b = m (1 - m) / v - 1, held between 1 and 10,000, and a = m (a + b).
    A host is bad if its rate is above ``max_rate``.
    """
    by = docs.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    n, f, sq = by.agg(F.sum("n_docs"), F.sum("n_failed"), F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs"))).first()
    mean = f / n if n else 0.0
    spread = sq / n - mean * mean if n else 0.0
    strength = min(10000.0, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 1e-12 else 10000.0
    rate = (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    return by.withColumn("rate", rate).withColumn("bad", F.col("rate") > max_rate)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5, salts: int = 64) -> DataFrame:
    """One row per input row with its measures, base verdict and final verdict.

    Null texts have no words and fail the base rule of 20 words. A null host
    is a host of its own. Repeated rows count as often as they occur. An empty
    table gives an empty result; further columns are ignored.
    """
    src = docs.select(F.col(id_col).alias("_id"), F.col(host_col).cast("string").alias("_host"), F.col(text_col).alias("_text"))
    m = measures(F.col("_text"))
    ws = src.select("_id", "_host", *[c.alias(k) for k, c in m.items()])
    rows = ws.select("_id", "_host", F.size("ws").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeated_words(F.col("ws")).cast("long").alias("n_repeat_words"))
    bad = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = shared_table(rows.withColumn("base_failed", bad), "rule-measures")
    verdict = host_verdicts(rows, "_host", "base_failed", max_rate)
    key = lambda c: F.concat(F.when(c.isNull(), "n").otherwise("s"), F.coalesce(c, F.lit("")))
    verdict = verdict.select(key(F.col("_host")).alias("_key"), "bad", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    salt = F.pmod(F.xxhash64("_id", "n_words", "word_chars"), F.lit(salts)).cast("int")
    return rows.withColumn("_key", key(F.col("_host"))).withColumn("_salt", salt).join(verdict, ["_key", "_salt"], "left").select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce(F.col("bad"), F.lit(False))).alias("kept"),
    )


__all__ = ["SPACE_CLASS", "duplicate_lines", "host_verdicts", "measures", "quality_rules", "repeated_words"]
