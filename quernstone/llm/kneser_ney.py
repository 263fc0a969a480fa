"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model (``word_ngrams.py``) counts word trigrams of all trusted text; documents' n-grams
meet the model's in joins that are sharded by n-gram. Every document gets its mean negative
log probability and is rejected if that lies outside a band around what the trusted
documents of its language have. A trusted document is part of the model, so for the upper limit
it is scored without the n-grams that no other trusted text has. Below, the band ends at the
least mean of a trusted document, not at a quantile: copies of trusted text are well
predicted too, and they aren't junk. As a mean doesn't show that a text repeats itself, the
share of repeated trigrams has a limit as well.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.rows import ROW, keep_rows, number_rows
from quernstone.llm.word_ngrams import WordModel, train_words, word_scores

#: Spread of one word's negative log probability in ordinary text, in nats.
SIGMA = 4.0
#: Spread of one trigram's being a repeated one, at most.
REPEAT_SIGMA = 0.5


def mark_trusted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", max_broadcast_ids: int = 500_000) -> DataFrame:
    """``docs`` with ``trusted``: whether a label says good quality and not toxic.

    The ids are broadcast only if they were counted to be few (about 20 MB once hashed); else both sides are shuffled.
    """
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0))
    ids = good.select(F.col(id_col), F.lit(True).alias("trusted")).where(F.col(id_col).isNotNull()).distinct()
    if ids.count() <= max_broadcast_ids:
        ids = F.broadcast(ids)
    return docs.join(ids, id_col, "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def language_limits(scores: DataFrame, value: Column, quantile: float = 0.98, slack: float = 0.5, prior: int = 30) -> dict[str | None, float]:
    """Upper limit of ``value`` for each language, None for languages without a trusted document.

    ``scores`` are of trusted documents. The limit is the ``quantile`` of their ``value`` plus
    ``slack`` times its distance from the median, from a histogram in steps of 0.001. It is
    drawn towards that of all languages as if ``prior`` documents had that, as a quantile of few is uncertain.
    """
    found: dict[str | None, dict[int, int]] = {None: {}}
    steps_of = scores.where("words is not null").select("lang", F.floor(value * 1000).cast("int").alias("step"))
    # at most some ten thousand steps for each language
    for lang, step, n in steps_of.groupBy("lang", "step").agg(F.count(F.lit(1))).collect():
        for key in {lang, None}:
            steps = found.setdefault(key, {})
            steps[step] = steps.get(step, 0) + n

    def at(steps: dict[int, int], share: float) -> float:
        need, run_ = share * sum(steps.values()), 0
        for s in sorted(steps):
            run_ += steps[s]
            if run_ >= need:
                return (s + 0.5) / 1000
        return float("inf")

    def limit(steps: dict[int, int]) -> float:
        top, middle = at(steps, quantile), at(steps, 0.5)
        return top + slack * (top - middle) if steps else float("inf")

    everyone = limit(found[None])
    out: dict[str | None, float] = {None: everyone}
    for lang, steps in found.items():
        if lang is not None:
            n = sum(steps.values())
            out[lang] = (n * limit(steps) + prior * everyone) / (n + prior)
    return out


def _repeated() -> Column:
    """Share of a text's trigrams that have occurred before in it."""
    return 1 - F.col("novel") / F.col("words")


@dataclass
class Classifier:
    """A trained model with the limits of each language.

    ``limits`` are of the mean negative log probability, ``floors`` of its negative (the lower
    side) and ``repeats`` of the share of repeated trigrams. ``model`` is None if there was no trusted text.
    """

    model: WordModel | None
    limits: dict[str | None, float]
    floors: dict[str | None, float]
    repeats: dict[str | None, float]
    certainty: float = 3.0

    def score(self, rows: DataFrame) -> DataFrame:
        """``word_scores`` of rows (uid, id, lang, trusted, text); without a model, means of zero for all with a text."""
        if self.model is not None:
            return word_scores(rows, self.model)
        mean = F.when(F.trim("text") != "", 0.0)
        count = F.when(F.trim("text") != "", 1)
        return rows.select("uid", "id", "lang", "trusted", count.alias("words"), count.alias("novel"), mean.alias("mean"), mean.alias("mean_elsewhere"))

    def judge(self, scores: DataFrame) -> DataFrame:
        """(uid, id, lang, neg_log_prob, limit, kept) of scores.

        A text is rejected if its mean lies above the limit or below the floor, or its share of
        repeated trigrams above that limit, by more than ``certainty`` standard errors, so short
        texts need stronger evidence. Null and blank texts are rejected.
        """

        def of_language(limits: dict[str | None, float]) -> Column:
            out = F.lit(limits[None])
            for lang, x in limits.items():
                if lang is not None:
                    out = F.when(F.col("lang") == lang, x).otherwise(out)
            return out

        limit = of_language(self.limits)
        error = self.certainty * SIGMA / F.sqrt("words")
        within = (F.col("mean") - error <= limit) & (-F.col("mean") - error <= of_language(self.floors))
        fresh = _repeated() - self.certainty * REPEAT_SIGMA / F.sqrt("words") <= of_language(self.repeats)
        kept = F.coalesce(within & fresh, F.lit(False))
        return scores.select("uid", "id", "lang", F.col("mean").alias("neg_log_prob"), limit.alias("limit"), kept.alias("kept"))


def _rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(ROW).alias("uid"), F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), "trusted", F.col(text_col).alias("text"))


def fit_and_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[Classifier, DataFrame]:
    """A classifier of all trusted rows of ``docs``, from ``number_rows``, and the scores of all its rows.

    The limits come from the same scores, so texts are scored once. Without any trusted text, everything with a text is kept.
    """
    rows = mark_trusted(_rows(docs.withColumn("trusted", F.lit(False)), id_col, text_col, lang_col).drop("trusted"), labels.withColumnRenamed(id_col, "id"), "id")
    out = Classifier(train_words(rows.where("trusted")), {}, {}, {})
    scores = out.score(rows)
    trusted = scores.where("trusted")
    out.limits, out.floors, out.repeats = language_limits(trusted, F.col("mean_elsewhere")), language_limits(trusted, -F.col("mean"), 1.0), language_limits(trusted, _repeated())
    return out, scores


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, neg_log_prob, perplexity, limit, kept) for each row of ``docs``, learnt from those that ``labels`` trusts.

    Languages without a trusted document, null among them, take the limit of all; null and blank
    texts have no perplexity and aren't kept. Repeated rows are judged as often as they occur; an
    empty table gives an empty result; other columns are ignored.
    """
    classifier, scores = fit_and_score(number_rows(docs), labels, id_col, text_col, lang_col)
    if classifier.model is not None:
        classifier.model.drop()
    out = classifier.judge(scores)
    return out.select(F.col("id").alias(id_col), "lang", "neg_log_prob", F.exp("neg_log_prob").alias("perplexity"), "limit", "kept")


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are; nulls, repeated rows and empty tables as in ``classify_quality``."""
    rows = number_rows(docs)
    classifier, scores = fit_and_score(rows, labels, id_col, text_col, lang_col)
    if classifier.model is not None:
        classifier.model.drop()
    return keep_rows(rows, classifier.judge(scores).select(F.col("uid").alias("row_uid"), "kept"))
