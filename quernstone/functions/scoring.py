"""Scores, tiers and costs as column expressions; the tables that they need stand here as plain values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions.text import js_round

# Base score of each complexity and boost of each tag.
COMPLEXITY_BASE = {"trivial": 10, "simple": 25, "moderate": 50, "complex": 75, "epic": 95}
TAG_BOOST = {"architecture": 20, "security": 15, "performance": 10, "refactor": 10, "migration": 15, "database": 10, "api": 5, "lint": -15, "typo": -25, "formatting": -20, "docs": -10, "comment": -15, "rename": -10, "cleanup": -5}
# Upper bounds of tiers, chance of escalation, price of a million tokens in and out.
TIERS = [(20, "free"), (40, "cheap"), (65, "mid")]
ESCALATION = {"free": 0.3, "cheap": 0.2, "mid": 0.1, "premium": 0.0}
PRICES = {"free": (0.0, 0.0), "cheap": (0.075, 0.3), "mid": (1.25, 5.0), "premium": (15.0, 75.0)}
# Token multipliers and bases of an estimate.
TOKEN_FACTOR = {"trivial": 0.5, "simple": 0.75, "moderate": 1.0, "complex": 1.5, "epic": 2.5}
TOKENS_IN, TOKENS_OUT = 4000, 2000
# Upper bounds of effort in minutes, lower bounds of grades, reusability and impact levels.
EFFORT_LEVELS = [(5, "trivial"), (15, "small"), (30, "medium"), (60, "large")]
GRADES = [(90, "A"), (75, "B"), (60, "C"), (40, "D")]
REUSE_LEVELS = [(80, "core"), (50, "shared"), (30, "local"), (10, "rare")]
IMPACT_LEVELS = [(8, "critical"), (5, "high"), (3, "medium")]
# Lines from which a file is large, larger and largest.
FILE_SIZES = [(800, "critical"), (500, "error"), (300, "warning")]
# Multipliers of retrieval by importance and by type of entry.
IMPORTANCE = {"critical": 2.0, "high": 1.5, "medium": 1.0, "low": 0.5}
ENTRY_TYPE = {"decision": 1.3, "pattern": 1.2, "library": 1.2, "agent": 1.2, "bugfix": 1.1, "snippet": 1.1, "observation": 0.9}
HALF_LIFE_DAYS = 30


def banded(value: Column, bands: list[tuple[float, str]], rest: str, upper: bool = False) -> Column:
    """The name of the first band that holds the value; bounds are lower ones, or upper ones."""
    out = None
    for bound, name in bands:
        hit = value <= bound if upper else value >= bound
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(rest)


def mapped(value: Column, table: dict, rest) -> Column:
    out = None
    for key, v in table.items():
        out = F.when(value == key, v) if out is None else out.when(value == key, v)
    return out.otherwise(rest)


def task_score(complexity: Column, files: Column, criteria: Column, tags: Column) -> Column:
    """Base by complexity, 5 for each file and 3 for each criterion beyond two, boosts of tags; 0 to 100."""
    boost = F.aggregate(tags, F.lit(0), lambda a, t: a + mapped(t, TAG_BOOST, 0))
    raw = mapped(complexity, COMPLEXITY_BASE, 50) + 5 * F.greatest(F.lit(0), files - 2) + 3 * F.greatest(F.lit(0), criteria - 2) + boost
    return F.greatest(F.lit(0), F.least(F.lit(100), raw))


def tier(score: Column) -> Column:
    return banded(score, TIERS, "premium", upper=True)


def token_estimate(complexity: Column, files: Column) -> tuple[Column, Column]:
    factor = mapped(complexity, TOKEN_FACTOR, 1.0) * (1 + 0.1 * files)
    return js_round(TOKENS_IN * factor), js_round(TOKENS_OUT * factor)


def cost(tier_: Column, tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in / 1e6 * mapped(tier_, {k: v[0] for k, v in PRICES.items()}, 0.0) + tokens_out / 1e6 * mapped(tier_, {k: v[1] for k, v in PRICES.items()}, 0.0)


def expected_cost(tier_: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Own tier's cost and, with the chance of escalation, the premium one's."""
    p = mapped(tier_, ESCALATION, 0.0)
    return cost(tier_, tokens_in, tokens_out) * (1 - p) + cost(F.lit("premium"), tokens_in, tokens_out) * p


def signature(complexity: Column, tags: Column, files: Column) -> Column:
    """Twelve hex digits that are equal for tasks of the same kind."""
    many = F.when(files <= 2, "few").when(files <= 5, "some").otherwise("many")
    body = F.to_json(F.struct(complexity.alias("complexity"), F.array_sort(tags).alias("tags"), many.alias("filesRange")))
    return F.substring(F.md5(body.cast("binary")), 1, 12)


def adjusted_tier(tier_: Column, ok: Column, failed: Column) -> Column:
    """Tier after history: needs more than five samples; half failures raise cheap, 80 % successes lower mid."""
    n = ok + failed
    sure = (n >= 3) & (F.least(F.lit(1.0), n / 10) > 0.5)
    return F.when(sure & (tier_ == "cheap") & (failed / F.nullif(n, F.lit(0)) > 0.5), "mid").when(sure & (tier_ == "mid") & (ok / F.nullif(n, F.lit(0)) > 0.8), "cheap").otherwise(tier_)


def smart_relevance(base: Column, age_days: Column, importance: Column, kind: Column, context: Column) -> Column:
    """Base score decayed by age and boosted; 0 to 100, one decimal."""
    fresh = F.when(age_days * 24 < 24, 1.5).when(age_days * 24 < 168, 1.2).when(age_days * 24 > 720, 0.8).otherwise(1.0)
    raw = base * F.pow(F.lit(0.5), age_days / HALF_LIFE_DAYS) * mapped(importance, IMPORTANCE, 1.0) * mapped(kind, ENTRY_TYPE, 1.0) * fresh * context
    return js_round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)) * 10) / 10


def impact_level(dependents: Column, bugs: Column, percentile: Column, changes: Column) -> Column:
    points = F.when(dependents >= 20, 3).when(dependents >= 10, 2).when(dependents >= 5, 1).otherwise(0) + F.when(bugs > 3, 3).when(bugs >= 1, 2).otherwise(0) + F.when(percentile >= 95, 2.0).when(percentile >= 80, 1.0).when(percentile >= 50, 0.5).otherwise(0.0) + F.when(changes > 10, 2).when(changes > 5, 1).otherwise(0)
    return banded(points, IMPACT_LEVELS, "low")


def finding_score(ownership: Column, quality: Column, freshness: Column, relevance: Column, action: Column) -> Column:
    return ownership * quality * freshness * relevance * action


def match_action(similarity: Column, same_importance: Column) -> Column:
    """What to do with two similar entries: above 0.8 they are duplicates, above 0.5 related. Null importances are alike."""
    alike = F.when(same_importance, "delete-older").otherwise("merge")
    return F.when(similarity > 0.8, alike).when(similarity > 0.5, "merge").otherwise("keep-both")


def match_reason(similarity: Column, titles: Column, kinds: tuple[Column, Column], tags: tuple[Column, Column], features: tuple[Column, Column]) -> Column:
    """Why two entries match: titles above 0.6, one kind, shared tags, shared features; else the similarity in per cent.

    Shared values stand in the order of the first entry; null arrays share nothing.
    """
    shared = lambda two: F.array_intersect(*two)
    listed = lambda head, two: F.when(F.size(shared(two)) > 0, F.concat(F.lit(head), F.array_join(shared(two), ", ")))
    alike = F.when(kinds[0].eqNullSafe(kinds[1]), F.concat(F.lit("both "), F.coalesce(kinds[0], F.lit("unknown")), F.lit("s")))
    parts = F.array_compact(F.array(F.when(titles > 0.6, "similar titles"), alike, listed("shared tags: ", tags), listed("same feature: ", features)))
    return F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise(F.concat(js_round(similarity * 100).cast("string"), F.lit("% similar")))
