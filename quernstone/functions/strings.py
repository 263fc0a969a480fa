"""String similarity: set measures as expressions, sequence measures as Arrow functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.similarity import dice, jaccard
from quernstone.plans import ship

# Weights of the combined measure.
WEIGHTS = {"jaccard": 0.25, "dice": 0.2, "jaro": 0.1, "jaro_winkler": 0.15, "cosine": 0.2, "lcs": 0.1}


def chars(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def char_jaccard(a: Column, b: Column) -> Column:
    return jaccard(chars(a), chars(b))


def char_dice(a: Column, b: Column) -> Column:
    return dice(chars(a), chars(b))


def char_cosine(a: Column, b: Column) -> Column:
    """Cosine of character counts; 1 if both are empty, 0 if one is."""
    count = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    total = lambda x, y: F.aggregate(F.array_union(chars(a), chars(b)), F.lit(0.0), lambda acc, c: acc + count(x, c) * count(y, c))
    norm = F.sqrt(total(a, a)) * F.sqrt(total(b, b))
    return F.when((F.length(a) == 0) & (F.length(b) == 0), 1.0).otherwise(F.coalesce(F.try_divide(total(a, b), norm), F.lit(0.0)))


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for j, c in enumerate(b) if not free[j]]
    m = len(left)
    swapped = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def _jaro_winkler(a: str, b: str, scale: float = 0.1) -> float:
    base, same = _jaro(a, b), 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return base + same * scale * (1 - base)


def _lcs(a: str, b: str) -> float:
    """Longest common subsequence by the longer length, with one bit row instead of a table."""
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return bin(row ^ full).count("1") / max(len(a), len(b))


def _pairwise(measure, a: Column, b: Column) -> Column:
    """An Arrow function of two texts, worked out once for equal pairs of a batch; made when used, because it needs a session."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs = [(s or "", t or "") for s, t in zip(x, y, strict=True)]
        found = {p: measure(*p) for p in set(pairs)}
        return pd.Series([found[p] for p in pairs], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def jaro(a: Column, b: Column) -> Column:
    return _pairwise(_jaro, a, b)


def jaro_winkler(a: Column, b: Column) -> Column:
    return _pairwise(_jaro_winkler, a, b)


def lcs_ratio(a: Column, b: Column) -> Column:
    return _pairwise(_lcs, a, b)


def measures(spark: SparkSession, a: Column, b: Column) -> dict[str, Column]:
    """All measures by name, and ``combined``, their weighted sum."""
    ship(spark)
    out = {"jaccard": char_jaccard(a, b), "dice": char_dice(a, b), "jaro": jaro(a, b), "jaro_winkler": jaro_winkler(a, b), "cosine": char_cosine(a, b), "lcs": lcs_ratio(a, b)}
    out["combined"] = sum((out[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return out


def quick(a: Column, b: Column, threshold: float) -> Column:
    """0 for texts whose lengths differ by more than half or whose characters differ too much, else their Jaccard."""
    short, long_ = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    j = char_jaccard(a, b)
    return F.when((long_ > 0) & (short / F.greatest(long_, F.lit(1)) < 0.5), 0.0).when(j < 0.8 * threshold, 0.0).otherwise(j)
