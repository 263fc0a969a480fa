"""Operators of a large-scale training-data pipeline. Nothing else in the library imports this."""

from __future__ import annotations


def queries() -> dict:
    from quernstone.llm.registry import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from quernstone.llm.registry import ORACLES

    return dict(ORACLES)
