"""All queries of the library and the SQL that checks them."""

from __future__ import annotations

from quernstone.queries import REGISTRY, analysis, graphs, records, reports, retrieval, scores, sequences, streams, texts

#: Modules that register queries when they are imported.
FAMILIES = (records, reports, sequences, retrieval, graphs, texts, scores, analysis, streams)


def queries() -> dict:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
