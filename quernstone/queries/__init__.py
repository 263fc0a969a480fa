"""Registered queries of the library: a callable on (spark, sf_dir) and the DuckDB SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}

#: Reports take this time as "now", so that they can be repeated.
AS_OF = "2024-02-01 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its oracle if SQL can express it."""

    def add(f: Query) -> Query:
        if f.__name__ in REGISTRY:
            raise ValueError(f"{f.__name__} is registered twice")
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add
