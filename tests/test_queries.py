"""Every query of the library proper against its SQL on DuckDB."""

from __future__ import annotations

import pytest

from quernstone import catalog
from tests.compare import rows

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    out = QUERIES[name](spark, sf_dir).toPandas()
    assert len(out.columns)
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(out.columns) == sorted(want.columns)
        assert rows(out) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    # the lists can be asked for again
    assert set(QUERIES) <= set(__spark_entry__.queries())
