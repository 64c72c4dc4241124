"""Every registered query of the engine's own operators against its SQL."""

from __future__ import annotations

import pytest
from comparing import DATA, rows, tables

from tallyspark.plans import filing_oracles, filings, oracles, queries, work, work_oracles

QUERIES, SQL = queries.QUERIES | filings.QUERIES | work.QUERIES, oracles.SQL | filing_oracles.SQL | work_oracles.SQL


@pytest.fixture(scope="module")
def duck():
    return tables("sf0.001")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, str(DATA / "sf0.001")).toPandas()
    if name not in SQL:
        assert len(found) > 0
        return
    expected = duck.execute(SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
