"""Every registered core query: against its SQL where it has one, else that it runs."""

from __future__ import annotations

import pytest

from pageflow.plans.queries import ORACLES, QUERIES
from tests.compare import assert_same, sql_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, small, name):
    assert_same(QUERIES[name](spark, small).toPandas(), sql_rows(small, ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.columns
    df.toPandas()


def test_entry(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
