from __future__ import annotations

import pytest

from pageflow.llm.queries import ORACLES, QUERIES
from tests.compare import assert_same, sql_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, small, name):
    assert_same(QUERIES[name](spark, small).toPandas(), sql_rows(small, ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).toPandas() is not None
