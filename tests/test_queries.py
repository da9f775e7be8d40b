"""Every query that has SQL gives the SQL's rows; the others run and keep their columns."""

from __future__ import annotations

import pytest
from tests.conftest import DATA, same_as_sql

from wayquarry.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, oracle, name):
    same_as_sql(spark, QUERIES[name], ORACLE_SQL[name], oracle("sf0.001"), "sf0.001")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, str(DATA / "sf0.001"))
    assert len(df.columns) == len(set(df.columns))
    assert df.count() > 0
