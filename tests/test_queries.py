"""Every query with SQL gives the SQL's rows at the smallest scale."""

from __future__ import annotations

import harness
import pytest

from meshwork.plans.oracles import oracle_sql
from meshwork.plans.queries import queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return harness.tables(sf_dir)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, sf_dir, con, name):
    own, theirs = harness.rows_of_spark(queries()[name](spark, sf_dir)), harness.rows_of_sql(con, oracle_sql()[name])
    assert own[0] == theirs[0]
    assert own[1] == theirs[1]


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
