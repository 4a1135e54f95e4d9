"""Every query of the reference's own operators against its SQL."""

from __future__ import annotations

import pytest

from carefold import registry
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert_same(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    assert len(df.columns) == len(set(df.columns))
    df.collect()


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
