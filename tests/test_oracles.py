"""Every registered query of the network-fault operators against its SQL."""

import pytest

from lumentrace.plans import registry
from tests.compare import connect, differ

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


#: Text likeness by matching blocks has no SQL; test_answers holds it against plain loops.
NO_SQL = {"reward_continuous"}


def test_every_query_has_sql():
    assert set(registry.queries()) == set(SQL) | NO_SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert differ(spark, con, SF, registry.queries()[name], SQL[name]) == ""
