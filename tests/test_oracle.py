"""Every registered query against the same query in SQL."""

import pytest

from checks import ORACLES, QUERIES
from checks.compare import difference, oracle_connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    if name in ORACLES:
        assert difference(spark, con, SF, QUERIES[name], ORACLES[name]) is None
    else:
        assert QUERIES[name](spark, SF).count() >= 0
