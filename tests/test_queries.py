"""Every relational query against its SQL."""

import pytest

from brindle import queries
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, con, name):
    assert_same(queries.QUERIES[name](spark, small), con, queries.SQL[name])
