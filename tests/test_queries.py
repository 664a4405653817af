"""Every registered query of the library against its SQL twin, on the smallest tables."""

import pytest
from oracle import SF, connect, same

from stereolith import queries


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_twin(spark, con, name):
    same(queries.QUERIES[name](spark, SF), queries.SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_rows(spark, name):
    # values of these are held against plain versions in the tests of their operators
    found = queries.QUERIES[name](spark, SF)
    assert found.count() > 0 and len(set(found.columns)) == len(found.columns)


def test_entry(spark):
    assert queries.entry(spark, SF).count() > 0
