"""Every registered query against its SQL on the smallest driver tables."""

import os

import pytest

from registry import QUERIES, SQL
from tests.compare import compare, connection

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_sql(spark, duck, key):
    state, _, _ = compare(spark, duck, QUERIES[key], SQL[key], SF)
    assert state in ("exact", "close"), state


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, key):
    assert QUERIES[key](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 7
    assert set(e.oracle_sql()) <= set(e.queries())
