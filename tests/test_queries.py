"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import difference, duck
from workload.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    try:
        assert difference(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None
    finally:
        spark.catalog.clearCache()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
