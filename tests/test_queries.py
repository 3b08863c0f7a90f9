"""Every registered query against its SQL, on the smallest tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as driver
from haulframe.catalog.oracle import ORACLE
from haulframe.catalog.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    assert differences(QUERIES[name](spark, SF), tables, ORACLE[name]) is None


def test_driver_has_them_all():
    assert driver.queries().items() >= QUERIES.items() and driver.oracle_sql().items() >= ORACLE.items()


def test_entry(spark):
    assert driver.entry(spark).count() > 0
