"""Every registered query against its SQL, and the driver's entry points."""

from __future__ import annotations

import pytest
from check_oracles import compare, connect

import __spark_entry__ as driver
from plumbscore.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def database(folder):
    connection = connect(folder)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", ORACLES)
def test_agrees_with_sql(spark, folder, database, name):
    assert compare(QUERIES[name](spark, folder), database, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry_points(spark):
    assert driver.entry(spark).count() == 1
    assert set(driver.oracle_sql()) <= set(driver.queries())
