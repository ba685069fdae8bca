"""Every registered query against its SQL, and a row check for those without."""

import pytest

import __spark_entry__ as entry_points
from tests import compare

SF = "/root/testdata/sf0.001"
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.database(SF)


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, con, name):
    assert compare.compare(spark, con, name, entry_points.queries()[name], SQL.get(name), SF) == ""


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(entry_points.queries())


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0
