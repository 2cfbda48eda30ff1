"""Every registered query of the library's own operators against its DuckDB text, on the smallest data set.

The training-data queries have their own tests beside their operators."""

import pytest

import __spark_entry__ as entry
from parity import ORACLE, QUERIES
from parity.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    assert compare(spark, con, key, entry.queries()[key], SQL[key], FOLDER)


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES) <= set(entry.queries())
