"""Every registered query against its SQL check, on the smallest data."""

import re

import pytest
from compare import connect, difference

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
# The operators for training data have tests of their own.
QUERIES = sorted(q for q in entry.queries() if q != "pipeline" and not re.match(r"op\d+_", q))


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_contract():
    queries, checks = entry.queries(), entry.oracle_sql()
    assert set(checks) <= set(queries)
    assert set(QUERIES) <= set(checks)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, connection, name):
    df = entry.queries()[name](spark, FOLDER)
    assert difference(df, connection, entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 10
