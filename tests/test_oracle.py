"""Every registered query of the library's own operators against its SQL, on the smallest tables."""

import os

import pytest

from vecloom.plans import queries as Q

from .oracle import compare, connect

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query(spark, con, name):
    assert not compare(spark, Q.QUERIES[name], Q.SQL[name], DATA, con)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_query_without_sql(spark, name):
    df = Q.QUERIES[name](spark, DATA)
    assert df.columns and df.count()


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 10
