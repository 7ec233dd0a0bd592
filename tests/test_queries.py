"""Every named query against its SQL twin on the small driver tables."""

import os

import pytest
from compare import connect, difference

import __spark_entry__ as entry
from footmark.plans.oracle import ORACLE
from footmark.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "overall_confidence" in df.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    found = difference(spark, con, name, QUERIES[name], ORACLE[name], SF)
    # The smallest tables may leave a query without rows on both sides; that is still agreement.
    assert found in (None, "no rows")
