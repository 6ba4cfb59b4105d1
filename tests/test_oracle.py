"""Every query with a SQL twin must give the same rows on the smallest data set."""

import os

import pytest
from check import compare, duck

from creditloom.workload import all_oracles, all_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_matches_sql(spark, con, name):
    ok, note, _ = compare(spark, con, name, SF)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(all_oracles()) <= set(all_queries())
