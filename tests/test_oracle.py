"""Every registered query against its SQL statement."""

import pytest

import __spark_entry__ as entry_points
from hoardlens.plans.oracles import ORACLES
from hoardlens.plans.queries import QUERIES
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) == []


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLES) <= set(entry_points.oracle_sql())


def test_entry_runs(spark):
    assert entry_points.entry(spark).count() > 0
