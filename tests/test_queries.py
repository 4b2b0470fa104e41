"""Every registered query equals its SQL on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry
from lexweave.plans.catalog import all_queries, all_sql
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
JOBS, SQL = all_queries(), all_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="data not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(SQL) == set(JOBS)


@pytest.mark.parametrize("name", sorted(JOBS))
def test_query(spark, con, name):
    assert compare(spark, con, name, JOBS[name], SQL[name], SF) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
