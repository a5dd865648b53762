"""Every registered query against its oracle SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle import TESTDATA, compare, duck

SF_DIR = os.environ.get("ORACLE_SF_DIR", f"{TESTDATA}/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    query, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        query(spark, SF_DIR).count()
        return
    ok, note = compare(spark, con, query, sql, SF_DIR)
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
