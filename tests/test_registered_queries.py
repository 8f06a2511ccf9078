"""Every registered query with an oracle equals it on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, con, name):
    message, _ = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert message is None, message


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_names_are_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
