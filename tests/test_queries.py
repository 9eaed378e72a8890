"""Registered queries against their SQL at the smallest scale.

``TEST_QUERIES`` names some of them, comma-separated; by default all run.
"""

import os

import compare
import pytest

import __spark_entry__ as entry
from ledgerline import catalog

# Queries of optional packages are tested beside those packages.
ORACLES = catalog.ORACLES
NAMES = os.environ["TEST_QUERIES"].split(",") if os.environ.get("TEST_QUERIES") else sorted(ORACLES)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, sf, duck, name):
    assert compare.difference(entry.queries()[name](spark, sf), duck, ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "file_id"
