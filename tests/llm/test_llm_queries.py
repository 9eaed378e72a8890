"""The registered queries against their SQL."""

import compare
import pytest

import __spark_entry__ as entry
from ledgerline.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, sf, duck, name):
    assert compare.difference(entry.queries()[name](spark, sf), duck, catalog.ORACLES[name]) is None


def test_one_query_a_number():
    numbers = sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES)
    assert len(numbers) == len(set(numbers)) and set(range(1, 11)) <= set(numbers) and "pipeline" in entry.queries()
