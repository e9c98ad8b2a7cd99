"""Every registered query against its SQL, over whole tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

TWINS = entry.oracle_sql()
#: The training-data operators have their own tests in tests/llm.
OPTIONAL = set(entry.optional_queries())
QUERIES = {name: build for name, build in entry.queries().items() if name not in OPTIONAL}


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(TWINS) - OPTIONAL


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, small, name):
    assert compare(spark, con, small, QUERIES[name], TWINS[name]) == ""


def test_entry(spark):
    faults = entry.entry(spark)
    assert faults.columns == ["clip_id", "ord", "code", "message"]
    assert faults.count() > 0
