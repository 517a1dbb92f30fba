"""Every registered query against DuckDB on the generated tables."""

import pytest

import __spark_entry__ as registered
from compare import connect, difference
from declarium.plans.oracle import ORACLE
from declarium.plans.registry import QUERIES

FOLDERS = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]


@pytest.fixture(scope="module", params=FOLDERS)
def folder(request):
    return request.param


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, folder, duck, name):
    assert difference(QUERIES[name](spark, folder), duck, ORACLE[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(registered.queries())
    assert set(registered.oracle_sql()) <= set(registered.queries())


def test_entry_has_rows(spark):
    assert not registered.entry(spark).isEmpty()
