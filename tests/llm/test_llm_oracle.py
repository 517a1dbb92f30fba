"""The check SQL of this package, where there is any, against the queries."""

import pytest

import __spark_entry__ as registered
from compare import connect, difference
from declarium.llm.oracle import LLM_ORACLE
from declarium.llm.queries import LLM_QUERIES


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_matches_sql(spark, folder, name):
    assert difference(LLM_QUERIES[name](spark, folder), connect(folder), LLM_ORACLE[name]) is None


def test_all_are_registered():
    assert set(LLM_QUERIES) | {"pipeline"} <= set(registered.queries())
    assert set(LLM_ORACLE) <= set(registered.oracle_sql())
    numbers = sorted(int(name[2:].split("_")[0]) for name in LLM_QUERIES)
    assert numbers == list(range(1, 14))
