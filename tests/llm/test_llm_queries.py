"""Training-data queries with a check SQL, side by side."""

import pytest

from tests.oracle_check import compare, connect
from tracewell.llm.queries import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(oracles()))
def test_query_matches_its_check(spark, con, name):
    assert compare(spark, con, name, queries()[name], oracles()[name], SF) == ""
