"""Queries against their SQL."""

import pytest

from brickfield.llm import queries, sql
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    n, ours, theirs, columns, m = differences(spark, SF, queries.queries()[name], sql.oracle_sql()[name])
    assert columns is None and not ours and not theirs and n == m
