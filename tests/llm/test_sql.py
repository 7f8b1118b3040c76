"""Corpus queries with SQL give the same rows in DuckDB."""

import pytest
from oracle import compare

from siltmark.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    assert compare(spark, sf, [name], QUERIES, ORACLE_SQL)[name] == ""
