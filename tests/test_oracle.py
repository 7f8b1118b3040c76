"""Every query with SQL gives the same rows in DuckDB."""

import pytest
from oracle import compare

from siltmark import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    assert compare(spark, sf, [name], catalog.QUERIES, catalog.ORACLE_SQL)[name] == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())


def test_row_order_and_partitions_do_not_matter(spark, sf):
    for name in ("findings_scorecard", "review_scores", "deduped_findings", "related_documents"):
        before = sorted(map(tuple, catalog.QUERIES[name](spark, sf).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        try:
            assert sorted(map(tuple, catalog.QUERIES[name](spark, sf).collect())) == before
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
