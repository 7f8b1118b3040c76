"""Rules and facts against SQL; every rule is seen to fire and not to."""

from pyspark.sql import functions as F

from siltmark import catalog
from siltmark.operators import rules




def test_every_rule_fires_and_does_not(spark, sf):
    found = catalog.QUERIES["rule_findings"](spark, sf).groupBy("rule_id").agg(F.countDistinct("id").alias("n")).collect()
    n = spark.read.parquet(f"{sf}/part.parquet").count()
    assert {r.rule_id for r in found} == {r.rule_id for r in rules.rules()} | {"SEC-SECRETS-001"} and len(found) == 30
    assert all(0 < r.n < n for r in found)


def test_every_query_reads_a_table(spark, sf):
    """No registered query stands on rows of its own."""
    for name, f in catalog.QUERIES.items():
        assert name in catalog.ORACLE_SQL or name in ("list_neighbours",), name
    assert not [n for n, s in catalog.ORACLE_SQL.items() if "FROM" not in s.upper()]


def test_detectors_and_tools_read_their_input_once(spark, sf):
    from siltmark.operators import risk
    from siltmark.plans.sources import repo_files
    from siltmark.sources import readers

    plan = risk.summary(spark.read.schema("repo_id int, path string, content string").parquet(f"{sf}/part.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hash") == 1
    raw = spark.read.schema("repo_id int, tool string, raw_json string").parquet(f"{sf}/part.parquet")
    plan = readers.all_issues(raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    assert risk.hotspots(repo_files(spark, sf)).count() > 0 and risk.config_files(repo_files(spark, sf)).count() > 0


def test_stack_items_is_whole(spark, sf):
    """Manifests are read, skipped folders are not, and each item has its confidence and all evidence."""
    got = {r.item.split(":")[1]: r for r in catalog.QUERIES["stack_items"](spark, sf).filter("id in (3, 4)").collect()}
    assert (got["Next.js"].confidence, got["Next.js"].evidence) == (0.95, "'next' in package.json,next.config.js")
    assert (got["TypeScript"].confidence, got["TypeScript"].evidence) == (0.9, "webV3.tsx,x/b.ts")
    assert got["Docker"].evidence == "a/Dockerfile" and got["GitHub Actions"].evidence == ".github/workflows/cV4.yml,.github/workflows/d.yml"
