"""Queries over staged answers, pages and stored rows, made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query, table
from ..operators import findings, ranking
from ..sources import sinks
from .records import FORKS, STARS, _candidates


@query("SELECT l_orderkey AS id, 'sha' || l_orderkey AS sha, 'src/f' || l_linenumber || '.py' AS path, CASE WHEN l_linenumber % 3 = 0 THEN 'tree' ELSE 'blob' END AS type, l_partkey::BIGINT AS size FROM lineitem")
def repo_trees(spark, sf):
    """Files of staged tree answers, one answer an order (A1, A4)."""
    x = table(spark, sf, "lineitem").select("l_orderkey", F.struct(F.format_string("src/f%d.py", "l_linenumber").alias("path"), F.when(F.col("l_linenumber") % 3 == 0, "tree").otherwise("blob").alias("type"), F.col("l_partkey").alias("size")).alias("e"))
    raw = x.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("e").alias("tree")).select("id", F.to_json(F.struct(F.format_string("sha%d", "id").alias("sha"), "tree")).alias("raw_json"))
    return sinks.repo_tree(raw, "id")


@query("SELECT c_custkey AS id, c_name AS full_name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS description, 'main' AS default_branch, (c_nationkey)::BIGINT AS stars, len(string_split('a b c', ' '))::INT AS n_topics FROM customer")
def repo_metadata(spark, sf):
    """Staged metadata answers by field (A2)."""
    c = table(spark, sf, "customer")
    body = F.struct(F.col("c_name").alias("full_name"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("description"), F.lit("main").alias("default_branch"), F.col("c_nationkey").alias("stargazers_count"), F.array(*map(F.lit, "abc")).alias("topics"))
    x = sinks.repo_metadata(c.select(F.col("c_custkey").alias("id"), F.to_json(body).alias("raw_json")), "id")
    return x.select("id", "full_name", "description", "default_branch", F.col("stargazers_count").alias("stars"), F.size("topics").alias("n_topics"))


@query("SELECT doc_id, source AS role, n_chars FROM documents WHERE source = 'src0' AND doc_id % 2 = 0 ORDER BY doc_id LIMIT 1000 OFFSET 3")
def files_page(spark, sf):
    """A page of the files of one role on the critical path."""
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("role"), "n_chars", (F.col("doc_id") % 2 == 0).alias("critical"))
    return findings.page(d, [F.col("doc_id")], 1200, 3, 1000, role="src0", critical=True).drop("critical")


@query("SELECT l_orderkey AS source, l_linenumber AS n, l_partkey AS target FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' ORDER BY 1, 2, 3 LIMIT 5000 OFFSET 10")
def edges_page(spark, sf):
    """A page of unresolved edges of one reason, at most 5000."""
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("target"), F.when(F.col("l_linestatus") == "F", "unresolved").otherwise("confirmed").alias("confidence"), F.col("l_returnflag").alias("reason"))
    return findings.page(e, [F.col("source"), F.col("n"), F.col("target")], 9000, 10, 5000, confidence="unresolved", reason="R").select("source", "n", "target")


@query(
    """SELECT c_custkey AS job_id, 'https://x/' || c_name AS repo_url, 'main' AS branch, '1.0' AS schema_version, 'deep' AS depth_level, c_nationkey AS security_score, c_custkey % 7 AS operations_score, c_custkey % 2 = 0 AS production_suitable,
'{"security":' || c_nationkey || ',"operational_readiness":' || (c_custkey % 7) || '}' AS scorecard_json, NULL AS error_code FROM customer WHERE c_custkey % 5 > 0
UNION ALL SELECT c_custkey, 'https://x/' || c_name, 'main', NULL, NULL, NULL, NULL, NULL, NULL, 'TIMEOUT' FROM customer WHERE c_custkey % 5 = 0"""
)
def review_rows(spark, sf):
    """Finished and failed reviews as the table stores them."""
    c = table(spark, sf, "customer").withColumn("url", F.concat(F.lit("https://x/"), "c_name"))
    none = F.lit(None).cast("string")
    text = lambda *names: F.struct(*[none.alias(n) for n in names])
    card = F.struct(F.col("c_nationkey").alias("security"), (F.col("c_custkey") % 7).alias("operational_readiness"))
    score = F.struct(card["security"].alias("security"), none.alias("testing"), none.alias("maintainability"), none.alias("reliability"), card["operational_readiness"].alias("operational_readiness"), none.alias("developer_experience"))
    report = F.struct(
        F.struct(F.col("url"), none.alias("commit")).alias("repo"), text("ruleset_version", "schema_version", "confidence_label", "overall_score").alias("meta"), F.struct(F.lit("deep").alias("level")).alias("depth"), score.alias("scorecard"),
        F.struct(none.alias("overall_label"), none.alias("trust_recommendation"), F.when(F.col("c_custkey") % 2 == 0, True).alias("production_suitable")).alias("interpretation"), text("overall_verdict").alias("anti_gaming"), F.array(text("rule_id")).alias("findings"), text("tools").alias("coverage"), text("headline").alias("review_summary"),
    )
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    done = sinks.review_rows(c.filter("c_custkey % 5 > 0").select(F.col("c_custkey").alias("job_id"), none.alias("branch"), report.alias("report")), now)
    lost = sinks.error_rows(c.filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("job_id"), F.col("url").alias("repo_url"), none.alias("commit"), none.alias("branch"), F.lit("TIMEOUT").alias("error_code"), F.lit("").alias("error_message")), now)
    out = done.unionByName(lost, allowMissingColumns=True)
    shown = F.regexp_replace("scorecard_json", r'"(testing|maintainability|reliability|developer_experience)":null,?', "")
    return out.select("job_id", "repo_url", "branch", "schema_version", "depth_level", "security_score", "operations_score", "production_suitable", F.regexp_replace(shown, r",\}$", "}").alias("scorecard_json"), "error_code")


@query("SELECT vec_id, CASE WHEN vec_id % 3 > 0 THEN len(embedding) END::INT AS n, CASE WHEN vec_id % 3 > 0 THEN embedding[1]::DOUBLE END AS first_value, vec_id % 3 = 0 AS missing FROM embeddings")
def stored_embeddings(spark, sf):
    """Vectors as JSON text and back; a third of the chunks have none."""
    e = table(spark, sf, "embeddings")
    rows = sinks.embedding_rows(e.select("vec_id"), e.filter("vec_id % 3 > 0").select("vec_id", F.col("embedding").cast("array<double>").alias("vector")), ["vec_id"])
    v = sinks.stored_vector(F.col("embedding"))
    return rows.select("vec_id", F.size(v).alias("n"), F.get(v, F.lit(0)).alias("first_value"), F.col("embedding").isNull().alias("missing")).withColumn("n", F.when(~F.col("missing"), F.col("n")))


@query(
    f"""WITH c AS (SELECT p_partkey AS id, p_name, p_type AS d, {STARS} AS s, {FORKS} AS f, p_size * 9 AS i, p_partkey % 400 AS u, p_partkey % 900 AS a, p_brand AS l, p_partkey % 2 = 0 AS gl, p_partkey % 4 = 0 AS rv FROM part),
k AS (SELECT *, CASE WHEN s >= 1000 THEN format('{{:.1f}}k', s / 1000.0) ELSE s::VARCHAR END AS ss FROM c)
SELECT id, array_to_string(list_filter([
  CASE WHEN s >= 100 THEN 'good' WHEN s >= 10 THEN 'warn' ELSE 'bad' END || ':★ ' || ss || ' stars',
  CASE WHEN (a > 365 AND u <= 90) OR (a > 180 AND u <= 30) THEN 'good:Active ' || u || 'd ago (' || (a // 30) || 'mo track record)' WHEN u <= 90 THEN 'good:Updated ' || u || 'd ago' WHEN u <= 365 THEN 'warn:Updated ' || u || 'd ago' ELSE 'bad:Stale: ~' || (u // 365) || 'yr ago' END,
  'good:' || l, CASE WHEN NOT gl THEN 'warn:README (unverified)?' WHEN rv THEN 'good:README confirmed' ELSE 'warn:No README found' END,
  CASE WHEN f >= 500 THEN 'good:⑂ ' || f || ' forks' END,
  CASE WHEN i / greatest(s, 1) > 0.5 AND s >= 50 THEN 'warn:High open issue ratio (' || i || ' issues / ' || s || ' stars)' WHEN i / greatest(s, 1) < 0.05 AND s >= 100 THEN 'good:Low issue backlog' END,
  CASE WHEN id % 5 = 0 THEN 'bad:Is a fork' END, CASE WHEN regexp_matches(d, '(?i)\\b(mirror|clone|copy|backup|archived?)\\b') OR regexp_matches(lower(p_name), '\\b(mirror|clone|copy|backup|archived?)\\b') THEN 'warn:Possible mirror/clone' END
], lambda x: x IS NOT NULL), '|') AS signals FROM k"""
)
def candidate_signals(spark, sf):
    """What speaks for and against every candidate."""
    c = _candidates(spark, sf)
    flags = ranking.noise_flags(F.col("is_fork"), F.col("is_archived"), F.col("is_template"), F.col("description"), F.col("full_name"), F.col("stars"), F.col("forks"))
    s = ranking.signals(F.col("stars"), F.col("updated_days"), F.col("created_days"), F.col("license_name"), F.col("id") % 2 == 0, F.col("id") % 4 == 0, F.col("forks"), F.col("open_issues"), flags)
    return c.select("id", F.array_join(F.transform(s, lambda x: F.concat(x["type"], F.lit(":"), x["label"], F.when(x["verified"], "").otherwise("?"))), "|").alias("signals"))


@query(
    """WITH c AS (SELECT c_custkey AS id, c_custkey % 4 AS k, c_custkey % 3 AS f FROM customer), x AS (SELECT id, k, f, CASE k WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['python', 'node', 'go'] WHEN 2 THEN ['go'] ELSE ['cobol'] END AS ls FROM c)
SELECT id, 'dev-' || CASE k WHEN 0 THEN 'base' WHEN 1 THEN 'python-node' WHEN 2 THEN 'go' ELSE 'cobol' END AS name,
  'mcr.microsoft.com/devcontainers/' || CASE WHEN k < 2 THEN 'python:3-3.11' WHEN k = 2 THEN 'go:1' ELSE 'base:ubuntu' END AS image,
  CASE f WHEN 0 THEN 'git' WHEN 1 THEN 'x,python,git' ELSE 'x,node,python,git' END || ',docker-in-docker' AS features,
  CASE f WHEN 0 THEN '' ELSE '{"redis":{"image":"redis:7","ports":{"6379":6379}}}' END AS services,
  CASE k WHEN 1 THEN 'python -m pip install --upgrade pip && if [ -f requirements.txt ]; then pip install -r requirements.txt; fi && if [ -f pyproject.toml ]; then pip install -e .; fi && npm install && go mod download' WHEN 2 THEN 'go mod download' ELSE '' END AS post_create FROM x"""
)
def devcontainers(spark, sf):
    """Development containers by languages, frameworks and services."""
    k, f = F.col("c_custkey") % 4, F.col("c_custkey") % 3
    arr = lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.when(k == 0, arr()).when(k == 1, arr("python", "node", "go")).when(k == 2, arr("go")).otherwise(arr("cobol")).alias("languages"),
        F.when(f == 0, arr("unknown")).when(f == 1, arr("FastAPI")).otherwise(arr("React", "Flask")).alias("frameworks"), F.when(f == 0, arr("kafka")).otherwise(arr("Redis", "redis")).alias("services"), F.when(f == 0, arr()).otherwise(arr("x")).alias("custom"),
    )
    made = sinks.devcontainer(rows, "id")
    short = F.transform("features", lambda x: F.regexp_replace(x, r"^ghcr\.io/devcontainers/features/|:latest$", ""))
    services = F.when(F.size("services") > 0, F.get_json_object("json", "$.services")).otherwise("")
    return made.select("id", "name", "image", F.array_join(short, ",").alias("features"), services.alias("services"), "post_create")


@query(
    """WITH r AS (SELECT lpad(p_partkey::VARCHAR, 8, '0') AS id, p_name AS q, p_brand AS cls, p_size / 64.0 AS nd, p_size / 128.0 AS p, p_partkey % 3 > 0 AS ideal, p_partkey % 10 > 0 AS ok FROM part),
t AS (SELECT cls, avg(nd) AS nd, avg(p) AS p FROM r WHERE ideal GROUP BY ROLLUP (cls))
SELECT 0 AS section, format('| Mean NDCG@3 | {:.3f} |', nd) AS line FROM t WHERE cls IS NULL UNION ALL SELECT 0, format('| Mean P@3 | {:.3f} |', p) FROM t WHERE cls IS NULL
UNION ALL SELECT 0, '| Noise gate failures | ' || count(*) || ' |' FROM r WHERE NOT ok
UNION ALL SELECT 1, format('| {} | {:.3f} | {:.3f} |', cls, nd, p) FROM t WHERE cls IS NOT NULL
UNION ALL SELECT 3, '| ' || id || ' | ' || left(q, 40) || ' | ' || cls || ' | ' || CASE WHEN ideal THEN format('{:.2f} | {:.2f}', nd, p) ELSE 'n/a | n/a' END || ' | `' || left(q, 35) || '` | ' || CASE WHEN ok THEN '✓' ELSE '**✗**' END || ' |' FROM r
UNION ALL SELECT 5, '- **[' || id || ']** ' || q FROM r WHERE NOT ok"""
)
def benchmark_report(spark, sf):
    """Lines with figures of a ranking benchmark's report."""
    r = table(spark, sf, "part").select(F.format_string("%08d", "p_partkey").alias("id"), F.col("p_name").alias("query"), F.col("p_brand").alias("cls"), (F.col("p_size") / 64.0).alias("ndcg"), (F.col("p_size") / 128.0).alias("p"), (F.col("p_partkey") % 3 > 0).alias("has_ideal"), F.col("p_name").alias("top"), (F.col("p_partkey") % 10 > 0).alias("passed"))
    lines = sinks.report_lines(r, 0.4, 0.6, F.lit("2024-01-31 00:00 UTC"))
    return lines.filter("section in (1, 3, 5) or line like '| Mean %' or line like '| Noise %'").select("section", "line")
