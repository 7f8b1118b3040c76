"""Queries of access, policy, scoring and service operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from .. import fixed
from ..catalog import query, table
from ..functions import columns as C
from ..operators import access, findings, graph, ops, ranking, repos, review
from ..sources import readers
from .records import JOBS, _jobs
from .sources import FILES_SQL, repo_files

NOW = "2024-01-31 00:00:00"


def _pick(values, column: str):
    return F.element_at(C.strings(values), (F.col(column) % len(values) + 1).cast("int"))


def _pick_sql(values, column: str) -> str:
    return f"[{', '.join(map(repr, values))}][({column} % {len(values)})::INT + 1]"


@query(
    f"""WITH f AS {FILES_SQL} SELECT repo_id, path, CASE WHEN path IN ('tests/test_a.py', 'tests/test_migrate.py', 'lib/test/b.ts') THEN 'test' ELSE 'other' END = 'test' AS is_test,
  path = 'src/app.py' AS is_entrypoint, path IN ('docs/LICENSE', 'Dockerfile', 'web/.prettierrc', 'Makefile') AS is_executable FROM f"""
)
def file_flags(spark, sf):
    """Entrypoint, executable and test flags of repositories' files."""
    f = access.with_flags(repo_files(spark, sf).withColumn("framework_signals", F.array().cast("array<string>")))
    return f.select("repo_id", "path", "is_test", "is_entrypoint", "is_executable")


@query(f"WITH f AS {FILES_SQL} SELECT count(*) FILTER (path = 'node_modules/x/auth.js' OR path = 'vendor/c.go' OR ends_with(path, '.lock')) AS skipped, 0::BIGINT AS generated, count(*) FILTER (NOT (path = 'node_modules/x/auth.js' OR path = 'vendor/c.go' OR ends_with(path, '.lock'))) AS scannable FROM f")
def scannable_counts(spark, sf):
    """How many files are skipped, generated and left to scan."""
    return access.scannable(repo_files(spark, sf).withColumn("kind", F.lit("blob")))[1]


_ROLES = ("service", "test", "module", "config", "utility")


@query(
    f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN true WHEN {_pick_sql(_ROLES, "p_size")} IN ('test', 'config') THEN false ELSE (p_size * 3 >= 50 AND p_size % 3 > 0) OR p_size % 20 >= 15 OR p_partkey % 4 >= 3 END AS reviewed FROM part"""
)
def review_gate(spark, sf):
    """Which files are worth a closer review."""
    p = table(spark, sf, "part")
    n = F.col("p_size")
    gate = access.needs_review(F.col("p_partkey") % 10 == 0, _pick(_ROLES, "p_size"), n * 3, n % 3, (n % 20).cast("double"), F.col("p_partkey") % 4)
    return p.select(F.col("p_partkey").alias("id"), gate.alias("reviewed"))


@query("SELECT page_id, url FROM pages WHERE contains(lower(url), '1') OR contains(lower(url), 'about') ORDER BY url")
def picked_paths(spark, sf):
    """Paths that hold any of some needles."""
    return access.pick_paths(table(spark, sf, "pages").select("page_id", "url"), ["1", "about"], "url")


@query(
    f"""WITH f AS {FILES_SQL}, u AS (SELECT repo_id, path, 0.92::DOUBLE AS confidence, 0 AS s FROM f WHERE path = 'src/app.py' UNION ALL SELECT repo_id, path, 0.78, 1 FROM f WHERE path = 'src/hub.py' OR path = 'src/app.py'
  UNION ALL SELECT repo_id, path, CASE WHEN path = 'README.md' THEN 0.7 ELSE 0.64 END, 2 FROM f WHERE path = 'README.md' OR contains(path, 'test')),
o AS (SELECT repo_id, path, arg_min(confidence, s) AS confidence, min(s) AS s FROM u GROUP BY repo_id, path), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY s, path) AS rank FROM o)
SELECT repo_id, path, confidence, rank::INT AS rank FROM r WHERE rank <= 3"""
)
def reading_paths(spark, sf):
    """What to read first in each repository."""
    f = repo_files(spark, sf).select("repo_id", "path")
    some = lambda *paths: f.filter(F.col("path").isin(*paths)).withColumn("ordinal", F.lit(0))
    return access.reading_path(some("src/app.py"), some("src/hub.py", "src/app.py"), f, ["repo_id"], 3)


@query("SELECT DISTINCT l_suppkey AS source, l_partkey AS target FROM lineitem WHERE l_suppkey IN (SELECT p_partkey FROM part WHERE p_size > 10) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def visible_edges(spark, sf):
    """Edges both ends of which are shown."""
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")).distinct()
    return graph.visible(e, table(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("path")), [])


_CLAIMS = (*fixed.STATIC_CLAIMS, *fixed.VERIFIED_CLAIMS, "runtime_works", "safe_to_deploy", "other")
_ASKED = ("public", "private", "verified")


@query(
    f"""WITH c AS (SELECT c_custkey AS id, {_pick_sql(("free", "Pro", "TEAM", "odd"), "c_custkey")} AS plan, {_pick_sql(_ASKED, "c_custkey * 7")} AS asked, {_pick_sql(_CLAIMS, "c_custkey")} AS claim, CASE WHEN c_custkey % 3 = 0 THEN 'verified' ELSE 'static' END AS tier FROM customer WHERE c_nationkey = 7),
d AS (SELECT *, lower(plan) IN ('pro', 'team') AS paid FROM c)
SELECT id, claim IN ('stack_detected', 'architecture_shape', 'api_surface', 'setup_risk', 'debug_readiness', 'change_risk', 'tests_found', 'ci_found', 'config_found') OR (tier = 'verified' AND claim IN ('tests_pass', 'build_succeeds', 'lint_clean', 'type_safe')) AS allowed,
  CASE WHEN paid THEN asked ELSE 'public' END AS scope, CASE WHEN paid OR asked = 'public' THEN NULL WHEN asked = 'private' THEN 'private_repos_not_allowed_on_free_plan' ELSE 'verified_checks_not_allowed_on_plan' END AS error,
  CASE lower(plan) WHEN 'free' THEN 10 WHEN 'pro' THEN 100 WHEN 'team' THEN -1 ELSE 0 END AS daily_limit FROM d"""
)
def allowed_claims(spark, sf):
    """What each account of one organisation may claim and ask for."""
    k = F.col("c_custkey")
    c = access.of_org(table(spark, sf, "customer").withColumn("org_id", F.col("c_nationkey")), 7)
    plan = _pick(("free", "Pro", "TEAM", "odd"), "c_custkey")
    scope = access.scope_for_plan(plan, F.element_at(C.strings(_ASKED), (k * 7 % len(_ASKED) + 1).cast("int")))
    claim = access.claim_allowed(_pick(_CLAIMS, "c_custkey"), F.when(k % 3 == 0, "verified").otherwise("static"))
    return c.select(k.alias("id"), claim.alias("allowed"), scope["scope"].alias("scope"), scope["error"].alias("error"), access.daily_limit(plan, "public").alias("daily_limit"))


@query("""SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS response FROM region""")
def responses(spark, sf):
    """Rows as response bodies."""
    return access.responses(table(spark, sf, "region"), "r_regionkey", "r_name")


_QUERIES = (("q1", "small steel part"), ("q2", "the Brand tool x"))
_TEXT = "lower(p_type || ' ' || p_name || ' ' || p_brand)"


def _relevance_sql(words) -> str:
    return f"least(100, trunc(({' + '.join(f'contains({_TEXT}, {w!r})::INT' for w in words)}) / {len(words)} * 90)::INT + least(10, floor(p_size * 400 / 5000))::INT)"


@query(
    f"""WITH s AS (SELECT 'q1' AS query, p_partkey AS id, p_size, {_relevance_sql(["small", "steel", "part"])} AS r FROM part UNION ALL SELECT 'q2', p_partkey, p_size, {_relevance_sql(["the", "brand", "tool"])} FROM part),
t AS (SELECT query, id, CASE WHEN p_size % 7 = 0 THEN 0 ELSE r END AS relevance, CASE WHEN p_size % 7 = 0 THEN -1 ELSE least(100, round_even(round_even(0.4 * p_size + 0.6 * r, 6), 0))::INT END AS overall FROM s)
SELECT query, id, relevance::INT AS relevance, overall, row_number() OVER (PARTITION BY query ORDER BY overall DESC, id)::INT AS rank FROM t"""
)
def scored_pool(spark, sf):
    """A pool of candidates under a pack of queries by overlap of terms."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("quality"), (F.col("p_size") % 7 == 0).alias("excluded"), F.col("p_type").alias("description"), F.col("p_name").alias("full_name"), F.array("p_brand").alias("topics"), (F.col("p_size") * 400).alias("stars"))
    return ranking.score_pool(p, list(_QUERIES)).select("query", "id", "relevance", "overall", "rank")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_size % 101 ELSE least(p_size + 8, 100) END::INT AS relevance FROM part")
def model_scores(spark, sf):
    """A model's relevance by candidate, a fallback where it gave none."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_size")
    m = p.filter("id % 2 = 0").select("id", (F.col("p_size") % 101).alias("relevance"))
    return ranking.with_model_scores(p, m, ranking.fallback_relevance(F.col("p_size"), F.lit(1), F.lit(0))).select("id", F.col("relevance").cast("int").alias("relevance"))


@query("SELECT o_orderpriority AS cls, round_even(avg(o_totalprice / 1000000), 6) AS ndcg, round_even(avg(o_custkey % 4 / 3.0::DOUBLE), 6) AS precision, count(*) AS n FROM orders WHERE o_orderkey % 3 > 0 GROUP BY ROLLUP (o_orderpriority)")
def class_means(spark, sf):
    """Means by class and overall, of queries with an ideal set."""
    r = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("cls"), (F.col("o_totalprice") / 1000000).alias("ndcg"), (F.col("o_custkey") % 4 / F.lit(3.0)).alias("precision"), (F.col("o_orderkey") % 3).alias("n_ideal"))
    m = ranking.class_means(r)
    return m.select("cls", F.bround("ndcg", 6).alias("ndcg"), F.bround("precision", 6).alias("precision"), "n")


@query(
    f"""WITH {JOBS}, d AS (SELECT id, status, greatest(0, coalesce(epoch(completed_at)::BIGINT - epoch(started_at)::BIGINT, 0)) AS s FROM jobs)
SELECT id, CASE status WHEN 'queued' THEN 'queue' WHEN 'running' THEN 'analysis' WHEN 'completed' THEN 'complete' ELSE 'failed' END AS phase, CASE status WHEN 'queued' THEN 'waiting' WHEN 'running' THEN CASE WHEN s >= 90 THEN 'slow' ELSE 'collecting' END WHEN 'completed' THEN CASE WHEN s > 0 THEN 'done in ' || s ELSE 'done' END ELSE 'failed' END AS detail FROM d"""
)
def status_phases(spark, sf):
    """Phase and status line of every job."""
    j = _jobs(spark, sf).withColumn("s", access.duration(F.col("started_at"), F.col("completed_at")))
    return j.select("id", access.phase(F.col("status")).alias("phase"), access.status_kind(F.col("status"), F.col("s")).alias("detail"))


@query("SELECT c_custkey AS id, false AS created FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT DISTINCT o_custkey, true FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def get_or_create(spark, sf):
    """Known accounts, and those that orders name first."""
    known = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"))
    return access.get_or_create(known, table(spark, sf, "orders").select(F.col("o_custkey").alias("id")), "id")


@query("WITH a AS (SELECT s_suppkey AS slug, 'supplier' AS kind FROM supplier), b AS (SELECT c_custkey AS slug, 'customer' AS kind FROM customer) SELECT slug, kind FROM a UNION ALL SELECT slug, kind FROM b WHERE slug NOT IN (SELECT slug FROM a)")
def share_slugs(spark, sf):
    """The row of each slug in the first of two tables that has it."""
    rows = lambda t, c, kind: table(spark, sf, t).select(F.col(c).alias("slug"), F.lit(kind).alias("kind"))
    return access.first_of([rows("supplier", "s_suppkey", "supplier"), rows("customer", "c_custkey", "customer")], "slug")


@query("SELECT o_custkey AS id, max(o_orderkey) + 1 AS next_version FROM orders GROUP BY 1")
def next_versions(spark, sf):
    """The next version number of each account."""
    v = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"))
    return ops.next_version(v, "id")


@query("SELECT o_orderkey AS id, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS reused FROM orders")
def result_reuse(spark, sf):
    """Requests that a stored result answers, and the rest."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    hit, miss = ops.reusable(o, table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).distinct(), ["id"])
    return hit.select("id", F.lit(True).alias("reused")).unionByName(miss.select("id", F.lit(False).alias("reused")))


@query("WITH f AS (SELECT l_orderkey AS id, avg(l_discount) AS e FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), g AS (SELECT o_orderkey AS id, avg(o_totalprice / 1000000) AS c FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) SELECT coalesce(f.id, g.id) AS id, round_even(coalesce(e, 0.0), 6) AS extraction, round_even(coalesce(c, 1.0), 6) AS finding FROM f FULL JOIN g ON f.id = g.id")
def mean_confidences(spark, sf):
    """Mean confidences of files and findings with defaults (S-A12)."""
    f = table(spark, sf, "lineitem").filter("l_linenumber <= 3").select(F.col("l_orderkey").alias("id"), F.col("l_discount").alias("confidence"))
    g = table(spark, sf, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000000).alias("confidence"))
    m = findings.mean_confidences(f, g, "id")
    return m.select("id", F.bround("extraction", 6).alias("extraction"), F.bround("finding", 6).alias("finding"))


@query(
    """WITH s AS (SELECT p_partkey AS id, p_size % 13 AS src, p_size % 5 AS tst FROM part)
SELECT id, CASE WHEN src = 0 THEN 50 WHEN tst / src >= 0.4 THEN 95 WHEN tst / src >= 0.25 THEN 80 WHEN tst / src >= 0.1 THEN 60 WHEN tst > 0 THEN 40 ELSE 10 END::INT AS test_score,
  CASE WHEN src = 0 THEN 50 ELSE least(100, trunc(tst / src * 80)::INT + CASE WHEN id % 2 = 0 THEN 20 ELSE 0 END) END::INT AS documentation_score,
  CASE WHEN src = 0 THEN 0.0 ELSE least(0.97, format('{:.3f}', least(tst / src, 1.0::DOUBLE) * 0.45::DOUBLE + 0.9::DOUBLE * 0.40::DOUBLE + (CASE WHEN id % 2 = 0 THEN 0.04::DOUBLE ELSE 0 END + CASE WHEN id % 3 = 0 THEN 0.04::DOUBLE ELSE 0 END + CASE WHEN id % 5 = 0 THEN 0.02::DOUBLE ELSE 0 END))::DOUBLE) END::DOUBLE AS scan_confidence FROM s"""
)
def side_scores(spark, sf):
    """Test and documentation scores and the confidence of a scan (S-A3 to S-A5)."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 13).alias("src"), (F.col("p_size") % 5).alias("tst"))
    by = lambda n: F.col("id") % n == 0
    return p.select("id", findings.test_score(F.try_divide("tst", "src"), F.col("src")).cast("int").alias("test_score"), findings.documentation_score(F.col("tst"), F.col("src"), by(2)).cast("int").alias("documentation_score"), findings.scan_confidence(F.col("tst"), F.col("src"), F.lit(0.9), by(2), by(3), by(5)).cast("double").alias("scan_confidence"))


_CATEGORIES = tuple(fixed.POINTS)
_POINTS_SQL = ", ".join(f"('{c}', '{s}', {v})" for c, by in fixed.POINTS.items() for s, v in by.items())


@query(f"WITH i AS (SELECT {_pick_sql(_CATEGORIES, 'l_partkey')} AS category, {_pick_sql(('critical', 'high', 'medium', 'low', 'odd'), 'l_suppkey')} AS severity FROM lineitem) SELECT i.category, i.severity, coalesce(v, 0)::INT AS points, count(*) AS n FROM i LEFT JOIN (VALUES {_POINTS_SQL}) p(category, severity, v) ON i.category = p.category AND i.severity = p.severity GROUP BY ALL")
def finding_points(spark, sf):
    """Points by category and severity (S-A33)."""
    i = table(spark, sf, "lineitem").select(_pick(_CATEGORIES, "l_partkey").alias("category"), _pick(("critical", "high", "medium", "low", "odd"), "l_suppkey").alias("severity"))
    return i.withColumn("points", findings.points_for(F.col("category"), F.col("severity")).cast("int")).groupBy("category", "severity", "points").agg(F.count(F.lit(1)).alias("n"))


_ISSUES = f"i AS (SELECT DISTINCT l_orderkey AS id, {_pick_sql(('critical', 'high', 'medium', 'low'), 'l_suppkey')} AS severity, 'part ' || l_partkey AS title FROM lineitem)"


def _issues(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), _pick(("critical", "high", "medium", "low"), "l_suppkey").alias("severity"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("title")).distinct()


@query(f"WITH {_ISSUES} SELECT id, arg_min(title, (CASE severity WHEN 'critical' THEN '0' ELSE '1' END) || title) AS top_concern FROM i WHERE severity IN ('critical', 'high') GROUP BY id")
def top_concerns(spark, sf):
    """The first grave finding of each order (S-A22)."""
    return review.top_concern(_issues(spark, sf), ["id"], "title")


@query(f"WITH {_ISSUES}, r AS (SELECT id, title, row_number() OVER (PARTITION BY id ORDER BY CASE severity WHEN 'critical' THEN 0 ELSE 1 END, title) AS rank FROM i WHERE severity IN ('critical', 'high')) SELECT id, title, rank::INT AS rank FROM r WHERE rank <= 3")
def priority_actions(spark, sf):
    """The first three grave findings of each order (2.12)."""
    return review.priority_actions(_issues(spark, sf), ["id"], "title", 3).select("id", "title", "rank")


@query("SELECT p_partkey AS id, p_size >= 25 AND p_size * 2 >= 65 AND p_size * 3 >= 50 AS suitable FROM part")
def production_suitable(spark, sf):
    """Whether scores pass the gate of production (S-A22)."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") >= 25, "solid").otherwise("limited").alias("recommendation"), (F.col("p_size") * 2).alias("security"), (F.col("p_size") * 3).alias("testing"))
    return p.select("id", review.production_suitable().alias("suitable"))


@query("SELECT doc_id, CASE WHEN n_chars >= 1000 THEN format('{:.1f}k', n_chars / 1000.0) ELSE n_chars::VARCHAR END AS short, CASE WHEN doc_id % 5 = 0 THEN 1.0 ELSE greatest(0.3, 1.0 - 0.2 * (doc_id % 5)) END::DOUBLE AS confidence FROM documents")
def short_numbers(spark, sf):
    """Numbers in short form, and confidences by errors."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", C.short_number(F.col("n_chars")).alias("short"), C.file_confidence(F.col("doc_id") % 5).cast("double").alias("confidence"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 < 2 THEN turn END AS score FROM conversations")
def model_replies(spark, sf):
    """Replies' JSON with or without fences around it, null where it is none."""
    body = F.concat(F.lit('{"score":'), F.col("turn").cast("string"), F.lit("}"))
    text = F.when(F.col("turn") % 3 == 0, body).when(F.col("turn") % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise("sorry, no")
    return table(spark, sf, "conversations").select("conv_id", "turn", access.stripped_json(text, "score long")["score"].alias("score"))


@query("SELECT doc_id, length(text) > 20 AND NOT list_has_any(regexp_split_to_array(lower(text), '[ \\t\\n\\v\\f\\r]+'), ['the', 'data', 'safety', 'words']) AS ungrounded FROM documents".replace("\\\\", "\\"))
def ungrounded_risks(spark, sf):
    """Statements that share no word with what was found."""
    return table(spark, sf, "documents").select("doc_id", access.ungrounded(F.col("text"), F.array(F.lit("the-data")), F.array(F.lit("Safety of words"))).alias("ungrounded"))


@query(
    """WITH f AS (SELECT DISTINCT o_custkey AS repo_id, o_orderkey % 4 AS kind FROM orders), g AS (SELECT repo_id, bool_or(kind = 0) AS a, bool_or(kind = 1) AS b, bool_or(kind = 2) AS c, bool_or(kind = 3) AS d FROM f GROUP BY repo_id)
SELECT repo_id, CASE WHEN a THEN 'react,next' ELSE '' END AS npm, array_to_string(list_distinct(list_concat(list_concat(CASE WHEN b THEN ['httpx', 'uvicorn'] ELSE [] END, CASE WHEN c AND NOT b THEN ['fastapi', 'httpx'] WHEN c THEN ['fastapi'] ELSE [] END), CASE WHEN d AND NOT b AND NOT c THEN ['zlib', 'httpx'] WHEN d THEN ['zlib'] ELSE [] END)).list_sort(), ',') AS python FROM g"""
)
def merged_dependencies(spark, sf):
    """Dependencies of all manifests of a repository, of three kinds, each once."""
    texts = (("package.json", '{"dependencies": {"react": "1"}, "devDependencies": {"next": "2", "react": "1"}}'), ("a/pyproject.toml", '[project]\ndependencies = ["httpx>=1", "uvicorn[standard]"]\n'), ("b/requirements.txt", "FastAPI==1\nhttpx\n"), ("c/requirements.txt", "zlib\nhttpx>=2\n"))
    kinds = F.element_at(F.array(*(F.struct(F.lit(p).alias("path"), F.lit(t).alias("content")) for p, t in texts)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    files = table(spark, sf, "orders").select(F.col("o_custkey").alias("repo_id"), kinds.alias("f")).select("repo_id", "f.*").distinct()
    d = repos.merged_dependencies(files)
    return d.select("repo_id", F.array_join("npm", ",").alias("npm"), F.array_join(F.array_sort("python"), ",").alias("python"))


_GUARDED = "(SELECT l_suppkey AS repo_id, CASE WHEN l_linenumber = 3 THEN 'a/.git/x' ELSE 'a/b' END AS path, (l_quantity * 1000)::BIGINT AS size FROM lineitem)"


@query(
    f"""WITH g AS (SELECT repo_id, count(*) AS n, sum(size) AS bytes, repo_id % 3 AS v FROM {_GUARDED} WHERE path = 'a/b' GROUP BY repo_id)
SELECT repo_id, CASE WHEN v = 0 THEN 'Repository has more than 40 files — too large to review' ELSE 'Repository exceeds 1MB size limit' END AS problem FROM g WHERE (v = 0 AND n > 40) OR (v > 0 AND bytes > 1048576)"""
)
def too_large(spark, sf):
    """Repositories that a review refuses for their size (S-A17)."""
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("repo_id"), F.when(F.col("l_linenumber") == 3, "a/.git/x").otherwise("a/b").alias("path"), (F.col("l_quantity") * 1000).cast("long").alias("size"))
    third = F.col("repo_id") % 3 == 0
    return access.size_guard(rows.filter(third), ["repo_id"], 40, 1 << 40).unionByName(access.size_guard(rows.filter(~third), ["repo_id"], 1 << 40, 1 << 20))


@query("""SELECT l_suppkey AS repo_id, l_partkey AS path, l_linenumber AS callers, row_number() OVER (ORDER BY CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_linestatus = 'O' THEN 1 ELSE 2 END, l_linenumber DESC, 'p' || l_partkey || '/' || l_orderkey || '/' || l_suppkey || '/' || l_quantity)::INT AS place FROM lineitem WHERE starts_with('p' || l_partkey, 'p1') QUALIFY place <= 100""")
def files_order(spark, sf):
    """The first files below a path, in the order that they are shown (B8, 2.12)."""
    path = F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit("/"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_suppkey").cast("string"), F.lit("/"), F.col("l_quantity").cast("string"))
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("repo_id"), F.col("l_partkey").alias("part"), path.alias("path"), F.col("l_linenumber").alias("caller_count"), (F.col("l_returnflag") == "R").alias("is_entrypoint"), (F.col("l_linestatus") == "O").alias("is_on_critical_path"))
    shown = access.files_in_order(access.below(rows, "p1")).limit(100)
    order = Window.orderBy(F.when(F.col("is_entrypoint"), 0).when(F.col("is_on_critical_path"), 1).otherwise(2), F.desc("caller_count"), "path")  # of at most 100 rows
    return shown.select("repo_id", F.col("part").alias("path"), F.col("caller_count").alias("callers"), F.row_number().over(order).alias("place"))


_NAMES = ("FastAPI", "React", "Go", "Elixir", "Express", "Next.js")


@query(
    f"""WITH n AS (SELECT p_partkey AS id, {_pick_sql(_NAMES, "p_partkey")} AS b, {_pick_sql(_NAMES, "p_size")} AS f FROM part), m AS (SELECT id, b, f, list_filter(list_transform([b, f], lambda x: CASE x WHEN 'FastAPI' THEN 'python' WHEN 'React' THEN 'node' WHEN 'Go' THEN 'go' WHEN 'Express' THEN 'node' WHEN 'Next.js' THEN 'node' END), lambda x: x IS NOT NULL) AS l FROM n)
SELECT id, CASE WHEN len(l) = 0 THEN 'python' WHEN len(l) = 2 AND l[1] = l[2] THEN l[1] ELSE array_to_string(l, ',') END AS languages, coalesce(CASE b WHEN 'FastAPI' THEN 'fastapi' WHEN 'Express' THEN 'express' WHEN 'Next.js' THEN 'nextjs' END, CASE f WHEN 'FastAPI' THEN 'fastapi' WHEN 'Express' THEN 'express' WHEN 'Next.js' THEN 'nextjs' END, 'unknown') AS framework FROM m"""
)
def stack_languages(spark, sf):
    """Languages and the framework of a stack."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array(_pick(_NAMES, "p_partkey")).alias("b"), F.array(_pick(_NAMES, "p_size")).alias("f"))
    return p.select("id", F.array_join(repos.stack_languages(F.concat("b", "f")), ",").alias("languages"), repos.chosen_framework(F.col("b"), F.col("f"))["framework"].alias("framework"))


@query("SELECT l_orderkey AS id, array_to_string(list_sort(list_distinct(list('m' || l_partkey % 4))), ',') AS manifests, bool_or(l_returnflag = 'R') AS env_example FROM lineitem GROUP BY 1")
def merged_evidence(spark, sf):
    """Evidence of several sources as one (S-A32)."""
    from ..operators import risk

    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.array(F.concat(F.lit("m"), (F.col("l_partkey") % 4).cast("string"))).alias("manifests"), (F.col("l_returnflag") == "R").alias("env_example"))
    return risk.merged_evidence(e, ["id"], ["manifests"], ["env_example"]).select("id", F.array_join("manifests", ",").alias("manifests"), "env_example")


@query(
    """WITH n AS (SELECT l_orderkey AS file, l_linenumber AS line, l_linenumber AS line_end, min(l_partkey) AS ordinal FROM lineitem GROUP BY ALL)
SELECT file, line, line_end, ordinal FROM n WHERE NOT EXISTS (SELECT 1 FROM lineitem k WHERE k.l_orderkey = file AND k.l_linenumber = line AND k.l_returnflag = 'R')"""
)
def new_ranges(spark, sf):
    """Findings whose range is not known yet, the first of each (2.12)."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_linenumber").alias("line_end"), F.col("l_partkey").alias("ordinal"), "l_returnflag")
    return findings.drop_known_ranges(rows.drop("l_returnflag"), rows.filter("l_returnflag = 'R'"))


@query(f"SELECT event_id FROM events WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 7 DAY")
def fresh_cache(spark, sf):
    """Cached entries of the last seven days."""
    return readers.fresh_cache(table(spark, sf, "events").withColumn("written_at", F.col("ts")), F.lit(NOW).cast("timestamp")).select("event_id")


@query(f"WITH f AS {FILES_SQL} SELECT repo_id, path FROM f WHERE path IN ('README.md', 'package.json')")
def priority_files(spark, sf):
    """Files of given names near the root."""
    return readers.priority_files(repo_files(spark, sf), ["README.md", "package.json", "b.ts"], 1).select("repo_id", "path")


@query("SELECT c_name AS full_name, (c_custkey % 50) AS stars, 'github' AS platform FROM customer UNION ALL SELECT s_name, (s_suppkey % 9), 'gitlab' FROM supplier")
def platform_candidates(spark, sf):
    """Two platforms' search results as one table."""
    g = table(spark, sf, "customer").select(F.col("c_name").alias("full_name"), (F.col("c_custkey") % 50).alias("stars"))
    l = table(spark, sf, "supplier").select(F.col("s_name").alias("path_with_namespace"), (F.col("s_suppkey") % 9).alias("star_count"), F.lit(0).alias("forks_count"), F.lit(None).cast("timestamp").alias("last_activity_at"), F.lit(None).cast("string").alias("readme_url"), F.lit("").alias("description"), F.array().cast("array<string>").alias("topics"))  # noqa: E741
    return readers.candidates(g, l).select("full_name", "stars", "platform")
