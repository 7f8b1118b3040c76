"""Queries of reviews and of the service's state: reports, actions, badges, workers and what needs attention."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..catalog import query, spread, table
from ..functions import columns as C
from ..operators import findings, ops, review
from ..sources import readers
from .syntax import _stated, _variant

_SEVERITIES = ("critical", "high", "medium", "low")
_RULES = ("TESTING-001", "TEST-CI-001", "SEC-A", "OPS-B", "DX-C")
_PICK = lambda xs, c: f"[{', '.join(map(repr, xs))}][(({c}) % {len(xs)} + 1)::INT]"
#: Findings of repositories (suppliers), each line one; a repository's order of findings is o.
FINDINGS = f"""(SELECT l_suppkey AS repo_id, {_PICK(_RULES, 'l_partkey')} AS rule_id, {_PICK(_SEVERITIES, 'l_orderkey + l_linenumber')} AS severity, 'fix ' || l_partkey % 9 AS fix,
  CASE WHEN l_linenumber % 2 = 0 THEN -(l_quantity % 9)::INT END AS impact, l_orderkey * 100000000 + l_partkey * 1000 + l_linenumber * 100 + l_quantity::INT AS o FROM lineitem WHERE l_orderkey % 50 = l_suppkey % 7)"""
_SCORES = "SELECT s_suppkey AS repo_id, s_suppkey * 31 % 101 AS security, s_suppkey * 17 % 101 AS testing FROM supplier"


def _findings(spark, sf):
    x = table(spark, sf, "lineitem").filter("l_orderkey % 50 = l_suppkey % 7")
    pick = lambda xs, c: F.element_at(C.strings(xs), (c % len(xs) + 1).cast("int"))
    o = F.col("l_orderkey") * 100_000_000 + F.col("l_partkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity").cast("int")
    return x.select(
        F.col("l_suppkey").alias("repo_id"), pick(_RULES, F.col("l_partkey")).alias("rule_id"), pick(_SEVERITIES, F.col("l_orderkey") + F.col("l_linenumber")).alias("severity"),
        F.concat(F.lit("fix "), (F.col("l_partkey") % 9).cast("string")).alias("fix"), F.when(F.col("l_linenumber") % 2 == 0, -(F.col("l_quantity") % 9).cast("int")).alias("security_impact"), o.alias("o"),
    )


@query(
    f"""WITH f AS (SELECT *, row_number() OVER (ORDER BY repo_id, o) AS n FROM {FINDINGS}), s AS ({_SCORES}),
a AS (SELECT repo_id, arg_min(fix, (rule_id, o)) FILTER (severity = 'critical') AS c, arg_min(fix, (impact, o)) FILTER (severity = 'high' AND impact < 0) AS h,
  coalesce(arg_max(fix, o) FILTER (rule_id = 'TESTING-001'), arg_max(fix, o) FILTER (rule_id = 'TEST-CI-001')) AS t FROM f GROUP BY repo_id),
named AS (SELECT s.repo_id, list_filter([c, CASE WHEN security < 65 THEN h END, CASE WHEN testing < 50 THEN t END], lambda x: x IS NOT NULL) AS acts FROM s LEFT JOIN a ON a.repo_id = s.repo_id),
more AS (SELECT f.repo_id, list(fix ORDER BY o) AS fixes FROM f JOIN named ON named.repo_id = f.repo_id WHERE severity = 'high' AND NOT list_contains(acts, fix) GROUP BY f.repo_id)
SELECT named.repo_id, array_to_string(list_concat(acts, coalesce(fixes, []))[1:3], '; ') AS actions FROM named LEFT JOIN more ON more.repo_id = named.repo_id"""
)
def verdict_flips(spark, sf):
    """Up to three fixes that would move each repository toward production (S-A27)."""
    scores = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("repo_id"), (F.col("s_suppkey") * 31 % 101).alias("security"), (F.col("s_suppkey") * 17 % 101).alias("testing"))
    out = review.flip_actions(_findings(spark, sf), scores, ["repo_id"], "o")
    return out.select("repo_id", F.array_join("actions", "; ").alias("actions"))


_CATEGORY_SQL = " || chr(10) || ".join(f"'| {label} | ' || s_suppkey * {k + 3} % 101 || ' |'" for k, (label, _) in enumerate(fixed.REPORT_CATEGORIES))
_ONE = "chr(10) || '**' || rule_id || ' found** `' || o || '`' || chr(10) || '_s' || impact_text || '_' || chr(10) || '**Why it matters:** w' || chr(10) || '**Fix:** ' || fix || CASE WHEN impact IS NULL THEN '' ELSE chr(10) || '**Evidence:**' || chr(10) || '- `e' || impact || '`' || chr(10) || '- `x`' END"


@query(
    f"""WITH f AS (SELECT *, coalesce(impact::VARCHAR, '-') AS impact_text FROM {FINDINGS}),
g AS (SELECT repo_id, severity, chr(10) || '### ' || upper(left(severity, 1)) || substr(severity, 2) || chr(10) || string_agg({_ONE}, chr(10) ORDER BY o) AS text FROM f GROUP BY repo_id, severity),
h AS (SELECT repo_id, string_agg(text, chr(10) ORDER BY {' + '.join(f"({k} * (severity = '{s}')::INT)" for k, s in enumerate(_SEVERITIES))}) AS text FROM g GROUP BY repo_id)
SELECT s_suppkey AS repo_id, sha256('# Codebase Review: https://x/' || s_suppkey || chr(10) || '> Commit: `c' || s_suppkey || '` · Ruleset: `r1`' || chr(10) || chr(10) || '## Scorecard' || chr(10) || '| Category | Score |' || chr(10) || '|---|---|' || chr(10)
  || {_CATEGORY_SQL} || chr(10) || chr(10) || '## Findings' || coalesce(chr(10) || text, '') || chr(10) || chr(10) || '## Priority Actions' || chr(10) || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE chr(10) || '1. one' || chr(10) || '2. two ' || s_suppkey END) AS digest
FROM supplier LEFT JOIN h ON repo_id = s_suppkey"""
)
def markdown_reports(spark, sf):
    """Digest of every repository's review as a markdown document."""
    f = _findings(spark, sf)
    said = F.struct("o", F.col("o").cast("string").alias("id"), "severity", F.concat("rule_id", F.lit(" found")).alias("title"), F.concat(F.lit("s"), F.coalesce(F.col("security_impact").cast("string"), F.lit("-"))).alias("summary"), F.lit("w").alias("why"), "fix", F.when(F.col("security_impact").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("e"), F.col("security_impact").cast("string")), F.lit("x"))).alias("evidence"))
    of = f.groupBy("repo_id").agg(F.array_sort(F.collect_list(said)).alias("findings"))
    k = F.col("s_suppkey")
    scores = [(k * (n + 3) % 101).alias(c) for n, (_, c) in enumerate(fixed.REPORT_CATEGORIES)]
    reports = table(spark, sf, "supplier").select(k.alias("repo_id"), F.concat(F.lit("https://x/"), k.cast("string")).alias("url"), F.concat(F.lit("c"), k.cast("string")).alias("commit"), F.lit("r1").alias("ruleset"), *scores, F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("one"), F.concat(F.lit("two "), k.cast("string")))).alias("actions"))
    rows = reports.join(of, "repo_id", "left")
    rows = rows.withColumn("findings", F.coalesce("findings", F.array().cast(dict(rows.dtypes)["findings"])))
    return readers.report_markdown(rows, "repo_id").select("repo_id", F.sha2(F.col("markdown").cast("binary"), 256).alias("digest"))


_LANGUAGES = (("a", ("python", "TypeScript")), ("b", ("go",)), ("c", ()), ("d", ("Python", "python", "rust", "docker")))


@query(
    """WITH p AS (SELECT p_partkey AS id, p_size % 40 AS src, p_size % 60 AS files, p_partkey % 4 AS n_tools, p_size % 3 AS n_ok, (p_partkey % 11 + 1) / 13 AS fw, [2, 0, 0, 2][(p_partkey % 4 + 1)::INT] AS sup, [2, 1, 0, 3][(p_partkey % 4 + 1)::INT] AS langs FROM part),
c AS (SELECT *, least(src / greatest(files, 1), 1.0::DOUBLE) AS covered, least(n_ok, n_tools) AS ok FROM p),
s AS (SELECT *, covered * 0.25::DOUBLE + CASE WHEN langs > 0 THEN sup / langs ELSE 0.3::DOUBLE END * 0.25::DOUBLE + CASE WHEN n_tools > 0 THEN ok / n_tools * 0.25::DOUBLE ELSE 0.15::DOUBLE END + fw * 0.25::DOUBLE AS score FROM c)
SELECT id, CASE WHEN score >= 0.75 THEN 'High' WHEN score >= 0.5 THEN 'Medium' ELSE 'Low' END AS label, format('{:.2f}', score)::DOUBLE AS score, (sup + 1)::INT AS packs, ok::INT AS succeeded, (n_tools - ok)::INT AS failed, format('{:.2f}', covered)::DOUBLE AS coverage FROM s"""
)
def confidence_badges(spark, sf):
    """How sure each review is, from the facts it had (S-A23)."""
    k, size = F.col("p_partkey"), F.col("p_size")
    langs = F.element_at(F.array(*(C.strings(x) if x else F.array().cast("array<string>") for _, x in _LANGUAGES)), (k % 4 + 1).cast("int"))
    names = F.slice(C.strings(("ruff", "bandit", "mypy")), F.lit(1), (k % 4).cast("int"))
    tools = F.transform(names, lambda n, i: F.struct(n.alias("tool"), F.when(i < size % 3, "success").otherwise("failed").alias("status")))
    b = review.confidence_badge(size % 40, size % 60, langs, tools, (k % 11 + 1) / 13)
    return spread(table(spark, sf, "part").select("p_partkey", "p_size")).select(k.alias("id"), b.alias("b")).select("id", "b.label", "b.score", F.col("b.rule_packs_applied").alias("packs"), F.col("b.tools_succeeded").alias("succeeded"), F.col("b.tools_failed").alias("failed"), F.col("b.coverage_pct").alias("coverage"))


@query(
    """WITH b AS (SELECT user_id, max(ts) AS seen FROM events GROUP BY user_id), w AS (SELECT user_id, user_id % 4 > 0 AND greatest(0, floor(epoch(TIMESTAMP '2024-01-31 00:00:00')) - floor(epoch(seen))) < 86400 AS fresh FROM b),
q AS (SELECT DISTINCT unnest(CASE WHEN user_id % 2 = 0 THEN ['x', 'q' || user_id % 5] ELSE ['y'] END) AS q FROM w WHERE fresh)
SELECT CASE WHEN count(*) FILTER (fresh) > 0 THEN 'ok' WHEN count(*) > 0 THEN 'stale' ELSE 'missing' END AS status, count(*) FILTER (fresh) AS fresh_count, count(*) FILTER (NOT fresh) AS stale_count, coalesce((SELECT string_agg(q, ',' ORDER BY q) FROM q), '') AS active_queues FROM w"""
)
def worker_states(spark, sf):
    """Fresh and stale workers and the queues they serve."""
    u = F.col("user_id")
    beats = table(spark, sf, "events").select(u.alias("worker_id"), F.col("ts").alias("last_seen_at"), F.when(u % 4 > 0, "running").otherwise("stopped").alias("status"), F.when(u % 2 == 0, F.concat(F.lit("x, ,q"), (u % 5).cast("string"))).otherwise("y").alias("queues"))
    s = ops.worker_summary(ops.worker_status(beats, F.lit("2024-01-31 00:00:00").cast("timestamp"), 86_400))
    return s.select("status", "fresh_count", "stale_count", F.array_join("active_queues", ",").alias("active_queues"))


@query(
    f"""WITH h AS (SELECT c_custkey AS id, c_custkey % 3 AS qa, c_custkey % 5 AS qb, c_custkey % 2 AS ra, (c_custkey // 2) % 2 AS rb, c_custkey * 7 % 1000 AS old, c_custkey * 13 % 4000 AS ran, c_custkey % 4 AS failed, c_custkey % 7 = 0 AS serves, c_custkey % 10 > 0 AS ok FROM customer),
s AS (SELECT *, qa > 0 AND ra = 0 AND old >= 600 AS sa, qb > 0 AND rb = 0 AND old >= 600 AS sb, ran >= 3600 AS la, old * 4 >= 3600 AS lb FROM h),
m AS (SELECT *, CASE WHEN (sa AND NOT serves) OR sb THEN replace('{fixed.NO_WORKER}', '{{}}', CASE WHEN sa AND NOT serves AND sb THEN 'One and Two' WHEN sb THEN 'Two' ELSE 'One' END)
  WHEN sa THEN replace('{fixed.IDLE_WORKER}', '{{}}', 'One') WHEN la OR lb THEN replace('{fixed.SLOW_WORKER}', '{{}}', CASE WHEN la AND lb THEN 'One and Two' WHEN la THEN 'One' ELSE 'Two' END) END AS attention FROM s)
SELECT id, attention, CASE WHEN NOT ok OR failed >= 3 OR attention IS NOT NULL THEN 'watch' WHEN ra + rb > 0 OR qa + qb > 0 THEN 'active' ELSE 'steady' END AS status FROM m"""
)
def overall_status(spark, sf):
    """What needs attention, and the status of the service, for a service a customer."""
    k = F.col("c_custkey")
    queue = lambda name, q, queued, running, ran: F.struct(F.lit(name).alias("name"), F.lit(q).alias("queue"), queued.alias("queued"), running.alias("running"), (k * 7 % 1000).alias("oldest_queued"), ran.alias("oldest_running"), (k % 4 if q == "a" else F.lit(0).cast("long")).alias("failed_recent"))
    queues = F.array(queue("One", "a", k % 3, k % 2, k * 13 % 4000), queue("Two", "b", k % 5, F.floor(k / 2) % 2, k * 7 % 1000 * 4))
    active = F.when(k % 7 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf, "customer").select(k.alias("id"), queues.alias("q"), active.alias("w"), (k % 10 > 0).alias("ok"))
    rows = rows.withColumn("attention", ops.attention(F.col("q"), F.col("w"), 600, 3600))
    return rows.select("id", "attention", ops.overall_status(F.col("q"), F.col("attention"), F.col("ok")).alias("status"))


#: Searches, and the repository that each names exactly.
SEARCHES = (
    ("https://github.com/a~/b", ("a~/b",)), ("  www.github.com/a~/b.git/issues?x=1#y/ ", ("a~/b",)), ("repo: a~/b.c", ("a~/b.c",)), ("a~/b.git", ("a~/b",)), ("a~  b_", ("a~/b_",)), ("https://gitlab.com/a~/b", ()),
    ("-a~/b", ()), ("a~", ()), ("a~/b/c", ()), ("small steel tool ~", ()), ("/", ()), ("http://GitHub.com/a~", ()), ("github.com/a~/b;v=1", ("a~/b",)),
)


@query(f"SELECT id, unnest({_stated(SEARCHES, 'id', 'id')}) AS repo FROM (SELECT c_custkey AS id FROM customer)")
def exact_repositories(spark, sf):
    """The repository that a search names, where it names one."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    found = rows.select("id", C.exact_repo(_variant(SEARCHES, "id", "id")).alias("r")).filter("r is not null")
    return found.select("id", F.concat("r.owner", F.lit("/"), "r.repo").alias("repo"))


ADDRESSES = (("https://github.com/a/b~", ("a/b~",)), ("git@host.org:a~/b.git", ("a~/b",)), ("https://gitlab.com/x/y~.git/", ("x/y~",)), ("nothing ~", ()))


@query(f"SELECT id, unnest({_stated(ADDRESSES, 'id', 'id')}) AS repo FROM (SELECT c_custkey AS id FROM customer)")
def repo_urls(spark, sf):
    """Owner and repository of addresses."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    found = rows.select("id", C.repo_of_url(_variant(ADDRESSES, "id", "id")).alias("r")).filter("r.owner is not null")
    return found.select("id", F.concat("r.owner", F.lit("/"), "r.repo").alias("repo"))


@query("SELECT o_orderkey AS id, least(0.97, format('{:.3f}', 0.4::DOUBLE * (o_orderkey % 11 / 11) + 0.35::DOUBLE * (o_custkey % 9 / 9) + 0.25::DOUBLE * (o_orderkey % 7 / 7))::DOUBLE)::DOUBLE AS overall FROM orders")
def blended_confidences(spark, sf):
    """Blended confidence of every scan (S-A11)."""
    b = findings.blended_confidence(F.col("o_orderkey") % 11 / 11, F.col("o_custkey") % 9 / 9, F.col("o_orderkey") % 7 / 7)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), b["overall"].alias("overall"))
