"""Queries of addresses, summaries of repositories, causes and expired entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query, spread, table
from ..functions import columns as C
from ..operators import access, ops
from ..sources import readers
from .syntax import _stated, _variant

#: Addresses, and what the three readings of one make of them: canonical, https, loose.
ADDRESSES = (
    ("https://github.com/a~/b", ("c a~/b", "h a~/b", "l a~/b")), (" github.com/a~/b.git/ ", ("c a~/b", "l a~/b.git")), ("http://www.github.com/a~/b/tree/main?x#y", ("c a~/b", "l http:/")), ("https://github.com/a~/b.git?tab=1", ("c a~/b", "h a~/b", "l a~/b.git?tab=1")),
    ("https://github.com/orgs/b~", ("h orgs/b~", "l orgs/b~")), ("a~/b/c", ("l a~/b",)), ("https://gitlab.com/a~/b", ("l https:/",)), ("github.com/a~", ()), ("https://github.com/-a~/b", ("h -a~/b", "l -a~/b")),
)


@query(f"SELECT id, unnest({_stated(ADDRESSES, 'id', 'id')}) AS said FROM (SELECT c_custkey AS id FROM customer)")
def normalised_addresses(spark, sf):
    """Repositories of addresses, by each of three readings."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).withColumn("u", _variant(ADDRESSES, "id", "id"))
    u = F.col("u")
    c, h, low = C.canonical_repo(u), C.https_repo(u), C.loose_repo(u)
    said = F.array(F.when(c.isNotNull(), F.concat(F.lit("c "), c["owner"], F.lit("/"), c["name"])), F.when(h.isNotNull(), F.concat(F.lit("h "), h["owner"], F.lit("/"), h["repo"])), F.when(low.isNotNull(), F.concat(F.lit("l "), low["owner"], F.lit("/"), low["repo"])))
    return rows.select("id", F.explode(F.array_compact(said)).alias("said"))


_FILES = "(SELECT l_suppkey AS repo_id, 'f' || l_orderkey || '_' || l_linenumber || '_' || l_partkey AS path, ['python', 'go', 'unknown', 'rust'][(l_partkey % 4 + 1)::INT] AS language, l_partkey % 12 AS s, l_linenumber = 1 AS entry, l_returnflag = 'R' AS risky FROM lineitem)"


@query(
    f"""WITH f AS (SELECT DISTINCT * FROM {_FILES}), l AS (SELECT repo_id, language, count(*) AS n, min(path) AS o FROM f WHERE language <> 'unknown' GROUP BY repo_id, language), lang AS (SELECT repo_id, arg_min(language, (-n, o)) AS primary_language FROM l GROUP BY repo_id),
g AS (SELECT repo_id, path, 1 AS pos, 's' || s AS item FROM f UNION ALL SELECT repo_id, path, 2, 't' || s % 5 FROM f), h AS (SELECT repo_id, item, count(*) AS n, min((path, pos)) AS o FROM g GROUP BY repo_id, item),
top AS (SELECT repo_id, list(item ORDER BY n DESC, o)[1:10] AS signals FROM h GROUP BY repo_id),
e AS (SELECT repo_id, count(*) AS total_files, list(path ORDER BY path) FILTER (entry) AS entries, list(path ORDER BY path) FILTER (risky) AS risky FROM f GROUP BY repo_id)
SELECT e.repo_id, total_files, primary_language, array_to_string(signals, ',') AS signals, coalesce(array_to_string(entries[1:5], ','), '') AS entries, coalesce(array_to_string(risky[1:10], ','), '') AS risky
FROM e JOIN lang ON lang.repo_id = e.repo_id JOIN top ON top.repo_id = e.repo_id"""
)
def repo_summaries(spark, sf):
    """What each repository is, in short (S-A13, S-A14)."""
    s = lambda c: F.col(c).cast("string")
    path = F.concat(F.lit("f"), s("l_orderkey"), F.lit("_"), s("l_linenumber"), F.lit("_"), s("l_partkey"))
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("repo_id"), path.alias("path"), F.element_at(C.strings(("python", "go", "unknown", "rust")), (F.col("l_partkey") % 4 + 1).cast("int")).alias("language"),
        F.array(F.concat(F.lit("s"), (F.col("l_partkey") % 12).cast("string")), F.concat(F.lit("t"), (F.col("l_partkey") % 12 % 5).cast("string"))).alias("framework_signals"),
        (F.col("l_linenumber") == 1).alias("is_entrypoint"), F.when(F.col("l_returnflag") == "R", F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("sensitive_ops"),
    ).distinct()
    out = access.repo_summary(rows)
    return out.select("repo_id", "total_files", "primary_language", F.array_join("framework_signals", ",").alias("signals"), F.array_join("entrypoints", ",").alias("entries"), F.array_join("high_risk_files", ",").alias("risky"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 AND c_custkey % 2 = 0 THEN 'one_worker_inactive' WHEN c_custkey % 5 > 0 AND c_custkey % 7 = 0 THEN 'two_worker_inactive' ELSE 'worker_capacity_saturated' END AS cause FROM customer")
def root_causes(spark, sf):
    """Why queued jobs expired."""
    k = F.col("c_custkey")
    queue = lambda name, cleared, running: F.struct(F.lit(name).alias("name"), cleared.alias("cleared"), running.alias("running"))
    return table(spark, sf, "customer").select(k.alias("id"), ops.root_cause(F.array(queue("one", k % 3, k % 2), queue("two", k % 5, k % 7))).alias("cause"))


@query("SELECT count(*) AS pruned FROM events WHERE ts <= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY")
def pruned_cache(spark, sf):
    """How many cached entries pruning deletes."""
    rows = table(spark, sf, "events").withColumn("written_at", F.col("ts"))
    return readers.expired_cache(rows, F.lit("2024-01-31 00:00:00").cast("timestamp")).agg(F.count(F.lit(1)).alias("pruned"))


_GOOD = '{"category": "security", "severity": "high", "line_start": 3, "line_end": 4, "evidence_snippet": "x~", "title": "t~", "explanation": "e"}'
#: Replies, and the findings in them that are valid: position, category, severity, lines, title, points.
REPLIES = (
    (f"[{_GOOD}]", ("0 security high 3-4 t~ -15",)), (f"```json\n[{_GOOD}]\n```", ("0 security high 3-4 t~ -15",)), (f"```\n[{_GOOD}]", ("0 security high 3-4 t~ -15",)), (f"{_GOOD}", ()), ("sorry ~", ()), ("[1, null, \"x\"]", ()), (f'[7, "x", {_GOOD}]', ("2 security high 3-4 t~ -15",)),
    ('[' + _GOOD.replace('"line_end": 4', '"line_end": 2') + ', ' + _GOOD.replace('"line_start": 3', '"line_start": 0') + ', ' + _GOOD.replace("security", "dead_code").replace("high", "low") + ']', ("2 dead_code low 3-4 t~ -1",)),
    ('[' + _GOOD.replace('"x~"', '"  "') + ', ' + _GOOD.replace("high", "info") + ', ' + _GOOD.replace("security", "style") + ', ' + _GOOD.replace(', "explanation": "e"', "") + ', ' + _GOOD.replace("3,", '"3",') + ']', ("4 security high 3-4 t~ -15",)),
)


@query(f"SELECT id, unnest({_stated(REPLIES, 'id', 'id')}) AS finding FROM (SELECT p_partkey AS id FROM part)")
def model_findings(spark, sf):
    """Valid findings of a model's replies, each reply fenced, malformed or right."""
    rows = spread(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("file")))
    f = access.model_findings(rows.withColumn("reply", _variant(REPLIES, "id", "id")), "reply", "file")
    lines = F.concat_ws("-", F.col("line_start").cast("string"), F.col("line_end").cast("string"))
    return f.select("id", F.concat_ws(" ", F.col("pos").cast("string"), "category", "severity", lines, "title", F.col("score_impact").cast("string")).alias("finding"))
