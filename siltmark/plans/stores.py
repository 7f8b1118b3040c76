"""Queries of what is written and read back, and of accessors to stored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query, table
from ..functions import columns as C
from ..operators import access, ops, ranking, repos
from ..operators.cut import shared_folder
from ..sources import readers, sinks
from .records import JOBS, _jobs
from .syntax import _stated, _variant


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def decoded_contents(spark, sf):
    """Whole texts from base64 with line breaks in it (A3)."""
    d = table(spark, sf, "documents")
    wire = F.regexp_replace(F.base64(F.col("text").cast("binary")), "(.{60})", "$1\n")
    return d.select("doc_id", wire.alias("content")).select("doc_id", F.sha2(readers.decoded(F.col("content")).cast("binary"), 256).alias("digest"))


@query("SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS fetch_error, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence FROM orders")
def fetch_errors(spark, sf):
    """Files of a tree with and without content (A5)."""
    tree = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return readers.with_fetch_errors(tree, tree.filter("id % 3 > 0").withColumn("content", F.lit("x")), ["id"]).select("id", "fetch_error", "confidence")


LANGUAGES = (("Python", ("ruff,bandit,pip-audit,gitleaks",)), ("TypeScript,Docker", ("eslint,npm-audit,hadolint,gitleaks",)), ("Go", ("gitleaks",)), ("", ("gitleaks",)), ("python,JavaScript", ("ruff,bandit,pip-audit,eslint,npm-audit,gitleaks",)))


@query(f"SELECT id, unnest({_stated(LANGUAGES, 'id', 'id')}) AS tools FROM (SELECT p_partkey AS id FROM part)")
def tool_adapters(spark, sf):
    """Tools that run for a repository's languages."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return rows.select("id", F.array_join(readers.adapters_for(F.split(_variant(LANGUAGES, "id", "id"), ",")), ",").alias("tools"))


@query("""SELECT c_custkey AS id, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}' AS payload, true AS sealed FROM customer""")
def sealed_payloads(spark, sf):
    """Payloads encrypted and read again."""
    secret = F.lit("0123456789abcdef")
    rows = table(spark, sf, "customer").select("c_custkey", readers.encrypted(F.struct("c_custkey", "c_name"), secret).alias("s"))
    return rows.select(F.col("c_custkey").alias("id"), readers.decrypted(F.col("s"), secret).alias("payload"), (~F.contains("s", F.lit("c_name"))).alias("sealed"))


@query("SELECT event_type AS stage, 2 * count(*) AS calls, 2 * sum(event_id)::BIGINT AS tokens FROM events GROUP BY event_type")
def usage_log(spark, sf):
    """Usage appended twice and read back by stage."""
    calls = table(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("event_id").alias("tokens"))
    path = shared_folder(spark) + "/usage"
    for _ in range(2):
        sinks.append_usage(calls, path)
    return spark.read.schema("tokens long, stage string").parquet(path).groupBy("stage").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"))


MADE = (("a/package-lock~.json", ("no",)), ("x~/yarn.lock", ("yes",)), ("p~/gen/a.py", ("yes",)), ("p~/gen.py", ("no",)), ("q/x~_pb2.py", ("yes",)), ("q/App~.MIN.js", ("yes",)), ("types~.d.ts", ("yes",)), ("dist~/a.js", ("no",)), ("out/b~.go", ("yes",)))


@query(f"SELECT id, unnest({_stated(MADE, 'id', 'id')}) AS generated FROM (SELECT p_partkey AS id FROM part)")
def generated_files(spark, sf):
    """Files that are made and not written, by path (B2)."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return rows.select("id", F.when(C.is_generated(_variant(MADE, "id", "id")), "yes").otherwise("no").alias("generated"))


@query("SELECT l_suppkey AS repo_id, count(*) AS n FROM lineitem WHERE CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END IS DISTINCT FROM true GROUP BY l_suppkey")
def open_findings(spark, sf):
    """Findings that are not suppressed, by repository."""
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("repo_id"), F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False).alias("is_suppressed"))
    return access.unsuppressed(rows).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT 'role' AS accessor, o_orderkey AS path FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'entry', o_orderkey FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT 'risk', o_orderkey FROM orders WHERE o_orderkey % 4 > 0
UNION ALL SELECT 'critical', o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"""
)
def scan_accessors(spark, sf):
    """Files by role, entry points, files with sensitive operations and files on a critical path."""
    k = F.col("o_orderkey")
    f = table(spark, sf, "orders").select(k.alias("path"), F.col("o_orderstatus").alias("role"), (k % 5 == 0).alias("is_entrypoint"), F.array_repeat(F.lit("x"), (k % 4).cast("int")).alias("sensitive_ops"))
    on_path = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"), (F.col("l_returnflag") == "R").alias("is_on_critical_path"))
    found = {"role": access.by_role(f, "F"), "entry": access.entrypoints(f), "risk": access.high_risk(f), "critical": access.critical(f, on_path, ["path"])}
    out = None
    for name, rows in found.items():
        mine = rows.select(F.lit(name).alias("accessor"), "path")
        out = mine if out is None else out.unionByName(mine)
    return out


@query("SELECT o_orderkey AS id, floor((epoch(TIMESTAMP '1998-08-02 12:00:00') - epoch(o_orderdate)) / 86400)::BIGINT AS days FROM orders")
def repo_ages(spark, sf):
    """Age in whole days."""
    now = F.lit("1998-08-02 12:00:00").cast("timestamp")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), ranking.age_days(F.col("o_orderdate").cast("timestamp"), now).alias("days"))


@query("SELECT p_partkey AS id, greatest(0.0, round_even(least((p_size % 6) * 0.2::DOUBLE + 0.2::DOUBLE, 1.0) - (p_partkey % 4) * 0.1::DOUBLE, 2))::DOUBLE AS confidence FROM part")
def section_confidences(spark, sf):
    """Confidence of a section by what was found and what failed (S-A31)."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), repos.section_confidence(F.col("p_size") % 6, F.col("p_partkey") % 4).alias("confidence"))


@query(f"WITH {JOBS} SELECT id, created_at FROM jobs WHERE status = 'queued'")
def stored_jobs(spark, sf):
    """Queued jobs read from the layout that claims read."""
    path = shared_folder(spark) + "/jobs"
    sinks.write_jobs(_jobs(spark, sf), path)
    return spark.read.parquet(path).filter("status = 'queued'").select("id", "created_at")


@query("WITH f AS (SELECT event_id AS id, ts FROM events WHERE event_type = 'click' AND user_id = 3) SELECT id, ts, (SELECT count(*) FROM f) AS total FROM f ORDER BY ts DESC, id LIMIT 20 OFFSET 2")
def audit_by_user(spark, sf):
    """A page of one user's actions of a kind, with their number."""
    log = table(spark, sf, "events").select(F.col("event_id").alias("id"), "ts", "event_type", "user_id")
    return ops.audit(log, 20, 2, event_type="click", user_id=3).select("id", "ts", "total")


@query(
    f"""WITH {JOBS}, a AS (SELECT 'analysis' AS kind, id, completed_at, 'job ' || id AS message FROM jobs WHERE status = 'failed' AND id % 2 = 0), b AS (SELECT 'review' AS kind, id, completed_at, 'customer ' || repo_id AS message FROM jobs WHERE status = 'failed' AND id % 2 = 1)
SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY completed_at DESC, kind, id LIMIT 12"""
)
def newest_failures(spark, sf):
    """The newest failures of two kinds of jobs together."""
    failed = _jobs(spark, sf).filter("status = 'failed'")
    said = lambda head, c: F.concat(F.lit(head), F.col(c).cast("string")).alias("message")
    kinds = {"analysis": failed.filter("id % 2 = 0").select("id", "completed_at", said("job ", "id")), "review": failed.filter("id % 2 = 1").select("id", "completed_at", said("customer ", "repo_id"))}
    return ops.newest(kinds, 12)


@query(
    f"""WITH {JOBS}, c AS (SELECT id, id % 3 AS worker FROM jobs WHERE id % 4 < 2 UNION ALL SELECT id, 1 + id % 3 FROM jobs WHERE id % 8 = 0)
SELECT c.id, worker, status = 'queued' AND worker = min(worker) OVER (PARTITION BY c.id) AS held FROM c JOIN jobs ON jobs.id = c.id"""
)
def claim_results(spark, sf):
    """Claims made on an older view of the queue, and whether they hold against the jobs as they are."""
    jobs = _jobs(spark, sf)
    claims = jobs.filter("id % 4 < 2").select("id", (F.col("id") % 3).alias("worker")).unionByName(jobs.filter("id % 8 = 0").select("id", (1 + F.col("id") % 3).alias("worker")))
    return ops.apply_claims(jobs, claims, F.lit("1998-08-02 00:00:00").cast("timestamp"))[1].select("id", "worker", "held")


@query(f"WITH {JOBS}, c AS (SELECT DISTINCT id FROM jobs WHERE id % 4 < 2) SELECT jobs.id, CASE WHEN c.id IS NOT NULL AND status = 'queued' THEN 'running' ELSE status END AS status FROM jobs LEFT JOIN c ON c.id = jobs.id")
def claimed_jobs(spark, sf):
    """The jobs after the claims that hold."""
    jobs = _jobs(spark, sf)
    claims = jobs.filter("id % 4 < 2").select("id", (F.col("id") % 3).alias("worker"))
    return ops.apply_claims(jobs, claims, F.lit("1998-08-02 00:00:00").cast("timestamp"))[0].select("id", "status")
