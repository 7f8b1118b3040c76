"""Queries over events, orders, line items and parts, which stand for jobs, usage, penalties and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import fixed
from ..catalog import query, table
from ..functions import columns as C
from ..operators import limits, graph, ops, ranking, review

NOW = "2024-01-31 00:00:00"
JOB_NOW = "1998-08-02 00:00:00"


def _now(x: str = NOW):
    return F.lit(x).cast("timestamp")


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as jobs: open ones queued, pending ones running, filled ones completed a while later or failed."""
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderkey") % 7 == 0, "failed").otherwise("completed")
    took = F.make_dt_interval(secs=(F.col("o_orderkey") % 4000).cast("decimal(18,6)"))
    ended = status.isin("failed", "completed")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.col("o_custkey").alias("repo_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("started_at"), F.when(ended, F.col("o_orderdate") + took).alias("completed_at"))


JOBS = """j AS (SELECT o_orderkey AS id, o_orderpriority AS kind, o_custkey AS repo_id, CASE WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'running' WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE 'completed' END AS status,
  o_orderdate::TIMESTAMP AS created_at, o_orderdate::TIMESTAMP AS started_at FROM orders),
jobs AS (SELECT *, CASE WHEN status IN ('failed', 'completed') THEN created_at + to_seconds(id % 4000) END AS completed_at FROM j)"""


@query(
    f"""WITH {JOBS} SELECT kind, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'running') AS running,
  count(*) FILTER (status = 'completed' AND completed_at >= TIMESTAMP '{JOB_NOW}' - INTERVAL 8760 HOUR) AS completed_recent, count(*) FILTER (status = 'failed' AND completed_at >= TIMESTAMP '{JOB_NOW}' - INTERVAL 8760 HOUR) AS failed_recent,
  floor(avg(epoch(completed_at) - epoch(started_at)) FILTER (status = 'completed' AND completed_at >= TIMESTAMP '{JOB_NOW}' - INTERVAL 8760 HOUR))::BIGINT AS mean_seconds,
  greatest(0, epoch(TIMESTAMP '{JOB_NOW}') - min(epoch(created_at)) FILTER (status = 'queued'))::BIGINT AS oldest_queued,
  CASE WHEN count(*) FILTER (status = 'running') > 0 THEN greatest(0, epoch(TIMESTAMP '{JOB_NOW}') - min(epoch(started_at)) FILTER (status = 'running'))::BIGINT ELSE 0 END AS oldest_running FROM jobs GROUP BY kind"""
)
def queue_metrics(spark, sf):
    """Queue metrics by kind over a year's window."""
    m = ops.queue_metrics(_jobs(spark, sf), _now(JOB_NOW), ["kind"], hours=8760)
    return m.withColumn("oldest_running", F.coalesce("oldest_running", F.lit(0))).withColumn("oldest_queued", F.coalesce("oldest_queued", F.lit(0)))


@query(f"WITH {JOBS} SELECT id, kind, created_at FROM jobs WHERE status = 'queued' ORDER BY created_at, id LIMIT 5")
def oldest_queued(spark, sf):
    """The five oldest queued jobs (T4)."""
    return _jobs(spark, sf).filter("status = 'queued'").orderBy(F.asc_nulls_last("created_at"), "id").limit(5).select("id", "kind", "created_at")


@query(
    f"""WITH {JOBS}, f AS (SELECT id, repo_id, completed_at, coalesce('customer ' || c_name, 'unknown') AS message FROM jobs LEFT JOIN customer ON repo_id = c_custkey WHERE status = 'failed')
SELECT id, message, completed_at FROM f ORDER BY completed_at DESC, id LIMIT 5"""
)
def recent_failures(spark, sf):
    """The five newest failures with a message looked up (T5)."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("repo_id"), F.concat(F.lit("customer "), "c_name").alias("m"))
    f = _jobs(spark, sf).filter("status = 'failed'").join(c, "repo_id", "left")
    return f.select("id", F.coalesce("m", F.lit("unknown")).alias("message"), "completed_at").orderBy(F.desc("completed_at"), "id").limit(5)


@query(
    f"""WITH {JOBS} SELECT id, c_name, n_name, r_name, created_at FROM jobs JOIN customer ON repo_id = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE status = 'completed' ORDER BY created_at DESC, id LIMIT 20"""
)
def recent_runs(spark, sf):
    """The newest runs with what they belong to."""
    j = _jobs(spark, sf).filter("status = 'completed'").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("repo_id"), "c_name", "c_nationkey"), "repo_id")
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    j = j.join(n, j.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select("id", "c_name", "n_name", "r_name", "created_at").orderBy(F.desc("created_at"), "id").limit(20)


@query(f"WITH {JOBS} SELECT id, row_number() OVER (ORDER BY created_at, id)::INT AS slot FROM (SELECT * FROM jobs WHERE status = 'queued' ORDER BY created_at, id LIMIT 8)")
def job_claims(spark, sf):
    """The oldest queued jobs dealt to eight slots."""
    return ops.claim(_jobs(spark, sf), 8).select("id", "slot")


@query(
    f"""WITH {JOBS} SELECT id, CASE WHEN status = 'running' AND epoch(TIMESTAMP '{JOB_NOW}') - epoch(started_at) > 1800 THEN 'failed' WHEN status = 'queued' AND epoch(TIMESTAMP '{JOB_NOW}') - epoch(created_at) > 180 THEN 'failed' ELSE status END AS status,
  CASE WHEN status = 'running' AND epoch(TIMESTAMP '{JOB_NOW}') - epoch(started_at) > 1800 THEN 'stale running job' WHEN status = 'queued' AND epoch(TIMESTAMP '{JOB_NOW}') - epoch(created_at) > 180 THEN 'expired in queue' END AS reason FROM jobs"""
)
def job_expiry(spark, sf):
    """Every job after recovery of stale and expired ones."""
    return ops.expire(_jobs(spark, sf), _now(JOB_NOW)).select("id", "status", "reason")


def _calls(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.col("ts").alias("created_at"), "user_id", F.col("event_type").alias("stage"), F.get_json_object("props", "$.k").cast("long").alias("input_tokens"), F.col("event_id").alias("output_tokens"), F.floor("value").cast("long").alias("duration_ms"))


@query(
    f"""WITH c AS (SELECT event_type AS stage, (props->>'$.k')::BIGINT AS i, event_id AS o, floor(value)::BIGINT AS ms FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 240 HOUR)
SELECT stage, count(*) AS calls, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, round_even((sum(i) * 3.0::DOUBLE + sum(o) * 15.0::DOUBLE) / 1e6, 4) AS cost_usd, floor(sum(ms) / count(*))::BIGINT AS mean_ms FROM c GROUP BY ROLLUP (stage)"""
)
def usage_by_stage(spark, sf):
    """Usage by stage and in all over ten days."""
    return ops.usage(_calls(spark, sf), _now(), 240)


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest_event(spark, sf):
    """The newest event of each user."""
    return ops.latest(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", "event_id").select("user_id", "event_type", "ts")


@query(
    f"""WITH b AS (SELECT user_id AS worker_id, arg_max(event_type, (ts, event_id)) AS e, max(ts) AS seen FROM events GROUP BY user_id)
SELECT worker_id, greatest(0, floor(epoch(TIMESTAMP '{NOW}')) - floor(epoch(seen)))::BIGINT AS age_seconds, (e <> 'error' AND floor(epoch(TIMESTAMP '{NOW}')) - floor(epoch(seen)) < 86400) AS fresh FROM b"""
)
def worker_freshness(spark, sf):
    """Age and freshness of each worker's newest beat."""
    b = table(spark, sf, "events").select(F.col("user_id").alias("worker_id"), F.col("ts").alias("last_seen_at"), "event_id", F.when(F.col("event_type") == "error", "stopped").otherwise("running").alias("status"), F.lit("a, b").alias("queues"))
    b = ops.latest(b, ["worker_id"], "last_seen_at", "event_id")
    return ops.worker_status(b, _now(), 86400).select("worker_id", "age_seconds", "fresh")


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999' SECOND PRECEDING AND CURRENT ROW) AS in_window FROM events")
def sliding_requests(spark, sf):
    """Requests of a user in the hour up to each."""
    return ops.sliding_counts(table(spark, sf, "events"), "user_id", "ts", 3600).select("event_id", "user_id", "in_window")


@query("SELECT user_id, ts::DATE AS day, count(*) AS used, greatest(0, 3 - count(*)) AS remaining, count(*) > 3 AS exceeded FROM events GROUP BY user_id, ts::DATE")
def daily_quota(spark, sf):
    """Used and left of each user's day."""
    return ops.daily_quota(table(spark, sf, "events"), "user_id", "ts", 3)


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r(user_id, event_id, n, u, kept, allowed, retry_after) AS (SELECT user_id, event_id, n, u, [u], true, 0::BIGINT FROM e WHERE n = 1
UNION ALL SELECT user_id, event_id, n, u, CASE WHEN NOT fast AND NOT full_day THEN list_append(live, u) ELSE live END, NOT fast AND NOT full_day,
  CASE WHEN fast THEN greatest(1, (live[-3] + 3600000000 - u) // 1000000) WHEN full_day THEN greatest(1, (live[1] + 86400000000 - u) // 1000000) ELSE 0 END
  FROM (SELECT *, len(list_filter(live, lambda x: x > u - 3600000000)) >= 3 AS fast, len(live) >= 10 AS full_day
    FROM (SELECT e.*, list_filter(r.kept, lambda x: x > e.u - 86400000000) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)))
SELECT user_id::VARCHAR AS key, event_id, u / 1000000 AS t, allowed, retry_after::INT AS retry_after FROM r"""
)
def rate_limit_replay(spark, sf):
    """Requests allowed by a burst and a daily limit, replayed in order."""
    return limits.rate_limited(table(spark, sf, "events"), "user_id", "ts", limits.Limit(3, 3600, 10), tie="event_id")


@query("SELECT event_id, event_type, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 25 OFFSET 5")
def audit_page(spark, sf):
    """A page of one action's log, newest first."""
    return table(spark, sf, "events").filter("event_type = 'error'").orderBy(F.desc("ts"), "event_id").offset(5).limit(25).select("event_id", "event_type", "ts")


def _impacts(spark, sf):
    x = table(spark, sf, "lineitem")
    domain = F.element_at(C.strings(tuple(fixed.REVIEW_WEIGHTS)), (F.col("l_linenumber") % 6 + 1).cast("int"))
    severity = F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "medium").otherwise("low")
    return x.select(F.col("l_suppkey").alias("repo_id"), domain.alias("domain"), F.concat("l_shipmode" if "l_shipmode" in x.columns else "l_linestatus", F.col("l_partkey") % 5).alias("rule_id"), severity.alias("severity"), (-F.floor(F.col("l_quantity") % 9)).cast("int").alias("impact"))


_DOMAINS = "[" + ", ".join(f"'{d}'" for d in fixed.REVIEW_WEIGHTS) + "]"
IMPACTS = f"""i AS (SELECT l_suppkey AS repo_id, {_DOMAINS}[l_linenumber % 6 + 1] AS domain, l_linestatus || (l_partkey % 5) AS rule_id,
  CASE l_returnflag WHEN 'R' THEN 1.0 WHEN 'A' THEN 0.7 ELSE 0.4 END::DOUBLE AS w, floor(l_quantity % 9)::INT AS p FROM lineitem),
r AS (SELECT *, p * w AS q, row_number() OVER (PARTITION BY repo_id, domain, rule_id ORDER BY p * w DESC) AS k FROM i WHERE p > 0),
c AS (SELECT repo_id, domain, rule_id, least(20.0::DOUBLE, sum(q * CASE k WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 WHEN 3 THEN 0.25 ELSE 0.1 END::DOUBLE)) AS c FROM r GROUP BY ALL),
d AS (SELECT repo_id, domain, least(100.0::DOUBLE, sum(c)) AS penalty FROM c GROUP BY ALL)"""


@query(f"WITH {IMPACTS} SELECT repo_id, domain, round_even(penalty, 6) AS penalty FROM d")
def penalty_decay(spark, sf):
    """Penalties by domain with decay and caps (S-A18)."""
    return review.domain_penalties(_impacts(spark, sf), ["repo_id"]).select("repo_id", "domain", F.bround("penalty", 6).alias("penalty"))


_CAPS = fixed.DEPTH_CAPS["structural_only"]
_D = {d: f"(CASE WHEN coalesce(max(n) FILTER (domain = '{d}'), 0) > 0 THEN greatest(0, 100 - floor(round_even(coalesce(max(penalty) FILTER (domain = '{d}'), 0), 9))) ELSE least(100 - floor(round_even(coalesce(max(penalty) FILTER (domain = '{d}'), 0), 9)), {_CAPS.get(d, 100)}) END)::INT" for d in fixed.REVIEW_WEIGHTS}


@query(
    f"""WITH {IMPACTS}, n AS (SELECT repo_id, domain, count(*) AS n FROM i GROUP BY ALL), x AS (SELECT s_suppkey AS repo_id, n.domain, n.n, d.penalty FROM supplier LEFT JOIN n ON s_suppkey = n.repo_id LEFT JOIN d ON n.repo_id = d.repo_id AND n.domain = d.domain),
s AS (SELECT repo_id, {", ".join(f"{q} AS {d}" for d, q in _D.items())} FROM x GROUP BY repo_id),
o AS (SELECT *, floor(({" + ".join(f"{d} * {w}" for d, w in fixed.REVIEW_WEIGHTS.items())}) / 100)::INT AS overall FROM s)
SELECT *, CASE {" ".join(f"WHEN overall BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in fixed.REVIEW_BANDS)} END AS recommendation FROM o"""
)
def review_scores(spark, sf):
    """Domain scores, overall and band of every repository (S-A18 to S-A21)."""
    i = _impacts(spark, sf)
    items = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("repo_id"))
    counts = i.groupBy("repo_id", "domain").agg(F.count(F.lit(1)).alias("n"))
    return review.domain_scores(items, review.domain_penalties(i, ["repo_id"]), counts, ["repo_id"])


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END, CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END, l_orderkey, l_linenumber) AS k, l_partkey FROM lineitem)
SELECT l_suppkey AS repo_id, l_partkey AS rule_id, l_orderkey, l_linenumber FROM r WHERE k = 1"""
)
def deduped_findings(spark, sf):
    """The gravest, surest, first finding of each rule (2.8)."""
    x = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("repo_id"), F.col("l_partkey").alias("rule_id"), "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "medium").otherwise("low").alias("severity"), F.when(F.col("l_linestatus") == "O", "high").otherwise("medium").alias("confidence"), F.struct("l_orderkey", "l_linenumber").alias("ordinal"))
    return review.dedupe_findings(x, ["repo_id"], F.col("rule_id"), "ordinal").select("repo_id", "rule_id", "l_orderkey", "l_linenumber")


STARS = "(p_size * 37 * (p_partkey % 7))"
FORKS = "(p_partkey % 11 * 60)"


def _candidates(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("full_name"), F.col("p_type").alias("description"), (F.col("p_size") * 37 * (F.col("p_partkey") % 7)).alias("stars"), (F.col("p_partkey") % 11 * 60).alias("forks"), (F.col("p_partkey") % 5 == 0).alias("is_fork"), (F.col("p_partkey") % 13 == 0).alias("is_archived"), F.lit(False).alias("is_template"), F.col("p_brand").alias("license_name"), (F.col("p_size") % 4).alias("n_topics"), (F.col("p_size") * 9).alias("open_issues"), (F.col("p_partkey") % 400).alias("updated_days"), (F.col("p_partkey") % 900).alias("created_days"))


@query(
    f"""WITH c AS (SELECT p_partkey AS id, p_name, p_type AS descr, {STARS} AS stars, {FORKS} AS forks, p_partkey % 5 = 0 AS is_fork, p_partkey % 13 = 0 AS arch, p_brand, p_size % 4 AS topics, p_size * 9 AS issues, p_partkey % 400 AS u, p_partkey % 900 AS a FROM part),
k AS (SELECT * FROM c WHERE NOT ((arch AND stars < 50) OR (is_fork AND stars < 20))),
q AS (SELECT *, CASE WHEN stars >= 5000 THEN 22 WHEN stars >= 1000 THEN 18 WHEN stars >= 100 THEN 12 WHEN stars >= 10 THEN 5 ELSE 0 END
 + least(15, CASE WHEN u <= 14 THEN 10 WHEN u <= 30 THEN 8 WHEN u <= 90 THEN 5 WHEN u <= 365 THEN 2 ELSE 0 END + CASE WHEN a > 365 AND u <= 90 THEN 5 WHEN a > 180 AND u <= 30 THEN 3 ELSE 0 END)
 + CASE WHEN p_brand <> '' AND upper(p_brand) NOT IN ('NOASSERTION', 'OTHER') THEN 7 ELSE 0 END + CASE WHEN length(descr) > 40 THEN 3 ELSE 0 END + CASE WHEN topics >= 3 THEN 3 ELSE 0 END + CASE WHEN forks >= 500 THEN 5 WHEN forks >= 50 THEN 2 ELSE 0 END AS s0 FROM k),
r AS (SELECT *, CASE WHEN issues / greatest(stars, 1) > 0.5 AND stars >= 50 THEN greatest(0, s0 - 2) WHEN issues / greatest(stars, 1) < 0.05 AND stars >= 100 THEN s0 + 2 ELSE s0 END AS s1 FROM q),
f AS (SELECT *, CASE WHEN is_fork THEN greatest(0, s1 - 15) ELSE s1 END AS s2 FROM r),
m AS (SELECT *, CASE WHEN regexp_matches(descr, '(?i)\\b(mirror|clone|copy|backup|archived?)\\b') OR regexp_matches(lower(p_name), '(?i)\\b(mirror|clone|copy|backup|archived?)\\b') THEN greatest(0, s2 - 10) ELSE s2 END AS s3 FROM f)
SELECT id, stars::BIGINT AS stars, least(70, s3)::INT AS quality, least(100, round_even(round_even(0.4 * least(70, s3) + 0.6 * least(100, least(70, s3) + 8 * topics), 6), 0))::INT AS overall FROM m""".replace("\\\\", "\\")
)
def candidate_quality(spark, sf):
    """Quality and blended score of every candidate that is not excluded."""
    c = _candidates(spark, sf)
    flags = ranking.noise_flags(F.col("is_fork"), F.col("is_archived"), F.col("is_template"), F.col("description"), F.col("full_name"), F.col("stars"), F.col("forks"))
    c = c.withColumn("flags", flags).filter(~ranking.excluded(F.col("is_archived"), F.col("flags"), F.col("stars")))
    q = ranking.quality(F.col("stars"), ranking.activity_points(F.col("updated_days"), F.col("created_days")), F.col("license_name"), F.lit(False), F.col("description"), F.col("n_topics"), F.col("forks"), F.col("open_issues"), F.col("flags"))
    c = c.withColumn("quality", q.cast("int"))
    return c.select("id", "stars", "quality", ranking.blend(F.col("quality"), ranking.fallback_relevance(F.col("quality"), F.col("n_topics"), F.lit(0))).alias("overall"))


@query(f"SELECT id, stars::BIGINT AS stars FROM (SELECT p_partkey AS id, {STARS} AS stars, row_number() OVER (PARTITION BY p_brand ORDER BY {STARS} DESC, p_partkey) AS r FROM part) WHERE r = 1")
def candidate_dedupe(spark, sf):
    """The candidate with most stars of each name."""
    c = _candidates(spark, sf)
    return ranking.keep_best(c, F.col("license_name"), F.desc("stars"), F.col("id")).select("id", "stars")


@query(
    """WITH e AS (SELECT DISTINCT l_suppkey AS source, l_partkey AS target FROM lineitem), i AS (SELECT target AS path, count(*) AS callers FROM e GROUP BY 1), o AS (SELECT source AS path, count(*) AS callees FROM e GROUP BY 1)
SELECT coalesce(i.path, o.path) AS path, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees FROM i FULL JOIN o ON i.path = o.path"""
)
def graph_degrees(spark, sf):
    """Distinct callers and callees."""
    e = table(spark, sf, "lineitem").select(F.lit(0).alias("repo"), F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"))
    return graph.degrees(e, ["repo"]).select("path", "callers", "callees")


@query(
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round_even(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"""
)
def revenue_cube(spark, sf):
    """Totals by every combination."""
    x = table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus")
    return x.agg(F.sum("l_quantity").alias("sum_qty"), F.bround(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT c_custkey, least(100, greatest(0, floor(c_acctbal / 100)))::INT AS score, CASE {' '.join(f'WHEN least(100, greatest(0, floor(c_acctbal / 100))) BETWEEN {a} AND {b} THEN {chr(39)}{n}{chr(39)}' for a, b, n in fixed.REVIEW_BANDS)} END AS label FROM customer")
def band_join(spark, sf):
    """Scores joined to bands by range (S-A21)."""
    bands = spark.createDataFrame([(a, b, n) for a, b, n in fixed.REVIEW_BANDS], "lo int, hi int, label string")
    s = table(spark, sf, "customer").select("c_custkey", F.least(F.lit(100), F.greatest(F.lit(0), F.floor(F.col("c_acctbal") / 100))).cast("int").alias("score"))
    return review.band_join(s, bands, "score")


@query(
    """WITH u AS (SELECT url, string_split(regexp_replace(url, '^https?://[^/]+/?', ''), '/') AS ps, page_id FROM pages), p AS (SELECT page_id, array_to_string(ps, '/') AS path, list_filter(list_transform(ps, lambda x: lower(x)), lambda x: x IN ('auth', 'payments', 'users', 'api', 'services', 'admin', 'analytics', 'notifications', 'search'))[1] AS boundary FROM u)
SELECT page_id, path, boundary FROM p"""
)
def service_boundaries(spark, sf):
    """Service boundary of every page's path."""
    path = F.regexp_replace("url", r"^https?://[^/]+/?", "")
    return table(spark, sf, "pages").select("page_id", path.alias("path"), C.service_boundary(path).alias("boundary"))


@query("WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM lineitem) SELECT l_orderkey, l_linenumber, l_quantity FROM x WHERE coalesce(before, 0) <= 60")
def budgeted_prefix(spark, sf):
    """Rows of each group until the budget is passed (2.12)."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf, "lineitem").withColumn("b", F.coalesce(F.sum("l_quantity").over(w), F.lit(0.0))).filter("b <= 60").select("l_orderkey", "l_linenumber", "l_quantity")
