"""Operational metrics over jobs, usage, heartbeats and requests. ``now`` is always given, never read from a clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed


def seconds(a: Column, b: Column) -> Column:
    return F.unix_timestamp(b) - F.unix_timestamp(a)


def queue_metrics(jobs: DataFrame, now: Column, by: list[str] | None = None, hours: int = fixed.WINDOW_HOURS) -> DataFrame:
    """Queued, running, what ended in the last hours, mean duration of the completed, ages of the oldest."""
    recent = F.col("completed_at") >= now - F.expr(f"INTERVAL {hours} HOURS")
    took = seconds(F.coalesce("started_at", "created_at"), F.col("completed_at"))
    age = lambda c, s: F.greatest(F.lit(0), seconds(F.min(F.when(F.col("status") == s, F.col(c))), now))
    done = (F.col("status") == "completed") & recent
    return jobs.groupBy(*(by or [])).agg(
        F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status") == "running").alias("running"), F.count_if(done).alias("completed_recent"), F.count_if((F.col("status") == "failed") & recent).alias("failed_recent"),
        F.floor(F.avg(F.when(done & (took >= 0), took))).alias("mean_seconds"), age("created_at", "queued").alias("oldest_queued"), age("started_at", "running").alias("oldest_running"),
    )


def usage(calls: DataFrame, now: Column, hours: int = fixed.WINDOW_HOURS) -> DataFrame:
    """Calls, tokens, cost and mean duration by stage, and in all (stage null)."""
    rows = calls.filter(F.col("created_at") >= now - F.expr(f"INTERVAL {hours} HOURS"))
    cost = (F.sum("input_tokens") * fixed.USD_PER_MILLION_IN + F.sum("output_tokens") * fixed.USD_PER_MILLION_OUT) / 1e6
    return rows.rollup("stage").agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.bround(cost, 4).alias("cost_usd"), F.floor(F.sum("duration_ms") / F.count(F.lit(1))).alias("mean_ms"))


def latest(rows: DataFrame, key: list[str], ts: str, *ties: str) -> DataFrame:
    """The newest row of each key, by a partial aggregate and no sort."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(ts, *ties)).alias("_r")).select(*key, "_r.*")


def worker_status(beats: DataFrame, now: Column, stale_after: int = 60) -> DataFrame:
    """Age and freshness of each worker's newest beat; its queues as a sorted array."""
    rows = latest(beats, ["worker_id"], "last_seen_at")
    age = F.greatest(F.lit(0), F.coalesce(seconds(F.col("last_seen_at"), now), F.lit(stale_after + 1)))
    queues = F.array_sort(F.filter(F.transform(F.split("queues", ","), lambda q: F.trim(q)), lambda q: q != ""))
    return rows.select("worker_id", queues.alias("queues"), "status", age.alias("age_seconds"), ((F.col("status") == "running") & (age < stale_after)).alias("fresh"))


def worker_summary(workers: DataFrame) -> DataFrame:
    """One row of worker_status' rows: status (ok, stale or missing), fresh_count, stale_count, active_queues."""
    fresh = F.count_if("fresh")
    queues = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("fresh"), F.col("queues"))))))
    rows = workers.agg(fresh.alias("fresh_count"), (F.count(F.lit(1)) - fresh).alias("stale_count"), queues.alias("active_queues"))
    return rows.select(F.when(F.col("fresh_count") > 0, "ok").when(F.col("stale_count") > 0, "stale").otherwise("missing").alias("status"), "*")


def attention(queues: Column, active: Column, queued_for: int, running_for: int) -> Column:
    """What needs attention, or null.

    queues: array of (name, queue, queued, running, oldest_queued, oldest_running: seconds), in order; active: queues
    that a fresh worker serves. A queue that waits with nothing running comes before a job that runs too long.
    """
    stuck = F.filter(queues, lambda q: (q["queued"] > 0) & (q["running"] == 0) & (F.coalesce(q["oldest_queued"], F.lit(0)) >= queued_for))
    unserved = F.filter(stuck, lambda q: ~F.array_contains(active, q["queue"]))
    slow = F.filter(queues, lambda q: F.coalesce(q["oldest_running"], F.lit(0)) >= running_for)
    say = lambda text, qs: F.replace(F.lit(text), F.lit("{}"), F.array_join(F.transform(qs, lambda q: q["name"]), " and "))
    return F.when(F.size(unserved) > 0, say(fixed.NO_WORKER, unserved)).when(F.size(stuck) > 0, say(fixed.IDLE_WORKER, stuck)).when(F.size(slow) > 0, say(fixed.SLOW_WORKER, slow))


def overall_status(queues: Column, attention_: Column, service_ok: Column) -> Column:
    """watch, active or steady, of queues as attention takes them, with their failed_recent."""
    total = lambda f: F.aggregate(F.transform(queues, lambda q: q[f].cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(~service_ok | (total("failed_recent") >= 3) | attention_.isNotNull(), "watch").when((total("running") > 0) | (total("queued") > 0), "active").otherwise("steady")


def claim(jobs: DataFrame, slots: int) -> DataFrame:
    """The oldest queued jobs, as many as there are slots, with the slot of each."""
    first = jobs.filter("status = 'queued'").orderBy("created_at", "id").limit(slots)
    return first.withColumn("slot", F.row_number().over(Window.orderBy("created_at", "id")))  # at most slots rows


def apply_claims(jobs: DataFrame, claims: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(jobs, claims with held): claims (id, worker) against the jobs as they are now.

    A claim holds only if its job is still queued, and of several claims of one job that of the smallest worker; a claim
    that does not hold is to be tried on another job. A job that is claimed runs, from now.
    """
    still = jobs.filter("status = 'queued'").select("id")
    winners = claims.join(still, "id", "left_semi").groupBy("id").agg(F.min("worker").alias("_winner"))
    done = claims.join(winners, "id", "left").withColumn("held", F.coalesce(F.col("worker") == F.col("_winner"), F.lit(False))).drop("_winner")
    rows = jobs.join(winners, "id", "left")
    won = F.col("_winner").isNotNull()
    return rows.withColumn("status", F.when(won, "running").otherwise(F.col("status"))).withColumn("started_at", F.when(won, now).otherwise(F.col("started_at"))).withColumnRenamed("_winner", "worker"), done


def expire(jobs: DataFrame, now: Column, stale: int = fixed.STALE_SECONDS, expired: int = fixed.EXPIRED_SECONDS) -> DataFrame:
    """Running jobs that are stale and queued ones that expired as failed, with the reason; others as they are."""
    late = (F.col("status") == "running") & (seconds(F.coalesce("started_at", "created_at"), now) > stale)
    old = (F.col("status") == "queued") & (seconds(F.col("created_at"), now) > expired)
    reason = F.when(late, "stale running job").when(old, "expired in queue")
    return jobs.withColumn("reason", reason).withColumn("status", F.when(late | old, "failed").otherwise(F.col("status"))).withColumn("completed_at", F.when(late | old, now).otherwise(F.col("completed_at")))


def sliding_counts(requests: DataFrame, key: str, ts: str, span: int) -> DataFrame:
    """Requests of a key in the span of seconds up to each."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-span * 1_000_000 + 1, 0)
    return requests.withColumn("in_window", F.count(F.lit(1)).over(w))


def daily_quota(requests: DataFrame, key: str, ts: str, limit: int) -> DataFrame:
    """Used and left of each key's day, days cut at midnight UTC."""
    rows = requests.groupBy(key, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("used"))
    return rows.withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("used"))).withColumn("exceeded", F.col("used") > limit)


def reusable(requests: DataFrame, results: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(answered by a stored result of the same content, still to do)."""
    return requests.join(results, on), requests.join(results, on, "left_anti")


def next_version(versions: DataFrame, key: str) -> DataFrame:
    return versions.groupBy(key).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def audit(log: DataFrame, limit: int = 50, offset: int = 0, most: int = 500, **equal) -> DataFrame:
    """A page of a log's rows with the given values, newest first, each with the number of all such rows (total)."""
    for name, value in equal.items():
        if value is not None:
            log = log.filter(F.col(name) == value)
    page = log.orderBy(F.desc("ts"), "id").offset(offset).limit(min(limit, most))
    return page.crossJoin(F.broadcast(log.agg(F.count(F.lit(1)).alias("total"))))  # one row


def newest(kinds: dict[str, DataFrame], n: int, ts: str = "completed_at") -> DataFrame:
    """The newest n rows (id, ts, message) of several kinds together, with their kind; each kind sends no more than n."""
    out = None
    for name, rows in kinds.items():
        mine = rows.orderBy(F.desc(ts), "id").limit(n).select(F.lit(name).alias("kind"), "id", ts, "message")
        out = mine if out is None else out.unionByName(mine)
    return out.orderBy(F.desc(ts), "kind", "id").limit(n)


def root_cause(queues: Column) -> Column:
    """Why queued jobs expired, of array of (name, cleared, running) in order: the first queue that lost jobs and runs none has no worker, else there are too few."""
    idle = F.filter(queues, lambda q: (q["cleared"] > 0) & (q["running"] == 0))
    return F.when(F.size(idle) > 0, F.concat(F.get(idle, F.lit(0))["name"], F.lit("_worker_inactive"))).otherwise("worker_capacity_saturated")
