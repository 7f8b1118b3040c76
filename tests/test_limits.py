"""The rate limit: batch replay, stream and a plain loop agree."""

import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from siltmark.operators import limits
from siltmark.streaming import limits as stream

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def loop(rows, limit):
    """rows (key, seconds, id) to {id: (allowed, wait)}."""
    kept, out = {}, {}
    for key, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        live = [x for x in kept.get(key, []) if x > t - limit.daily_seconds]
        near = [x for x in live if x > t - limit.burst_seconds]
        if len(near) >= limit.burst:
            out[i] = (False, max(1, int(live[-limit.burst] + limit.burst_seconds - t)))
        elif len(live) >= limit.daily:
            out[i] = (False, max(1, int(live[0] + limit.daily_seconds - t)))
        else:
            live.append(t)
            out[i] = (True, 0)
        kept[key] = live
    return out


def frame(spark, rows):
    return spark.createDataFrame([(k, None if t is None else START + timedelta(seconds=t), i) for k, t, i in rows], "k string, ts timestamp, id long")


@pytest.mark.parametrize("block_seconds", [864_000, 20_000])
def test_blocks_equal_a_loop_with_half_of_all_requests_on_one_key(spark, block_seconds):
    rng = random.Random(block_seconds)
    rows = [("hot" if rng.random() < 0.5 else rng.choice("abcdefgh"), rng.randrange(2 * 86_400), i) for i in range(3000)]
    limit = limits.Limit(4, 600, 25, 20_000)
    got = {r.id: (r.allowed, r.retry_after) for r in limits.rate_limited(frame(spark, rows), "k", "ts", limit, "id", block_seconds).collect()}
    want = loop(rows, limit)
    assert got == want
    assert {True, False} == {a for a, _ in want.values()}


def test_edges(spark):
    limit = limits.Limit(3, 10, 5)
    rows = [("a", t, i) for i, t in enumerate([0, 1, 2, 3, 12, 13, 14, 30, 86405])] + [(None, 5, 20), (None, 5, 21), (None, 5, 22), (None, 5, 23)]
    got = {r.id: (r.allowed, r.retry_after) for r in limits.rate_limited(frame(spark, [*rows, ("a", None, 99)]), "k", "ts", limit, "id", 20).collect()}
    assert got == {**loop(rows, limit), 99: (False, 0)}
    assert got[3] == (False, 7) and got[6] == (False, 86386) and got[23] == (False, 10)
    assert limits.rate_limited(frame(spark, []), "k", "ts", limit).count() == 0


@pytest.mark.parametrize("late", ["30 minutes", None])
def test_stream_equals_batch(spark, tmp_path, late):
    rng = random.Random(7)
    rows = sorted((rng.randrange(5 * 86_400), rng.choice(["hot", "hot", "hot", "x", "y"]), i) for i in range(900))
    df = frame(spark, [(k, t, i) for t, k, i in rows])
    limit = limits.Limit(3, 1800, 12)
    src = str(tmp_path / "src")
    for part in range(4):  # four micro-batches, by time
        df.filter(F.col("id").isin([i for _, _, i in rows[part * 225 : (part + 1) * 225]])).coalesce(1).write.mode("append").parquet(src)
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.ROCKS)
    try:
        read = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
        name = "limited_" + ("event" if late else "processing")
        q = stream.rate_limited(read, "k", "ts", limit, "id", late).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(**({"availableNow": True} if late else {"processingTime": "0 seconds"})).start()
        # by processing time a next batch always comes, for what the clock drops: such a stream is stopped from outside
        for _ in range(120):
            if not q.isActive or spark.table(name).count() == len(rows):
                break
            time.sleep(0.5)
        q.stop()
        got = {r.tie: (r.allowed, r.retry_after) for r in spark.table(name).collect()}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert got == loop([(k, t, i) for t, k, i in rows], limit)


def test_stream_needs_its_state_store(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        stream.rate_limited(frame(spark, []), "k", "ts", limits.Limit(1, 1, 1), "id")


def test_blocks_stream_through_tasks(spark):
    """A block goes on over Arrow batches, and no call is made for each group."""
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "x", None]), rng.randrange(2 * 86_400), i) for i in range(600)]
    limit = limits.Limit(4, 600, 25, 20_000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = limits.rate_limited(frame(spark, rows), "k", "ts", limit, "id", 30_000)
        assert {r.id: (r.allowed, r.retry_after) for r in df.collect()} == loop(rows, limit)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "CoGroup" not in df._jdf.queryExecution().toString()
