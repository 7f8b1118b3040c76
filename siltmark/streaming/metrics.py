"""The operational metrics as streams: the same rows as the batch operators give over the same events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def usage_by_window(calls: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls and values by stage and tumbling window; what is later than ``late`` is left out."""
    rows = calls.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("calls"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "calls", "total")


def latest_by_key(events: DataFrame, key: str) -> DataFrame:
    """The newest event of each key (update or complete mode)."""
    return events.groupBy(key).agg(F.max("ts").alias("ts"), F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


def stale_jobs(events: DataFrame, seconds: int) -> DataFrame:
    """(id, failed_at) of jobs that started and had no end within so many seconds of event time."""
    import pandas as pd

    def watch(key, frames, state):
        started = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"id": [key[0]], "failed_at": [started + seconds]})
            return
        for f in frames:
            for ts, status in sorted(zip(f["sec"], f["status"], strict=True)):
                started = int(ts) if status == "started" else None
        if started is None:
            if state.exists:
                state.remove()
        elif (started + seconds) * 1000 <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            yield pd.DataFrame({"id": [key[0]], "failed_at": [started + seconds]})
        else:
            state.update((started,))
            state.setTimeoutTimestamp(int((started + seconds) * 1000))

    rows = events.withWatermark("ts", "0 seconds").select("id", "status", "ts", F.unix_timestamp("ts").alias("sec"))
    return rows.groupBy("id").applyInPandasWithState(watch, "id long, failed_at long", "started long", "append", GroupStateTimeout.EventTimeTimeout)
