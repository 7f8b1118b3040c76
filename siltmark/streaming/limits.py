"""The rate limiter as a stream: each key's state is the list of requests let through, kept by Spark's state store."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.limits import Limit

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Limiter(StatefulProcessor):
    """Answers each request of a key; keeps the times let through that later requests can still meet.

    By event time, a timer drops a key's list when the last of it has left the longest window. By processing time, the
    list's entries live as long as that window by the state store's own clock.
    """

    def __init__(self, limit: Limit, by_event_time: bool):
        self.limit, self.by_event_time = limit, by_event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = None if self.by_event_time else self.limit.longest // 1000
        self.kept = handle.getListState("kept", "u long", ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["u", "tie"], kind="stable")
        kept = sorted(int(x[0]) for x in self.kept.get()) if self.kept.exists() else []
        allowed, wait = self.limit.replay(events.u.to_numpy().astype(np.int64), kept)
        live = self.limit.live(kept, int(events.u.iloc[-1]) + 1)
        if live:
            self.kept.put([(t,) for t in live])
        else:
            self.kept.clear()
        if self.by_event_time:
            self._drop_timers()
            if live:
                self.handle.registerTimer((live[-1] + self.limit.longest) // 1000 + 1)
        yield pd.DataFrame({"key": events.key, "t": events.u / 1e6, "allowed": allowed, "retry_after": wait.astype("int32"), "tie": events.tie})

    def handleExpiredTimer(self, key, timers, info) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass

    def _drop_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)


def rate_limited(requests: DataFrame, key: str, ts: str, limit: Limit, tie: str, late: str | None = "1 hour") -> DataFrame:
    """(key, t, allowed, retry_after, tie) of a stream of requests, as they come: the rows of the batch replay if none comes late.

    ``late`` is the watermark of event time; None keeps state by processing time instead. Needs the RocksDB state store.
    """
    spark = requests.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKS:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKS}")
    rows = requests.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if late else rows
    rows = rows.select(F.col(key).cast("string").alias("key"), F.unix_micros(ts).alias("u"), F.col(tie).alias("tie"), ts)
    kind = dict(rows.dtypes)["tie"]
    return rows.groupBy("key").transformWithStateInPandas(Limiter(limit, bool(late)), f"key string, t double, allowed boolean, retry_after int, tie {kind}", "append", "EventTime" if late else "ProcessingTime")
