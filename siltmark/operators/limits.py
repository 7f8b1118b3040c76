"""Sliding-window rate limits, replayed: a request that is turned away does not count against later ones.

That makes each key's history sequential: what a request meets depends on all that was let through before it. A history
is nevertheless cut into blocks of time, which are replayed side by side from the state that the block before is thought
to leave: the requests it let through within the longest window. A block is replayed again only while the state it
starts from has changed; when none has, every block has started from what the one before leaves, which is the
sequential result. A wrong start is forgotten once the limits are next met or idle, so few rounds are needed; there
are at most as many as a key has blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .cut import cut

MICROS = 1_000_000


@dataclass(frozen=True)
class Limit:
    """At most ``burst`` requests in any ``burst_seconds``, and ``daily`` in any ``daily_seconds``."""

    burst: int
    burst_seconds: int
    daily: int
    daily_seconds: int = 86_400

    @property
    def longest(self) -> int:
        return max(self.burst_seconds, self.daily_seconds) * MICROS

    def replay(self, at: np.ndarray, kept: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(allowed, seconds to wait) of ascending times in microseconds; kept, the times let through before, is added to.

        Between two requests that are let through the state stands still, so all that are turned away there are
        answered at once.
        """
        short, long = self.burst_seconds * MICROS, self.daily_seconds * MICROS
        allowed, wait = np.zeros(len(at), bool), np.zeros(len(at), np.int64)
        i = 0
        while i < len(at):
            soon = kept[-self.burst] + short if len(kept) >= self.burst else at[i]
            later = kept[-self.daily] + long if len(kept) >= self.daily else at[i]
            if at[i] >= max(soon, later):
                kept.append(int(at[i]))
                allowed[i] = True
                i += 1
                continue
            j = int(np.searchsorted(at, max(soon, later)))
            gone = at[i:j]
            wait[i:j] = np.maximum(1, (np.where(gone < soon, soon, later) - gone) // MICROS)
            i = j
        return allowed, wait

    def live(self, kept: list[int], end: int) -> list[int]:
        """Of the times let through, those that a request at ``end`` or later can still meet."""
        return [t for t in kept[-max(self.burst, self.daily) :] if t > end - self.longest]


def rate_limited(requests: DataFrame, key: str, ts: str, limit: Limit, tie: str | None = None, block_seconds: int = 864_000) -> DataFrame:
    """(key string, t seconds, allowed, retry_after[, tie]), a row for each request.

    Requests of a key are taken by time, then by ``tie``. A block's requests are one task's, and stream through it, so ``block_seconds`` has
    to be chosen for the busiest key; a block that spans several of the longest windows settles in two rounds. Null keys
    are a key of their own; a null time is never let through and waits 0 seconds; an empty table gives none.
    """
    span = block_seconds * MICROS
    extra = [tie] if tie else []
    rows = requests.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("u"), *extra)
    timeless = rows.filter("u is null").select("key", F.lit(None).cast("double").alias("t"), F.lit(False).alias("allowed"), F.lit(0).alias("retry_after"), *extra)
    rows = cut(rows.filter("u is not null").withColumn("block", F.floor(F.col("u") / span).cast("long")))
    types = dict(rows.dtypes)
    ends, answers = _Ends(limit, span), _Answers(limit, extra)
    left_schema, schema = "key string, block long, state array<long>", "key string, t double, allowed boolean, retry_after int" + "".join(f", {c} {types[c]}" for c in extra)

    def replayed(events: DataFrame, start: DataFrame, by, out: str) -> DataFrame:
        """Blocks of events in order, each after its start, where it has one."""
        first = start.select("key", "block", F.lit(None).cast("long").alias("u"), *(F.lit(None).cast(types[c]).alias(c) for c in extra), "state")
        both = events.select("key", "block", "u", *extra, F.lit(None).cast("array<long>").alias("state")).unionByName(first)
        order = ["key", "block", F.asc_nulls_first("u"), *(F.asc_nulls_last(c) for c in extra)]
        return both.repartition("key", "block").sortWithinPartitions(*order).mapInArrow(by, out)

    none = F.array().cast("array<long>")
    before = Window.partitionBy("key").orderBy("block")
    left = cut(replayed(rows, rows.select("key", "block", none.alias("state")).limit(0), ends, left_schema))
    starts = cut(left.select("key", "block", none.alias("state")))
    while True:
        # what the block before leaves, without what this block is too late to meet
        came = F.filter(F.coalesce(F.lag("state").over(before), none), lambda t: t > F.col("block") * span - limit.longest)
        now = cut(left.select("key", "block", came.alias("state")))
        changed = now.alias("n").join(starts.alias("s"), F.expr("n.key <=> s.key and n.block = s.block")).filter("n.state <> s.state").select("n.*")
        changed = cut(changed)
        starts = now
        if changed.isEmpty():
            break
        again = rows.alias("r").join(changed.alias("c"), F.expr("r.key <=> c.key and r.block = c.block"), "left_semi")
        redone = replayed(again, changed, ends, left_schema)
        kept = left.alias("l").join(changed.alias("c"), F.expr("l.key <=> c.key and l.block = c.block"), "left_anti")
        left = cut(kept.unionByName(redone))
    return replayed(rows, starts.filter(F.size("state") > 0), answers, schema).unionByName(timeless)


class _Blocks:
    """Blocks as they stream through a task: what is let through is carried from batch to batch, so no block is held whole."""

    def __init__(self, limit: Limit):
        self.limit = limit

    def pieces(self, it):
        """(batch, [(key, block, from, to, kept)]): the requests of a block that a batch has, with the times let through before."""
        at, kept = None, []
        for rb in it:
            names = rb.schema.names
            keys, blocks, state = rb.column(names.index("key")), rb.column(names.index("block")), rb.column(names.index("state"))
            code = np.asarray(keys.dictionary_encode("encode").indices)
            block = np.asarray(blocks)
            edge = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(block)] if len(block) else [0]
            begins = np.asarray(state.is_valid())
            out = []
            for a, b in zip(edge[:-1], edge[1:]):
                here = (keys[a].as_py(), int(block[a]))
                if here != at:
                    at, kept = here, []
                if begins[a]:
                    kept.extend(state[a].as_py())
                    a += 1
                out.append((*here, a, b, kept))
            yield rb, out


class _Ends(_Blocks):
    """The state that each block leaves."""

    def __init__(self, limit: Limit, span: int):
        super().__init__(limit)
        self.span = span

    def __call__(self, it):
        last = None
        for rb, pieces in self.pieces(it):
            u, done = np.asarray(rb.column("u").fill_null(0)), []
            for key, block, a, b, kept in pieces:
                if last and last[:2] != (key, block):
                    done.append(last)
                self.limit.replay(u[a:b], kept)
                del kept[: -max(self.limit.burst, self.limit.daily)]
                last = (key, block, kept)
            if done:
                yield self.rows(done)
        if last:
            yield self.rows([last])

    def rows(self, done) -> pa.RecordBatch:
        live = [self.limit.live(kept, (block + 1) * self.span) for _, block, kept in done]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array(live, pa.list_(pa.int64()))], ["key", "block", "state"])


class _Answers(_Blocks):
    """Each request with whether it is let through and how long it has to wait."""

    def __init__(self, limit: Limit, extra: list[str]):
        super().__init__(limit)
        self.extra = extra

    def __call__(self, it):
        for rb, pieces in self.pieces(it):
            u = np.asarray(rb.column("u").fill_null(0))
            allowed, wait = np.zeros(len(u), bool), np.zeros(len(u), np.int32)
            for _, _, a, b, kept in pieces:
                allowed[a:b], wait[a:b] = self.limit.replay(u[a:b], kept)
                del kept[: -max(self.limit.burst, self.limit.daily)]
            cols = [rb.column("key"), pa.array(u / 1e6), pa.array(allowed), pa.array(wait), *(rb.column(c) for c in self.extra)]
            out = pa.RecordBatch.from_arrays(cols, ["key", "t", "allowed", "retry_after", *self.extra])
            yield out.filter(rb.column("u").is_valid())
