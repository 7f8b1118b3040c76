"""Best-two-fit packing of token sequences.

Pieces of one length are interchangeable, so the driver packs the histogram of lengths (as many rows as a sequence has
tokens, whatever the corpus) and each piece finds its place by its rank among those of its length. A bin is filled
greedily, largest fitting length first; then its smallest piece gives way to the two unpacked ones that fill the
expanded gap most tightly, if they fill it better. A bin's pattern is used as often as its lengths last.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import _shared as S
from .tokens import encoded


def plan_bins(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """counts[n]: pieces of length n. Patterns [(length, pieces)], largest first, with how many bins each fills."""
    left = np.asarray(counts, np.int64).copy()
    lengths = np.arange(capacity + 1)
    plan = []
    while True:
        fits = np.maximum.accumulate(np.where(left > 0, lengths, 0))  # the largest length left up to each size
        if not fits[capacity]:
            return plan
        used: dict[int, int] = {}
        gap = capacity
        while (n := int(fits[gap])) > 0:
            k = min(gap // n, int(left[n]))
            used[n] = k
            gap -= k * n
            if gap >= n:
                below = int(fits[n - 1])
                if not below:
                    break
                # what is left of length n is used up: look below it
                fits = fits.copy()
                fits[n:] = np.where(fits[n:] == n, below, fits[n:])
        if sum(used.values()) > 1 and gap:
            two = _two_fit(left, used, gap)
            if two:
                used = two
        times = min(int(left[n]) // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= k * times
        plan.append((sorted(used.items(), reverse=True), times))


def _two_fit(left: np.ndarray, used: dict[int, int], gap: int) -> dict[int, int] | None:
    small = min(used)
    free = left.copy()
    for n, k in used.items():
        free[n] -= k
    free[small] += 1
    room = gap + small
    lengths = np.arange(len(left))
    best = np.maximum.accumulate(np.where(free > 0, lengths, 0))
    x = np.flatnonzero(free[: room + 1] > 0)
    x = x[x < room]
    if not len(x):
        return None
    y = best[np.minimum(room - x, x)]
    alone = (y == x) & (free[x] < 2)
    y = np.where(alone, best[np.maximum(x - 1, 0)], y)
    fill = np.where(y > 0, x + y, 0)
    k = len(fill) - 1 - int(np.argmax(fill[::-1]))
    if fill[k] <= small:
        return None
    out = dict(used)
    out[small] -= 1
    for n in (int(x[k]), int(y[k])):
        out[n] = out.get(n, 0) + 1
    return {n: k for n, k in out.items() if k}


def allocation(plan: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Columns: length << 40 | first rank, pieces a bin, first sequence, offset in the sequence; sorted by the first."""
    rows, rank, seq = [], {}, 0
    for pattern, times in plan:
        at = 0
        for n, k in pattern:
            r = rank.get(n, 0)
            rows.append((n << 40 | r, k, seq, at))
            rank[n] = r + k * times
            at += n * k
        seq += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


class _Pieces:
    def __init__(self, tokenizer: str, end_id: int, capacity: int):
        self.tokenizer, self.end_id, self.capacity = tokenizer, end_id, capacity

    def __call__(self, it):
        part, seen = TaskContext.get().partitionId(), np.zeros(self.capacity + 1, np.int64)
        for rb in it:
            for at, ids, counts in encoded(self.tokenizer, rb.column(1)):
                ids, counts = np.insert(ids, np.cumsum(counts), self.end_id).astype("<u4"), counts + 1
                pieces = -(-counts // self.capacity)
                row = np.repeat(np.arange(len(counts)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * self.capacity
                length = np.minimum(counts[row] - start, self.capacity)
                raw, ends = memoryview(ids.tobytes()), np.cumsum(length) * 4
                crc = [zlib.crc32(raw[a:b]) for a, b in zip((ends - length * 4).tolist(), ends.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                s = length[order]
                first = S.runs(s)
                n = np.diff(np.append(first, len(s)))
                rank = np.empty(len(s), np.int64)
                rank[order] = np.arange(len(s)) - np.repeat(first, n) + seen[s]
                seen[s[first]] += n
                yield pa.RecordBatch.from_pydict({"doc_id": rb.column(0).take(pa.array(at + row)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()), "part": pa.array(np.full(len(s), part)), "rank": pa.array(rank)})


class _Place:
    def __init__(self, table: np.ndarray):
        self.table = table

    def __call__(self, it):
        for rb in it:
            length, rank = (np.asarray(rb.column(x)) for x in ("length", "rank"))
            k, n, seq, at = self.table[np.searchsorted(self.table[:, 0], length << 40 | rank, "right") - 1].T
            r = rank - (k & (1 << 40) - 1)
            yield pa.RecordBatch.from_arrays([*(rb.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq + r // n), pa.array(at + r % n * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs every text's ids with end_id, cut only where longer than capacity, into few sequences of at most capacity.

    Returns (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row a piece. A null text is empty and
    has the end id alone; null and repeated keys are packed like others; other columns are ignored; an empty table
    gives an empty result. The driver sees counts by length only.
    """
    spark, root = docs.sparkSession, S.shared_root(docs.sparkSession)
    pieces = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_Pieces(tokenizer, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long")
    pieces = S.materialised(pieces, f"{root}/pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r.length] = r.n
    table = allocation(plan_bins(counts, capacity))
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.withColumn("base", F.coalesce(F.sum("n").over(w), F.lit(0))).select("length", "part", "base")
    ranked = pieces.join(base, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_Place(table), out)
