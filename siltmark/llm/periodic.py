"""Runs of repeating words by Main and Lorentz's divide and conquer over interned word ids.

A document's words are halved again and again at aligned midpoints. A repetition of period p that crosses a midpoint m
has the words at m - 1 and m - 1 + p, or at m - p and m, in its stretch of equal pairs: those pairs are found for all
documents and midpoints of a level at once. What is left is measured by Z-functions, forward and backward from the
midpoint, kept where one of the midpoint's candidates needs them. A repetition that a neighbouring word outside its
block extends is left to the enclosing block, which holds it whole; equal intervals keep their smallest period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, StructType

from . import _shared as S

#: Bytes of text that are searched together, one text at least.
SLICE_BYTES = 2 << 20
RUNS = "array<struct<start:long,length:long,period:long>>"
RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def interned(words: S.Words) -> np.ndarray:
    """An id for each word, equal for equal words of the slice only."""
    letters = words.data[~S.WHITE[words.data]]
    off = np.concatenate(([0], np.cumsum(words.end - words.start)))
    col = pa.Array.from_buffers(pa.large_binary(), len(words.start), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(letters)])
    return np.asarray(col.dictionary_encode().indices).astype(np.int32) if len(words.start) else np.zeros(0, np.int32)


def common_prefix(x: np.ndarray, a: int, b: int, n: int) -> int:
    """How many of x[a:a+n] and x[b:b+n] are equal before the first that differ."""
    at, step = 0, 16
    while at < n:
        k = min(step, n - at)
        differ = x[a + at : a + at + k] != x[b + at : b + at + k]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, step = at + k, min(4 * step, 1 << 16)
    return n


def z_values(x: np.ndarray, pattern: int, places: list[int], least_end: int, z: dict[int, int], own: bool) -> dict[int, int]:
    """Common prefixes of x[pattern:] with x from each place (ascending), none of the two passing least_end.

    z has the pattern's own values by distance, and gets them where own. The box that reaches farthest answers a place
    inside it by the value at the same distance in the pattern, so that no word is compared again and again.
    """
    out: dict[int, int] = {}
    left = right = -1
    for at in places:
        most, got = least_end - max(at, pattern), 0
        if at < right:
            known = z.get(at - left)
            if known is not None:
                if known < right - at:
                    out[at] = known
                    if own:
                        z[at - pattern] = known
                    continue
                got = min(right - at, most)
        got += common_prefix(x, pattern + got, at + got, most - got)
        out[at] = got
        if own:
            z[at - pattern] = got
        if at + got > right:
            left, right = at, at + got
    return out


def _crossing(x: np.ndarray, y: np.ndarray, c: int, m: int, d: int, right: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of repetitions that cross m in the block c to d; right and left: candidate periods by side, ascending. y is x reversed."""
    last = len(x) - 1
    rev = lambda i: last - i
    if len(right) + len(left) > 8:
        # the smallest period first: a multiple of it whose pair lies in its interval gives no other interval
        p = int(min(side[0] for side in (right, left) if len(side)))
        u = m - 1 if len(right) and right[0] == p else m - p
        s, e = u - common_prefix(y, rev(u - 1), rev(u - 1 + p), u - c), u + p + common_prefix(x, u, u + p, d - u - p)
        if e - s >= max(least, 2 * p):
            yield s, e, p
            if s < m < e:
                right, left = right[(right % p != 0) | (m - 1 + right >= e)], left[(left % p != 0) | (m - left < s)]
    right, left = right.tolist(), left.tolist()
    forward: dict[int, int] = {}
    backward: dict[int, int] = {}
    r = z_values(x, m, [m + p for p in right], d, forward, True)
    lo = z_values(y, rev(m - 1), [rev(m - 1 - p) for p in left if m - 1 - p >= c], rev(c) + 1, backward, True)
    for p, back in zip(reversed(right), z_values(y, rev(m - 1), [rev(m - 1 + p) for p in reversed(right)], rev(c) + 1, backward, False).values(), strict=True):
        if back + r[m + p] >= max(p, least - p):
            yield m - back, m + p + r[m + p], p
    for p, on in zip(reversed(left), z_values(x, m, [m - p for p in reversed(left)], d, forward, False).values(), strict=True):
        back = lo.get(rev(m - 1 - p), 0)
        if back + on >= max(p, least - p):
            yield m - p - back, m + on, p


def find(x: np.ndarray, first: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of all documents: (document, start, end, period), by document, start and period.

    x holds all documents' word ids one after another, document k from first[k] to first[k + 1].
    """
    n = np.diff(first)
    found: dict[tuple[int, int], int] = {}
    y = x[::-1]
    half = 1
    while 4 * half < least:  # the smallest block that can hold `least` words
        half *= 2
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(x)) - first[doc]
    base, size = first[:-1][doc], n[doc]
    while len(n) and half < n.max():
        keep = size > half
        if not keep.all():
            at, base, size = at[keep], base[keep], size[keep]
        low = at & ~(2 * half - 1)
        middle = low + half
        on_right = at >= middle
        has = middle < size
        # of a right half: the pair m - 1 and this word; of a left half: this word and m
        mate = base + np.where(has, middle, 0) - on_right
        hit = np.flatnonzero(has & (x[base + at] == x[mate]))
        if len(hit):
            b, m, right = base[hit], middle[hit], on_right[hit]
            here = at[hit]
            period = np.where(right, here - m + 1, m - here)
            u = b + np.where(right, m - 1, here)
            lo, hi = b + low[hit], b + np.minimum(low[hit] + 2 * half, size[hit])
            need = np.minimum(np.maximum(period, least - period), least)
            length = np.ones(len(hit), np.int64)
            for way in (1, -1):
                go = np.arange(len(hit))
                for t in range(1, least):
                    i = u[go] + way * t
                    ok = (i + period[go] < hi[go]) & (i >= lo[go])
                    go, i = go[ok], i[ok]
                    same = x[i] == x[i + period[go]]
                    go = go[same]
                    if not len(go):
                        break
                    length[go] += 1
            good = np.flatnonzero(length >= need)
            good = good[np.lexsort((period[good], right[good], lo[good]))]
            edges = np.append(S.runs(lo[good]), len(good)) if len(good) else np.zeros(1, np.int64)
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                k = good[i:j]
                c, d, b0 = int(lo[k[0]]), int(hi[k[0]]), int(b[k[0]])
                end = b0 + int(size[hit[k[0]]])
                periods, side = period[k], right[k]
                for s, e, p in _crossing(x, y, c, b0 + int(m[k[0]]), d, periods[side], periods[~side], least):
                    if (s == c and c > b0 and x[c - 1] == x[c - 1 + p]) or (e == d and d < end and x[d] == x[d - p]):
                        continue  # the enclosing block holds it whole
                    if found.get((s, e), p + 1) > p:
                        found[s, e] = p
        half *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 4
    s, e, p = np.array([(s, e, p) for (s, e), p in found.items()], np.int64).T
    d = np.searchsorted(first, s, "right") - 1
    order = np.lexsort((p, s, d))
    return d[order], (s - first[d])[order], (e - first[d])[order], p[order]


def collapse(words: S.Words, d: np.ndarray, s: np.ndarray, e: np.ndarray, p: np.ndarray) -> pa.Array:
    """Each document's words that no run contains after its first period, joined by one space."""
    rows = len(words.count)
    inside = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(inside, words.first[d] + s + p, 1)
    np.add.at(inside, words.first[d] + e, -1)
    kept = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
    start, end, row = words.start[kept], words.end[kept], words.row[kept]
    # a white byte follows each word; it is kept as a blank but after a row's last
    edge = np.zeros(len(words.data) + 1, np.int8)
    edge[start] += 1
    data = words.data.copy()
    data[end] = 0x20
    final = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    stop = end + 1 - final
    edge[stop] -= 1
    out = data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    off = np.concatenate(([0], np.cumsum(np.bincount(row, stop - start, minlength=rows).astype(np.int64))))
    return pa.Array.from_buffers(pa.large_string(), rows, [None, pa.py_buffer(off), pa.py_buffer(out)])


def _pieces(rb: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in slices of SLICE_BYTES of text, one row at least."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(rb.column(column)), 0)).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < rb.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + SLICE_BYTES, "right")))
        yield rb.slice(at, to - at)
        at = to


def _runs(least: int):
    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for whole in it:
                for rb in _pieces(whole, "_text"):
                    raw, off, _ = S.column_bytes(pa.Table.from_batches([rb]), "_text")
                    words = S.Words(raw, off)
                    d, s, e, p = find(interned(words), words.first, least)
                    ends = np.concatenate(([0], np.cumsum(np.bincount(d, minlength=rb.num_rows)))).astype(np.int32)
                    runs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(s), pa.array(e - s), pa.array(p)], fields=list(RUN_TYPE)))
                    rest = [rb.column(k) for k, c in enumerate(rb.schema.names) if c != "_text"]
                    names = [c for c in rb.schema.names if c != "_text"]
                    yield pa.RecordBatch.from_arrays([*rest, pa.array(words.count), runs, collapse(words, d, s, e, p).cast(pa.string())], names=[*names, "_n", "_runs", "_collapsed"])
        finally:
            S.release(trim=True)

    return search


def find_runs(docs: DataFrame, text: str = "text", least: int = 12, keep: list[str] | None = None) -> DataFrame:
    """Every row's columns to keep (all others by default) with n_words, runs and collapsed_text.

    A run (start, length, period, in words from 0) is a stretch whose words q apart are equal, q the smallest such
    number, of at least max(least, 2 * q) words, that no neighbouring word extends; runs come by start, then period. A
    word that any run holds after the run's first q words is dropped from collapsed_text. Nothing is shuffled, and a
    text's work is n log n in its words. A null or empty text has no words, no runs and an empty collapsed text;
    repeated rows are rows of their own; a column named like one of the result's cannot be kept beside it and has to
    be renamed or left out; an empty table gives none.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    rows = docs.select(*(F.col(c).alias(f"_{k}") for k, c in enumerate(keep)), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    schema = StructType([f for f in rows.schema.fields if f.name != "_text"]).add("_n", "long").add("_runs", DataType.fromDDL(RUNS)).add("_collapsed", "string")
    out = rows.mapInArrow(_runs(least), schema)
    return out.select(*(F.col(f"_{k}").alias(c) for k, c in enumerate(keep)), F.col("_n").alias("n_words"), F.col("_runs").alias("runs"), F.col("_collapsed").alias("collapsed_text"))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """find_runs' rows to counts, the longest run (ties: smallest start, then period) and hashes of the runs and of the collapsed text."""
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    rows = found.select(key, F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"))
    return rows.select(key, "n_runs", (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.period")).alias("period"), F.expr("(1000 * b.length) div (-b.period)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def with_planted_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs whose text repeats from some word on, in the tenth of them whose key's CRC-32 ends in 0.

    With h the CRC-32 of the decimal key, g = h div 10, a = g % n and p = 1 + (n - a) div (3 + g % 8), word i >= a
    becomes word a + (i - a) % p. A null key or a text without words stays.
    """
    h: Column = F.crc32(F.col(key).cast("string").cast("binary"))
    words = "array(named_struct('ws', regexp_extract_all(_t, '[^\\\\x20\\\\x09-\\\\x0D]+', 0), 'g', _h div 10))"
    placed = f"transform({words}, x -> struct(x.ws as ws, cast(x.g % greatest(size(x.ws), 1) as int) as a, cast(3 + x.g % 8 as int) as q))"
    sized = f"transform({placed}, x -> struct(x.ws as ws, x.a as a, cast(1 + (size(x.ws) - x.a) div x.q as int) as p))"
    edited = f"transform({sized}, x -> array_join(transform(x.ws, (w, i) -> if(i >= x.a, x.ws[x.a + (i - x.a) % x.p], w)), ' '))[0]"
    rows = docs.withColumn("_h", h).withColumn("_t", F.col(text).cast("string"))
    return rows.withColumn(text, F.expr(f"if(_h % 10 = 0, {edited}, _t)")).drop("_h", "_t")
