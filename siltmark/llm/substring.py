"""Substring deduplication by fixed-block anchors.

A match of ``window`` words must hold a whole aligned block of ``(window + 1) // 2`` words of the other document. So:

1. index: the non-overlapping blocks of every document, by hash;
2. probe: every rolling window of a block's length in every document is looked up in the index;
3. extend: around each hit, all windows of ``window`` words that hold it are compared by 96 bits of hash with the
   smallest doc_id that has them, which extends hits to maximal exact repeats without pairing documents.

Each batch of documents asks for a hash once, so a passage that a third of all documents share costs its partition one
entry a batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _shared as S


class _Probe:
    def __init__(self, block: int, parts: int):
        self.block, self.parts = block, parts

    def keys(self, w: S.Words, h: np.ndarray):
        """Distinct block-length window hashes of a batch, sorted; per hash whether a block has it and whether two rows do; of each window its start and its hash's place."""
        at, h7 = w.windows(h, self.block)
        order = np.argsort(h7)
        s = h7[order]
        first = S.runs(s)
        row = w.row[at][order]
        if len(s):
            block = np.logical_or.reduceat((w.pos[at] % self.block == 0)[order], first)
            multi = np.maximum.reduceat(row, first) != np.minimum.reduceat(row, first)
        else:
            block = multi = np.zeros(0, bool)
        place = np.empty(len(s), np.int64)
        place[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(s))))
        return s[first], block, multi, at, place

    def __call__(self, batch, t):
        w = S.Words(*S.column_bytes(t)[:2])
        u, block, multi, _, _ = self.keys(w, w.hashes())
        for p, a, b in S.slices(u, self.parts):
            yield p, np.int32(b - a).tobytes() + S.bits(block[a:b]) + S.bits(multi[a:b]) + np.ascontiguousarray(u[a:b].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _answer_probes(p, asked):
    """Live: a block has the hash, and two documents or batches do."""
    hs, flags, sizes = [], [], []
    for x in asked:
        x = np.frombuffer(x, np.uint8)
        n = int(x[:4].view(np.int32)[0])
        k = (n + 7) // 8
        h = np.zeros((n, 8), np.uint8)
        h[:, :6] = x[4 + 2 * k :].reshape(n, 6)
        hs.append(h.reshape(-1).view(np.uint64))
        flags.append(S.unbits(x[4 : 4 + k], n).astype(np.int8) + 2 * S.unbits(x[4 + k : 4 + 2 * k], n).astype(np.int8))
        sizes.append(n)
    h, f = np.concatenate(hs), np.concatenate(flags)
    order = np.argsort(h)
    first = S.runs(h[order])
    length = np.diff(np.append(first, len(h)))
    both = np.bitwise_or.reduceat(f[order], first)
    live = ((both & 1) > 0) & ((length > 1) | ((both & 2) > 0))
    out = np.empty(len(h), bool)
    out[order] = np.repeat(live, length)
    return [S.bits(x) for x in np.split(out, np.cumsum(sizes)[:-1])]


class _Extend:
    """Windows around hits, asked for by 96 bits of hash with the smallest doc_id that this batch has."""

    def __init__(self, probe: _Probe, window: int, parts: int, hits: str, key: str):
        self.probe, self.window, self.parts, self.hits, self.key = probe, window, parts, hits, key

    def keys(self, batch, t, w: S.Words):
        h = w.hashes()
        u, _, _, at, place = self.probe.keys(w, h)
        live = np.zeros(len(u), bool)
        told = S.replies(self.hits, batch)
        for p, a, b in S.slices(u, self.probe.parts):
            live[a:b] = S.unbits(told[p], b - a)
        ids, null = S.int_column(t, self.key)
        near = np.zeros(len(h) + 1, np.int64)
        near[at[live[place]] + 1] = 1
        near = np.cumsum(near)
        n = max(0, len(h) - self.window + 1)
        ok = w.row[:n] == w.row[self.window - 1 :][:n]
        ok &= near[np.arange(n) + self.window - self.probe.block + 1] > near[:n]
        ok &= ~null[w.row[:n]]
        start = np.flatnonzero(ok)
        h1 = w.windows(h, self.window, S.BASES[0], start)[1]
        h2 = (w.windows(h, self.window, S.BASES[1], start)[1] >> np.uint64(32)).astype(np.uint32)
        doc = ids[w.row[start]]
        order = np.lexsort((doc, h2, h1))
        k1, k2 = h1[order], h2[order]
        new = np.ones(len(k1), bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        first = np.flatnonzero(new)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        return k1[first], k2[first], doc[order][first], start, doc, place

    def __call__(self, batch, t):
        k1, k2, doc, *_ = self.keys(batch, t, S.Words(*S.column_bytes(t)[:2]))
        for p, a, b in S.slices(k1, self.parts):
            yield p, k1[a:b].tobytes() + doc[a:b].tobytes() + k2[a:b].tobytes()


def _answer_windows(p, asked):
    """Whether some batch has the window in a document with a smaller doc_id than this batch's smallest."""
    xs = [np.frombuffer(x, np.uint8) for x in asked]
    ns = [len(x) // 20 for x in xs]
    k1 = np.concatenate([x[: 8 * n].view(np.uint64) for x, n in zip(xs, ns, strict=True)])
    doc = np.concatenate([x[8 * n : 16 * n].view(np.int64) for x, n in zip(xs, ns, strict=True)])
    k2 = np.concatenate([np.frombuffer(x[16 * n :].tobytes(), np.uint32) for x, n in zip(xs, ns, strict=True)])
    order = np.lexsort((doc, k2, k1))
    a, b, d = k1[order], k2[order], doc[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.empty(len(order), bool)
    out[order] = least < d
    return [S.bits(x) for x in np.split(out, np.cumsum(ns)[:-1])]


class _Cut:
    def __init__(self, extend: _Extend, answers: str, text: bool):
        self.extend, self.answers, self.text = extend, answers, text

    def __call__(self, it):
        for batch, t in S.batches(it):
            w = S.Words(*S.column_bytes(t)[:2])
            k1, _, least, start, doc, place = self.extend.keys(batch, t, w)
            told = S.replies(self.answers, batch)
            older = np.zeros(len(k1), bool)
            for p, a, b in S.slices(k1, self.extend.parts):
                older[a:b] = S.unbits(told[p], b - a)
            gone = start[(doc > least[place]) | older[place]]
            cover = np.zeros(len(w.start) + self.extend.window + 1, np.int32)
            np.add.at(cover, gone, 1)
            np.add.at(cover, gone + self.extend.window, -1)
            removed = np.cumsum(cover)[: len(w.start)] > 0
            yield self.result(t, w, removed)

    def result(self, t, w: S.Words, removed):
        rows = len(w.count)
        lost = np.bincount(w.row[removed], minlength=rows)
        edge = np.zeros(len(w.data) + 1, np.int8)
        kept = ~removed
        edge[w.start[kept]] = 1
        edge[w.end[kept] + 1] -= 1  # the space after a kept word stays too
        mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
        data = w.data.copy()
        data[S.WHITE[data]] = 0x20
        out = data[mask].tobytes()
        ends = np.concatenate(([0], np.cumsum(mask)))[w.row_start]
        texts = [out[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        cols = {self.extend.key: t.column(self.extend.key).combine_chunks(), "n_words": pa.array(w.count), "n_removed": pa.array(lost.astype(np.int64)), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())}
        if self.text:
            cols["kept_text"] = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in cols.values()], names=list(cols))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 13, keep_text: bool = False) -> DataFrame:
    """Removes each word covered by a window of ``window`` words that also starts in a document with a smaller key.

    Returns (key, n_words, n_removed, kept_sha256[, kept_text]), one row per input row. Windows are judged on the
    input. A null text has no words; a null key neither removes nor loses words; rows with equal keys do not remove
    each other; other columns are ignored. An empty table gives an empty result.
    """
    spark, root = docs.sparkSession, S.shared_root(docs.sparkSession)
    block = (window + 1) // 2
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    staged = S.stage(rows, f"{root}/docs", S.batch_bytes(rows))
    total = staged.agg(F.sum("n_bytes")).first()[0] or 0
    probe = _Probe(block, S.parts_for(spark, total))
    hits = S.exchange(staged, probe, _answer_probes, probe.parts, f"{root}/hits")
    extend = _Extend(probe, window, S.parts_for(spark, total / 2), hits, "doc_id")
    answers = S.exchange(staged, extend, _answer_windows, extend.parts, f"{root}/answers")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    out = S.materialised(staged.select("batch", "data").mapInArrow(_Cut(extend, answers, keep_text), schema), f"{root}/result")
    for x in ("docs", "hits", "answers"):
        S.remove(f"{root}/{x}")
    return out.withColumnRenamed("doc_id", key)
