"""Suffix-array deduplication: removes bytes in any string of ``length`` bytes that also starts elsewhere.

The suffix array is built by the difference-cover algorithm (sort sampled triples, recurse on their names, merge the
remaining suffixes) and equal strings are found by comparing adjacent prefixes. It is distributed by content, so that
equal strings always meet and no task holds the corpus:

1. The anchor of a string is the place of the smallest hash of ``GRAM`` bytes in it. Strings that start side by side
   and have the same anchor form a segment; equal strings have equal anchors. Each batch of documents asks once for
   each distinct segment. A segment that occurs twice is repeated whole; an anchor with one segment has no more to
   give; what is left are segments that share their anchor with different ones.
2. Strings of these whose hash occurs once are not repeated.
3. The rest of the text goes to suffix arrays by anchor, each distinct stretch once a batch, and these decide.

A passage that a third of all documents hold costs a partition no more than one entry a batch in any step.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _shared as S

GRAM = 32
#: Bytes of text in a batch at any size of the input: a worker takes about 100 bytes of memory for each.
BATCH_BYTES = 2 << 20
#: Anchors of a part are dealt to so many slots; a suffix array takes slots of at least so many bytes of text.
SLOTS, ARRAY_BYTES = 64, 2 << 20


# ---------------------------------------------------------------- the difference-cover algorithm


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of t (integers above 0, below 2**31) in order."""
    n = len(t)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    s = np.concatenate((t.astype(np.int64), np.zeros(3, np.int64)))
    # sampled: places 1 and 2 modulo 3, and one more where the first kind would end the text
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    names, distinct = _names(s, sample)
    if distinct == len(sample):
        by_rank = np.argsort(names)
    else:
        by_rank = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[by_rank]] = np.arange(1, len(sample) + 1)
    sample = sample[by_rank]
    sample = sample[sample < n]
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(s[rest] << 32 | rank[rest + 1], kind="stable")]
    # merge: how many sampled suffixes of either kind come before each of the rest
    first, second = sample[sample % 3 == 1], sample[sample % 3 == 2]
    before = np.searchsorted(s[first] << 32 | rank[first + 1], s[rest] << 32 | rank[rest + 1])
    pair = np.unique(np.concatenate((s[second] << 32 | s[second + 1], s[rest] << 32 | s[rest + 1])), return_inverse=True)[1]
    before += np.searchsorted(pair[: len(second)] << 32 | rank[second + 2], pair[len(second) :] << 32 | rank[rest + 2])
    out = np.empty(n, np.int64)
    place = np.zeros(n, bool)
    at = before + np.arange(len(rest))
    place[at] = True
    out[at] = rest
    out[~place] = sample
    return out


def _names(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks from 1 of the triples at these places, and how many differ."""
    a, b, c = s[at], s[at + 1], s[at + 2]
    if s.max() < 1 << 20:
        key = a << 40 | b << 20 | c
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order]) != 0
    else:
        order = np.lexsort((c, b, a))
        x, y, z = a[order], b[order], c[order]
        new = (np.diff(x) != 0) | (np.diff(y) != 0) | (np.diff(z) != 0)
    rank = np.concatenate(([1], 1 + np.cumsum(new)))
    out = np.empty(len(at), np.int64)
    out[order] = rank
    return out, int(rank[-1])


def equal_prefixes(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Class numbers of the strings of ``length`` bytes at these starts: equal strings, equal numbers."""
    order = suffix_array(text.astype(np.int64) + 1)
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    order = order[wanted[order]]
    same = np.zeros(len(order), bool)
    step = max(1, (8 << 20) // length)
    for a in range(1, len(order), step):
        x, y = order[a - 1 : a - 1 + step][: len(order) - a], order[a : a + step]
        same[a : a + len(y)] = (text[x[:, None] + np.arange(length)] == text[y[:, None] + np.arange(length)]).all(1)
    number = np.empty(len(text), np.int64)
    number[order] = np.cumsum(~same)
    return number[starts]


# ---------------------------------------------------------------- passes over batches


class _Segments:
    """The segments of a batch; asks for each distinct one."""

    def __init__(self, length: int, parts: int):
        self.length, self.parts = length, parts

    def find(self, t):
        """Bytes, row offsets, prefix hash, and for each segment the first and last string start, the anchor's hash and 96 bits of its own."""
        raw, off, _ = S.column_bytes(t)
        n, k, length = len(raw), GRAM, self.length
        p = S.prefix_hash(S.BYTE_VALUES[raw], S.BASES[0])
        if n < length:
            z = np.zeros(0, np.int64)
            return raw, off, p, z, z, z.astype(np.uint64), z.astype(np.uint64), z.astype(np.uint32)
        grams = np.arange(n - k + 1)
        g = S.span_hash(p, grams, grams + k, S.BASES[0])
        low = g & np.uint64(0xFFFFFFFF00000000) | grams.astype(np.uint64)
        have, want = 1, length - k + 1
        while have * 2 <= want:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < want:
            low = np.minimum(low[: len(low) - (want - have)], low[want - have :])
        anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ok = np.zeros(len(anchor) + 1, np.int32)
        lens = np.diff(off)
        long_ = np.flatnonzero(lens >= length)
        ok[off[long_]] += 1
        np.add.at(ok, off[long_] + lens[long_] - length + 1, -1)
        ok = np.cumsum(ok[:-1]) > 0
        start = ok.copy()
        start[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1])
        start[off[long_]] = True
        end = ok.copy()
        end[:-1] &= ~ok[1:] | start[1:]
        a, b = np.flatnonzero(start), np.flatnonzero(end)
        h1 = S.span_hash(p, a, b + length, S.BASES[0])
        q = S.prefix_hash(S.BYTE_VALUES[raw], S.BASES[1])
        h2 = (S.span_hash(q, a, b + length, S.BASES[1]) >> np.uint64(32)).astype(np.uint32)
        return raw, off, p, a, b, S.mix(g[anchor[a]]), h1, h2

    def derive(self, t) -> bytes:
        """What later passes need of a batch's segments, made once: where each is, and the distinct ones with their hashes."""
        *_, a, b, anchor, h1, h2 = self.find(t)
        order = np.lexsort((h2, h1, anchor))
        x, y, z = anchor[order], h1[order], h2[order]
        new = np.ones(len(order), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])
        first = np.flatnonzero(new)
        place = np.empty(len(order), np.int32)
        place[order] = np.cumsum(new) - 1
        multi = np.diff(np.append(first, len(order))) > 1
        return b"".join((np.array([len(a), len(first)], np.int64).tobytes(), x[first].tobytes(), y[first].tobytes(), z[first].tobytes(), order[first].astype(np.int32).tobytes(), a.astype(np.int64).tobytes(), (b - a).astype(np.int32).tobytes(), place.tobytes(), S.bits(multi)))

    @staticmethod
    def keys(t):
        """First and last string start of each segment, its number among the distinct ones, and of these a segment, whether there are several, and the hashes."""
        data = t.schema.metadata[b"keys"]
        n, m = np.frombuffer(data, np.int64, 2).tolist()
        at, out = 16, []
        for kind, k in ((np.uint64, m), (np.uint64, m), (np.uint32, m), (np.int32, m), (np.int64, n), (np.int32, n), (np.int32, n)):
            out.append(np.frombuffer(data, kind, k, at))
            at += out[-1].nbytes
        x, y, z, one, a, wide, place = out
        return a, a + wide, place, one, S.unbits(data[at:], m), x, y, z

    def __call__(self, batch, t):
        *_, multi, x, y, z = self.keys(t)
        for p, a, b in S.slices(x, self.parts):
            yield p, x[a:b].tobytes() + y[a:b].tobytes() + z[a:b].tobytes() + S.bits(multi[a:b])


def _answer_segments(p, asked):
    """For each segment: whether it occurs twice, whether its anchor has another segment too, whether this batch is its first."""
    xs, ys, zs, ms, ns = [], [], [], [], []
    for r in asked:
        r = bytes(r)
        n = len(r) * 8 // 161
        while 20 * n + (n + 7) // 8 < len(r):
            n += 1
        xs.append(np.frombuffer(r, np.uint64, n))
        ys.append(np.frombuffer(r, np.uint64, n, 8 * n))
        zs.append(np.frombuffer(r, np.uint32, n, 16 * n))
        ms.append(S.unbits(r[20 * n :], n))
        ns.append(n)
    x, y, z, m = map(np.concatenate, (xs, ys, zs, ms))
    order = np.lexsort((z, y, x))  # stable: batches stay in order
    x, y, z, m = x[order], y[order], z[order], m[order]
    new_anchor = np.ones(len(x), bool)
    new_anchor[1:] = x[1:] != x[:-1]
    new = new_anchor.copy()
    new[1:] |= (y[1:] != y[:-1]) | (z[1:] != z[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(x)))
    twice = np.repeat((size > 1) | np.logical_or.reduceat(m, first), size)
    groups = np.flatnonzero(new_anchor)
    mixed = np.repeat(np.add.reduceat(new, groups) > 1, np.diff(np.append(groups, len(x))))
    out = np.empty((3, len(x)), bool)
    out[:, order] = np.stack((twice, mixed, new))
    cut = np.cumsum(ns)[:-1]
    return [b"".join(S.bits(v) for v in part) for part in np.split(out, cut, axis=1)]


class _Strings:
    """The strings of segments whose anchor has several; asks by hash whether each occurs twice."""

    def __init__(self, segments: _Segments, told: str, parts: int):
        self.segments, self.told, self.parts = segments, told, parts

    def keys(self, batch, t):
        a, b, place, one, _, x, _, _ = self.segments.keys(t)
        raw, off, _ = S.column_bytes(t)
        flags, told = np.zeros((3, len(x)), bool), S.replies(self.told, batch)
        for q, i, j in S.slices(x, self.segments.parts):
            k = (j - i + 7) // 8
            for f in range(3):
                flags[f, i:j] = S.unbits(told[q][f * k : (f + 1) * k], j - i)
        twice, mixed, here = flags
        # one segment of each kind that is to be looked at further, by its first place in the batch
        look = np.flatnonzero(mixed & (~twice | here))
        seg = one[look]
        n = b[seg] - a[seg] + 1
        of = np.repeat(np.arange(len(seg)), n)
        start = a[seg][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        h = S.span_hash(S.prefix_hash(S.BYTE_VALUES[raw], S.BASES[0]), start, start + self.segments.length, S.BASES[0])
        return raw, off, a, b, place, twice, look, x[look], of, start, h

    def __call__(self, batch, t):
        *_, twice, look, _, of, _, h = self.keys(batch, t)
        order = np.argsort(h)
        s = h[order]
        first = S.runs(s)
        multi = np.diff(np.append(first, len(s))) > 1
        if len(s):
            multi |= np.logical_or.reduceat(twice[look][of][order], first)
        u = s[first]
        for p, i, j in S.slices(u, self.parts):
            yield p, np.ascontiguousarray(u[i:j].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes() + S.bits(multi[i:j])


def _answer_strings(p, asked):
    hs, ms, ns = [], [], []
    for r in asked:
        r = np.frombuffer(r, np.uint8)
        n = len(r) * 8 // 49
        while 6 * n + (n + 7) // 8 < len(r):
            n += 1
        h = np.zeros((n, 8), np.uint8)
        h[:, :6] = r[: 6 * n].reshape(n, 6)
        hs.append(h.reshape(-1).view(np.uint64))
        ms.append(S.unbits(r[6 * n :].tobytes(), n))
        ns.append(n)
    h, m = np.concatenate(hs), np.concatenate(ms)
    order = np.argsort(h)
    first = S.runs(h[order])
    size = np.diff(np.append(first, len(h)))
    out = np.empty(len(h), bool)
    out[order] = np.repeat((size > 1) | np.logical_or.reduceat(m[order], first), size)
    return [S.bits(v) for v in np.split(out, np.cumsum(ns)[:-1])]


class _Stretches:
    """Stretches of strings that may be repeated, to the suffix array of their anchor's part."""

    def __init__(self, strings: _Strings, told: str, parts: int):
        self.strings, self.told, self.parts = strings, told, parts

    def keys(self, batch, t):
        raw, off, a, b, place, twice, look, anchors, of, start, h = self.strings.keys(batch, t)
        order = np.argsort(h)
        s = h[order]
        first = S.runs(s)
        u, live, told = s[first], np.zeros(len(first), bool), S.replies(self.told, batch)
        for p, i, j in S.slices(u, self.strings.parts):
            live[i:j] = S.unbits(told[p], j - i)
        maybe = np.empty(len(h), bool)
        maybe[order] = np.repeat(live, np.diff(np.append(first, len(s))))
        new = maybe.copy()
        new[1:] &= ~(maybe[:-1] & (of[1:] == of[:-1]))
        last = maybe.copy()
        last[:-1] &= ~(maybe[1:] & (of[1:] == of[:-1]))
        i, j = np.flatnonzero(new), np.flatnonzero(last)
        return raw, off, a, b, place, twice, look, anchors, of, start, i, j

    def entries(self, batch, t):
        """By part: {(anchor, text): [whether its strings are known to be repeated, the stretches that have it, the anchor's slot]}."""
        raw, off, a, b, place, twice, look, anchors, of, start, i, j = self.keys(batch, t)
        spread = S.mix(anchors[of[i]] ^ np.uint64(0x9E3779B97F4A7C15))
        part = S.part_of(spread, self.parts) if len(i) else i
        slot = (spread % np.uint64(SLOTS)).tolist()
        data, out = raw.tobytes(), {}
        for k in range(len(i)):
            text = data[start[i[k]] : start[j[k]] + self.strings.segments.length]
            known = bool(twice[look[of[i[k]]]])
            mine = out.setdefault(int(part[k]), {})
            had = mine.setdefault((int(anchors[of[i[k]]]), text), [known, [], slot[k]])
            had[0] |= known or bool(had[1])
            had[1].append(k)
        return out, (raw, off, a, b, place, twice, look, of, start, i, j)

    def __call__(self, batch, t):
        for p, mine in self.entries(batch, t)[0].items():
            texts = [x for _, x in mine]
            head = np.array([len(texts), *((len(x) * SLOTS + slot) << 1 | known for x, (known, _, slot) in zip(texts, mine.values(), strict=True))], np.int64)
            yield p, head.tobytes() + b"".join(texts)


def _cuts(sizes: np.ndarray) -> list[int]:
    """Where a new array begins, so that each but the last takes slots of at least ARRAY_BYTES."""
    out, size = [], 0
    for k, x in enumerate(sizes):
        if size >= ARRAY_BYTES:
            out.append(k)
            size = 0
        size += x
    return out


def _sorter(length: int):
    def answer(p, asked):
        """For each string of each stretch, whether the suffix array has another equal to it."""
        texts, known, slots, owners = [], [], [], []
        for k, r in enumerate(asked):
            r = bytes(r)
            n = int(np.frombuffer(r, np.int64, 1)[0])
            head, at = np.frombuffer(r, np.int64, n, 8), 8 * (n + 1)
            for x in head.tolist():
                size = (x >> 1) // SLOTS
                texts.append(r[at : at + size])
                known.append(x & 1)
                slots.append((x >> 1) % SLOTS)
                owners.append(k)
                at += size
        # equal strings have equal anchors, so slots are apart
        n = np.array([len(x) for x in texts]) - length + 1
        ends = np.cumsum(n)
        twice = np.empty(int(n.sum()), bool)
        slots, known = np.array(slots), np.array(known)
        sizes = np.bincount(slots, n + length - 1, SLOTS)
        array = np.searchsorted(_cuts(sizes), np.arange(SLOTS), "right")[slots]
        for x in np.unique(array):
            mine = np.flatnonzero(array == x)
            lens = n[mine] + length - 1
            base = np.cumsum(lens) - lens
            of = np.repeat(np.arange(len(mine)), n[mine])
            place = np.arange(len(of)) - np.repeat(np.cumsum(n[mine]) - n[mine], n[mine])
            number = equal_prefixes(np.frombuffer(b"".join([texts[k] for k in mine]), np.uint8), base[of] + place, length)
            weight = np.bincount(number, 1 + known[mine][of])
            twice[(ends - n)[mine][of] + place] = weight[number] > 1
        out, owners = [], np.array(owners)
        for k in range(len(asked)):
            mine = np.flatnonzero(owners == k)
            out.append(S.bits(twice[ends[mine[0]] - n[mine[0]] : ends[mine[-1]]]) if len(mine) else b"")
        return out

    return answer


class _Cut:
    def __init__(self, stretches: _Stretches, told: str, key: str, text: bool):
        self.stretches, self.told, self.key, self.text = stretches, told, key, text

    def __call__(self, it):
        length = self.stretches.strings.segments.length
        for batch, t in S.batches(it):
            entries, (raw, off, a, b, place, twice, look, of, start, i, j) = self.stretches.entries(batch, t)
            told = S.replies(self.told, batch)
            cover = np.zeros(len(raw) + 1, np.int32)
            whole = twice[place]
            np.add.at(cover, a[whole], 1)
            np.add.at(cover, b[whole] + length, -1)
            for p, mine in entries.items():
                n = [len(x) - length + 1 for _, x in mine]
                got, at = S.unbits(told[p], sum(n)), 0
                for k, (_, own, _) in zip(n, mine.values(), strict=True):
                    hit = np.flatnonzero(got[at : at + k])
                    at += k
                    for e in own:
                        np.add.at(cover, start[i[e]] + hit, 1)
                        np.add.at(cover, start[i[e]] + hit + length, -1)
            gone = np.cumsum(cover[:-1]) > 0
            yield self.result(t, raw, off, gone)

    def result(self, t, raw, off, gone):
        lost = np.concatenate(([0], np.cumsum(gone)))
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        row_first = off[:-1][np.diff(off) > 0]
        begin[row_first] = gone[row_first]
        spans = np.concatenate(([0], np.cumsum(begin)))
        kept = raw[~gone].tobytes()
        at = (off - lost[off]).tolist()
        texts = [kept[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
        cols = {"doc_id": t.column(self.key).combine_chunks(), "n_bytes": pa.array(np.diff(off)), "n_removed": pa.array(np.diff(lost[off]).astype(np.int64)), "n_spans": pa.array(np.diff(spans[off]).astype(np.int64)), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())}
        if self.text:
            cols["kept_text"] = pa.array([x.decode("utf-8", "ignore") for x in texts], pa.string())
            cols |= {c: t.column(c).combine_chunks() for c in t.column_names if c not in ("doc_id", "text")}
        return pa.RecordBatch.from_arrays([x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in cols.values()], names=list(cols))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, keep: list[str] | None = None) -> DataFrame:
    """Removes each byte in a string of ``length`` bytes that also starts anywhere else, in the same document or another.

    Returns (key, n_bytes, n_removed, n_spans, kept_sha256), one row per input row; with keep (column names, maybe
    none) also kept_text and these columns, with _in after a name that the result has too. In kept_text, bytes of a character that was cut in two are dropped.
    Strings are judged on the input and never cross rows. A null text is empty; null and repeated keys are ordinary
    rows; other columns are ignored; an empty table gives none. ``length`` is at least 32.
    """
    if length < GRAM:
        raise ValueError(f"strings of at least {GRAM} bytes")
    spark, root = docs.sparkSession, S.shared_root(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *(F.col(c).alias(f"_{c}") for c in keep or []))
    staged = S.stage(rows, f"{root}/docs", BATCH_BYTES, derive=_Segments(length, 0).derive)
    total = staged.agg(F.sum("n_bytes")).first()[0] or 0
    segments = _Segments(length, S.parts_for(spark, total / 4))
    one = S.exchange(staged.drop("data"), segments, _answer_segments, segments.parts, f"{root}/segments")
    strings = _Strings(segments, one, S.parts_for(spark, total / 2))
    two = S.exchange(staged, strings, _answer_strings, strings.parts, f"{root}/strings")
    stretches = _Stretches(strings, two, S.parts_for(spark, total / 2))
    three = S.exchange(staged, stretches, _sorter(length), stretches.parts, f"{root}/suffixes")
    kinds = dict(rows.dtypes)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" + "".join(f", `_{c}` {kinds[f'_{c}']}" for c in keep) if keep is not None else "")
    out = S.materialised(staged.select("batch", "data", "keys").mapInArrow(_Cut(stretches, three, "doc_id", keep is not None), schema), f"{root}/result")
    for x in ("docs", "segments", "strings", "suffixes"):
        S.remove(f"{root}/{x}")
    out = out.withColumnRenamed("doc_id", key)
    taken = {key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"}
    for c in keep or []:
        out = out.withColumnRenamed(f"_{c}", f"{c}_in" if c in taken else c)
    return out
