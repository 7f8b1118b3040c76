"""Jaccard join of word n-gram sets with signature trees.

1. Documents with the same words in order are one class; one of them stands for it.
2. Tokens (hashed shingles) have a global order: those that a fixed-size count sketch shows to be frequent come last,
   else by hash. Two sets that are similar enough share a token among the first ``n - ceil(t n) + 1`` of each, so these
   are looked up in a shared index, and each token that two classes have tells the smallest class that has it.
3. Classes that were told the same smallest class meet in one group; a group that is too large for a task becomes pairs
   of blocks.
4. In a group a signature tree (nodes with the OR of their sets' bitmaps, the bits that all of them have, and size
   ranges) is walked against itself: node pairs whose largest possible overlap is too small are dropped, the rest go
   down to pairs of sets, which are compared exactly, most alike first, unless already joined.
5. Links become components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _shared as S
from .components import components

#: Counters of the frequency sketch, whatever the corpus.
SKETCH = 1 << 20
#: Sets that one task compares with each other.
BLOCK_SETS = 2000
#: Sets of a leaf of the signature tree.
LEAF = 32
BATCH_BYTES = 2 << 20
SEQ = 18  # bits of a row in its batch, which holds S.BATCH_ROWS at most
TOKEN, LOW = np.uint64(46), np.uint64((1 << 46) - 1)
#: Share of a set, in percent, that its longer prefix has beyond the shortest one that must meet a partner's.
BEYOND = 15


def shingle_hashes(w: S.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all n-word shingles; rows with fewer words have their whole sequence."""
    h = w.hashes()
    at, g = w.windows(h, n)
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    whole = S.span_hash(S.prefix_hash(h, S.BASES[1]), w.first[short], w.first[short + 1], S.BASES[1])
    return np.concatenate((w.row[at], short)), np.concatenate((g, S.mix(whole + w.count[short].astype(np.uint64))))


def set_sizes(w: S.Words, n: int) -> np.ndarray:
    """Number of distinct shingles of each row, by all 64 bits."""
    row, g = shingle_hashes(w, n)
    order = np.lexsort((g, row))
    row, g = row[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (row[1:] != row[:-1]) | (g[1:] != g[:-1])
    return np.bincount(row[new], minlength=len(w.count)).astype(np.int64)


def sequence_keys(w: S.Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each row's words in order."""
    h = w.hashes()
    n = w.count.astype(np.uint64)
    return tuple(S.mix(S.span_hash(S.prefix_hash(h, b), w.first[:-1], w.first[1:], b) + n) for b in S.BASES)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens of a set of n that must hold one of any set that is percent alike."""
    return n - (percent * n + 99) // 100 + 1


class _Base:
    """What each pass makes of a batch: its words, classes and the rows that stand for them."""

    def __init__(self, n: int, parts: int):
        self.n, self.parts = n, parts

    def keys(self, batch, t):
        """Words, node numbers, rows that take part, and the batch's distinct sequence keys with the first row of each."""
        raw, off, _ = S.column_bytes(t)
        w = S.Words(raw, off, lower=True)
        ids, null = S.int_column(t, "doc_id")
        k1, k2 = sequence_keys(w)
        rows = np.flatnonzero((w.count > 0) & ~null)
        order = rows[np.lexsort((rows, ids[rows], k2[rows], k1[rows]))]
        new = np.ones(len(order), bool)
        new[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
        return w, ids, null, k1, k2, order[new]

    def __call__(self, batch, t):
        w, ids, _, k1, k2, first = self.keys(batch, t)
        for p, a, b in S.slices(k1[first], self.parts):
            x = first[a:b]
            yield p, k1[x].tobytes() + k2[x].tobytes() + ids[x].tobytes() + (batch << SEQ | x).tobytes()


def _answer_classes(p, asked):
    """Whether a batch's row is the class's first by (doc_id, node)."""
    xs = [np.frombuffer(x, np.int64).reshape(4, -1) for x in asked]
    k1, k2, ids, node = np.concatenate(xs, axis=1)
    order = np.lexsort((node, ids, k2, k1))
    new = np.ones(len(order), bool)
    new[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
    out = np.empty(len(order), bool)
    out[order] = new
    return [S.bits(x) for x in np.split(out, np.cumsum([x.shape[1] for x in xs])[:-1])]


class _Sets:
    """The sets of the rows that stand for their classes, as sorted row << 46 | token, tokens being 46 bits of hash."""

    def __init__(self, base: _Base, classes: str):
        self.base, self.classes = base, classes

    def sets(self, batch, t):
        w, ids, _, k1, _, first = self.base.keys(batch, t)
        told = S.replies(self.classes, batch)
        stands = np.zeros(len(first), bool)
        for p, a, b in S.slices(k1[first], self.base.parts):
            stands[a:b] = S.unbits(told[p], b - a)
        chosen = np.zeros(len(w.count), bool)
        chosen[first[stands]] = True
        row, g = shingle_hashes(w, self.base.n)
        keep = chosen[row]
        x = np.sort(row[keep].astype(np.uint64) << TOKEN | g[keep] >> np.uint64(64 - 46))
        if len(x):
            x = x[np.append(True, x[1:] != x[:-1])]
        row = (x >> TOKEN).astype(np.int64)
        return row, x & LOW, np.bincount(row, minlength=len(w.count)).astype(np.int64)


class _Count:
    """A task's counts of the tokens of its sets, by sketch cell, in pieces."""

    def __init__(self, sets: _Sets, pieces: int = 16):
        self.sets, self.pieces = sets, pieces

    def __call__(self, it):
        counts = np.zeros(SKETCH, np.int64)
        for batch, t in S.batches(it):
            _, g, _ = self.sets.sets(batch, t)
            counts += np.bincount((g % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        if counts.any():
            for k, x in enumerate(np.split(counts, self.pieces)):
                yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "counts": pa.array([x.tobytes()], pa.binary())})


def _sum_counts(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in t.column("counts"))
    return pa.table({"piece": t.column("piece").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


class _Prefix:
    """Asks for the first tokens of each set."""

    def __init__(self, sets: _Sets, frequent: np.ndarray, percent: int, parts: int):
        self.sets, self.frequent, self.percent, self.parts = sets, frequent, percent, parts

    def keys(self, batch, t):
        """Rows, tokens and sizes of the sets; the longer prefixes' (token, owner), sorted, which are of the shortest, and where each token starts."""
        row, g, n = self.sets.sets(batch, t)
        late = np.unpackbits(self.frequent, count=SKETCH)[(g % np.uint64(SKETCH)).astype(np.int64)].astype(np.int64)
        # frequent tokens rank after the others of their set
        before = np.cumsum(late) - late
        at = np.arange(len(row))
        head = np.searchsorted(row, np.arange(len(n)))
        lates = np.bincount(row, late, len(n)).astype(np.int64)
        late_before = before - before[np.minimum(head, max(0, len(row) - 1))][row] if len(row) else before
        inside = at - head[row]
        rank = np.where(late > 0, (n - lates)[row] + late_before, inside - late_before)
        need = prefix_length(n, self.percent)
        pick = np.flatnonzero(rank < (need + beyond(n))[row])
        x = g[pick] << np.uint64(SEQ) | row[pick].astype(np.uint64)
        order = np.argsort(x)
        x, short = x[order], (rank[pick] < need[row[pick]])[order]
        tok, owner = x >> np.uint64(SEQ), (x & np.uint64((1 << SEQ) - 1)).astype(np.int64)
        return row, g, n, tok, owner, short, S.runs(tok)

    def spread(self, tok):
        return tok << np.uint64(64 - 46)

    def __call__(self, batch, t):
        *_, tok, owner, _, start = self.keys(batch, t)
        multi = np.diff(np.append(start, len(tok))) > 1
        u = tok[start]
        for p, a, b in S.slices(self.spread(u), self.parts):
            yield p, batch.to_bytes(8, "little") + owner[start][a:b].astype(np.uint32).tobytes() + np.ascontiguousarray(u[a:b].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes() + S.bits(multi[a:b])


def beyond(n: np.ndarray) -> np.ndarray:
    """Tokens of a set's prefix beyond the shortest."""
    return n * BEYOND // 100


def _answer_tokens(p, asked):
    """For each token whether two classes have it, and for those the smallest class that does."""
    toks, nodes, multi, sizes = [], [], [], []
    for x in asked:
        raw = bytes(x)
        batch, n = int.from_bytes(raw[:8], "little"), (len(raw) - 8) * 8 // 81
        while 10 * n + (n + 7) // 8 < len(raw) - 8:
            n += 1
        h = np.zeros((n, 8), np.uint8)
        h[:, :6] = np.frombuffer(raw, np.uint8, 6 * n, 8 + 4 * n).reshape(n, 6)
        toks.append(h.reshape(-1).view(np.uint64))
        nodes.append(batch << SEQ | np.frombuffer(raw, np.uint32, n, 8).astype(np.int64))
        multi.append(S.unbits(raw[8 + 10 * n :], n))
        sizes.append(n)
    tok, node, more = np.concatenate(toks), np.concatenate(nodes), np.concatenate(multi)
    order = np.argsort(tok)
    first = S.runs(tok[order])
    length = np.diff(np.append(first, len(tok)))
    live = np.empty(len(tok), bool)
    live[order] = np.repeat((length > 1) | np.logical_or.reduceat(more[order], first), length)
    least = np.empty(len(tok), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(node[order], first), length)
    cut = np.cumsum(sizes)[:-1]
    return [S.bits(a) + b[a].tobytes() for a, b in zip(np.split(live, cut), np.split(least, cut), strict=True)]


class _Groups:
    """Each set that may have a partner with the smallest classes its tokens were told of; asks how many sets each of those has."""

    def __init__(self, prefix: _Prefix, told: str, parts: int):
        self.prefix, self.told, self.parts = prefix, told, parts

    def keys(self, batch, t):
        row, g, n, tok, owner, short, start = self.prefix.keys(batch, t)
        u, told = tok[start], S.replies(self.told, batch)
        least = np.full(len(u), -1, np.int64)
        for p, a, b in S.slices(self.prefix.spread(u), self.prefix.parts):
            k = (b - a + 7) // 8
            live = S.unbits(told[p][:k], b - a)
            least[a:b][live] = np.frombuffer(told[p][k:], np.int64)
        pivot = np.repeat(least, np.diff(np.append(start, len(tok))))
        # a partner is no smaller than the share asked for of this set, so at least so many of the longer prefix are shared
        shared = np.bincount(owner[pivot >= 0], minlength=len(n))
        partner = (n * self.prefix.percent + 99) // 100
        enough = shared >= 1 + beyond(partner)
        use = (pivot >= 0) & short & enough[owner]
        pair = np.unique(np.stack([pivot[use], owner[use]]), axis=1) if use.any() else np.zeros((2, 0), np.int64)
        return row, g, n, pair[0], pair[1]

    def __call__(self, batch, t):
        *_, pivot, _ = self.keys(batch, t)
        first = S.runs(pivot)
        counts = np.diff(np.append(first, len(pivot))).astype(np.uint32)
        h = S.mix(pivot[first].astype(np.uint64))
        order = np.argsort(h)
        for p, a, b in S.slices(h[order], self.parts):
            yield p, h[order][a:b].tobytes() + counts[order][a:b].tobytes()


def _answer_sizes(p, asked):
    ns = [len(x) // 12 for x in asked]
    h = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(asked, ns, strict=True)])
    c = np.concatenate([np.frombuffer(x, np.uint32, n, 8 * n) for x, n in zip(asked, ns, strict=True)])
    order = np.argsort(h)
    first = S.runs(h[order])
    total = np.add.reduceat(c[order].astype(np.int64), first)
    out = np.empty(len(h), np.int64)
    out[order] = np.repeat(total, np.diff(np.append(first, len(h))))
    return [x.tobytes() for x in np.split(out, np.cumsum(ns)[:-1])]


class _Send:
    """Each set to its groups: rows (p, pivot, i, j, node, n, tokens of 6 bytes)."""

    def __init__(self, groups: _Groups, sizes: str, tasks: int):
        self.groups, self.sizes, self.tasks = groups, sizes, tasks

    def __call__(self, it):
        for batch, t in S.batches(it):
            row, g, n, pivot, owner = self.groups.keys(batch, t)
            if not len(pivot):
                continue
            first = S.runs(pivot)
            h = S.mix(pivot[first].astype(np.uint64))
            order, total, told = np.argsort(h), np.empty(len(first), np.int64), S.replies(self.sizes, batch)
            for p, a, b in S.slices(h[order], self.groups.parts):
                total[order[a:b]] = np.frombuffer(told[p], np.int64)
            total = np.repeat(total, np.diff(np.append(first, len(pivot))))
            at = np.searchsorted(row, np.arange(len(n) + 1))
            packed = np.ascontiguousarray(g.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
            out = [[], [], [], [], [], []]
            for q, o, m in zip(pivot.tolist(), owner.tolist(), total.tolist(), strict=True):
                if m < 2:
                    continue
                blocks = -(-m // BLOCK_SETS)
                node = batch << SEQ | o
                own = int(S.mix(np.array([node], np.uint64))[0]) % blocks
                for other in range(blocks):
                    i, j = min(own, other), max(own, other)
                    key = int(S.mix(np.array([(q * 1_000_003 + i * 1009 + j) & S.M64], np.uint64))[0])
                    for x, v in zip(out, (key % self.tasks, q, i << 20 | j, own, node, packed[6 * at[o] : 6 * at[o + 1]]), strict=True):
                        x.append(v)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["p", "pivot", "blocks", "own", "node", "tokens"])


# ---------------------------------------------------------------- in a group


class Tree:
    """A signature tree over sets: leaves of LEAF sets in order of size and bitmap, nodes of two."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((bitmaps[:, 0], sizes))
        self.levels = []
        b, s = bitmaps[self.order], sizes[self.order]
        cut = np.arange(0, len(s), LEAF)
        any_, all_ = np.bitwise_or.reduceat(b, cut, axis=0), np.bitwise_and.reduceat(b, cut, axis=0)
        low, high = np.minimum.reduceat(s, cut), np.maximum.reduceat(s, cut)
        while True:
            self.levels.append((any_, all_, low, high))
            if len(low) == 1:
                return
            cut = np.arange(0, len(low), 2)
            any_, all_ = np.bitwise_or.reduceat(any_, cut, axis=0), np.bitwise_and.reduceat(all_, cut, axis=0)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)

    def leaf_pairs(self, percent: int):
        """Pairs of leaves that may hold sets alike enough, by a walk of the tree against itself."""
        todo = [(len(self.levels) - 1, 0, 0)]
        while todo:
            k, a, b = todo.pop()
            any_, all_, low, high = self.levels[k]
            if a != b:
                # each set of one side lacks, of every set of the other, at least the bits that all of its own have and none there has
                lack_a = int(np.bitwise_count(all_[a] & ~any_[b]).sum())
                lack_b = int(np.bitwise_count(all_[b] & ~any_[a]).sum())
                most = min(high[a] - lack_a, high[b] - lack_b)
                least = max(low[a], low[b])
                # overlap / union is largest for the smallest union that size and overlap allow
                if 100 * most < percent * least or most <= 0:
                    continue
            if k == 0:
                yield a, b
            else:
                n = len(self.levels[k - 1][2])
                for x in range(2 * a, min(2 * a + 2, n)):
                    for y in range(2 * b, min(2 * b + 2, n)):
                        if a != b or x <= y:
                            todo.append((k - 1, x, y))


def links(sets: list[np.ndarray], percent: int, across: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A forest of pairs of sorted token arrays with 100 |a & b| >= percent |a | b|, joining all that such pairs join.

    across: block numbers; where given, only pairs of different blocks need to be looked at.
    """
    n = np.array([len(s) for s in sets])
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def alike(a, b):
        both = np.intersect1d(sets[a], sets[b], assume_unique=True).size
        return 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)

    out = []
    if len(sets) == 2:
        if across is None or across[0] != across[1]:
            return [(0, 1)] if 100 * n.min() >= percent * n.max() and alike(0, 1) else []
        return []
    # about eight bits a token, in words of 64
    words = min(4096, max(4, 1 << int(np.ceil(np.log2(max(1.0, np.median(n) / 8))))))
    bitmaps = np.zeros((len(sets), words), np.uint64)
    for k, s in enumerate(sets):
        bit = s % np.uint64(words * 64)
        np.bitwise_or.at(bitmaps[k], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    tree = Tree(bitmaps, n)
    found = []
    for la, lb in tree.leaf_pairs(percent):
        ra, rb = tree.order[la * LEAF : (la + 1) * LEAF], tree.order[lb * LEAF : (lb + 1) * LEAF]
        A, B, na, nb = bitmaps[ra], bitmaps[rb], n[ra][:, None], n[rb][None, :]
        joint = np.bitwise_count(A[:, None, :] & B[None, :, :]).sum(2, dtype=np.int64)
        own_a, own_b = np.bitwise_count(A).sum(1, dtype=np.int64)[:, None], np.bitwise_count(B).sum(1, dtype=np.int64)[None, :]
        most = np.minimum(na - (own_a - joint), nb - (own_b - joint))
        ok = (most > 0) & (100 * most >= percent * (na + nb - most))
        if la == lb:
            ok &= np.arange(len(ra))[:, None] < np.arange(len(rb))[None, :]
        if across is not None:
            ok &= across[ra][:, None] != across[rb][None, :]
        x, y = np.nonzero(ok)
        if len(x):
            found.append((most[x, y] / (na[x, 0] + nb[0, y] - most[x, y]), ra[x], rb[y]))
    if found:
        near, a, b = (np.concatenate(z) for z in zip(*found, strict=True))
        for k in np.argsort(-near, kind="stable").tolist():
            x, y = int(a[k]), int(b[k])
            tx, ty = top(x), top(y)
            if tx != ty and alike(x, y):
                up[tx] = ty
                out.append((x, y))
    return out


def _joiner(percent: int):
    def join(t: pa.Table) -> pa.Table:
        pivot, blocks, own, node = (np.asarray(t.column(c).combine_chunks()) for c in ("pivot", "blocks", "own", "node"))
        col = t.column("tokens")
        order = np.lexsort((node, blocks, pivot))
        new = np.ones(len(order), bool)
        new[1:] = (pivot[order][1:] != pivot[order][:-1]) | (blocks[order][1:] != blocks[order][:-1])
        a_out, b_out = [], []
        for rows in np.split(order, np.flatnonzero(new)[1:]):
            if len(rows) < 2:
                continue
            sets = []
            for r in rows.tolist():
                raw = np.frombuffer(col[r].as_buffer(), np.uint8).reshape(-1, 6)
                wide = np.zeros((len(raw), 8), np.uint8)
                wide[:, :6] = raw
                sets.append(wide.reshape(-1).view(np.uint64))
            i, j = divmod(int(blocks[rows[0]]), 1 << 20)
            for x, y in links(sets, percent, own[rows] if i != j else None):
                a_out.append(node[rows[x]])
                b_out.append(node[rows[y]])
        return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    return join


class _Rows:
    """(doc_id, k1, k2, node, n_shingles) of every row."""

    def __init__(self, base: _Base):
        self.base = base

    def __call__(self, it):
        for batch, t in S.batches(it):
            w, ids, null, k1, k2, _ = self.base.keys(batch, t)
            n = set_sizes(w, self.base.n)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, mask=null), "k1": pa.array(k1.view(np.int64)), "k2": pa.array(k2.view(np.int64)), "node": pa.array(batch << SEQ | np.arange(len(ids))), "n_shingles": pa.array(n)})


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """(key, n_shingles, component_id) of every row: the smallest key reachable by links, its own included.

    Texts are lower-cased in A-Z and cut to words ``[^\\x20\\x09-\\x0D]+``; a set holds a text's distinct n-word
    shingles, or its whole sequence if shorter, and two link if they are percent alike or more. A text without words
    is linked with nothing; a null key has a null component and links nothing; rows with equal keys are one node where
    their texts are the same; other columns are ignored; an empty table gives none.
    """
    spark, root = docs.sparkSession, S.shared_root(docs.sparkSession)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    staged = S.stage(texts, f"{root}/docs", S.batch_bytes(texts, BATCH_BYTES))
    total = staged.agg(F.sum("n_bytes")).first()[0] or 0
    base = _Base(n, S.parts_for(spark, total / 100))
    rows = S.materialised(staged.select("batch", "data").mapInArrow(_Rows(base), "doc_id long, k1 long, k2 long, node long, n_shingles long"), f"{root}/rows")
    classes = S.exchange(staged, base, _answer_classes, base.parts, f"{root}/classes")
    sets = _Sets(base, classes)
    pieces = staged.select("batch", "data").mapInArrow(_Count(sets), "piece int, counts binary").groupBy("piece").applyInArrow(_typed(_sum_counts), "piece int, counts binary").collect()
    counts = np.concatenate([np.frombuffer(r.counts, np.int64) for r in sorted(pieces, key=lambda r: r.piece)]) if pieces else np.zeros(SKETCH, np.int64)
    frequent = np.packbits(counts > 4 * counts.mean() + 32)
    prefix = _Prefix(sets, frequent, percent, S.parts_for(spark, total / 1.5))
    told = S.exchange(staged, prefix, _answer_tokens, prefix.parts, f"{root}/tokens")
    groups = _Groups(prefix, told, base.parts)
    sizes = S.exchange(staged, groups, _answer_sizes, groups.parts, f"{root}/sizes")
    tasks = 4 * S.parts_for(spark, total / 2)
    sent = staged.select("batch", "data").mapInArrow(_Send(groups, sizes, tasks), "p int, pivot long, blocks long, own int, node long, tokens binary")
    edges = S.materialised(sent.groupBy("p").applyInArrow(_joiner(percent), "a long, b long"), f"{root}/edges")
    # classes, components, and back to rows
    alive = rows.filter("n_shingles > 0 and doc_id is not null")
    first = alive.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "node")).alias("f")).select("k1", "k2", F.col("f.doc_id").alias("least"), F.col("f.node").alias("node"))
    first = S.materialised(first, f"{root}/first")
    found = components(edges, root)
    placed = first.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = S.materialised(placed, f"{root}/placed")
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    known = placed.join(smallest, "root").select("k1", "k2", "component_id")
    out = alive.join(known, ["k1", "k2"]).select("doc_id", "n_shingles", "component_id")
    rest = rows.filter("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = S.materialised(out.unionByName(rest), f"{root}/result")
    for x in ("docs", "classes", "tokens", "sizes", "edges", "rows", "first", "placed"):
        S.remove(f"{root}/{x}")
    return out.withColumnRenamed("doc_id", key)


def _typed(f):
    def g(t: pa.Table) -> pa.Table:
        return f(t)

    return g
