"""Near-duplicate vectors by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions, shifted and cut into steps of one width; the steps on a few
directions together name a bucket, and there are as many tables of buckets as it takes to miss a pair at the threshold
with a stated chance. Vectors of one bucket are compared exactly. Rows and tables grow with the input by the theory of
such hashing: directions with the logarithm of the number of vectors, tables with a small power of it.

Equal vectors are one node with a count. Buckets of any size are cut into blocks, and pairs of blocks are compared as
matrix products, each in a task's bounded memory; no pair leaves a task, only a count and a root for each vector. A pair
that meets in several tables is counted in the first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _shared as S
from .ann import usable
from .components import components

#: Step on a projection; about where pairs at a cosine of 0.93 and unrelated ones are told apart best.
WIDTH = 2.0
#: Chance that a pair right at the threshold meets in no table.
MISS = 0.005
#: Vectors of a block of a large bucket, on average.
BLOCK = 512
#: Doubles of a product of blocks that are held at once, and rows that are taken together.
HELD, TAKEN = 1 << 22, 8192


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that two vectors so far apart share a step on one direction."""
    x = width / distance
    return 1 - math.erfc(x / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def plan_tables(n: int, least: float, miss: float = MISS, apart: float = 0.0, width: float = WIDTH) -> tuple[int, int]:
    """(directions a table, tables) for n vectors: about one unrelated vector a bucket, and a pair at ``least`` missed with chance ``miss``.

    ``apart`` is the cosine that unrelated vectors usually have.
    """
    near, far = collision(math.sqrt(2 - 2 * least), width), collision(math.sqrt(2 - 2 * apart), width)
    k = max(1, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(miss) / math.log1p(-(near**k))))


def unit(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow list column as (rows of unit length, padded by zeros to the longest; lengths)."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = col.cast(pa.large_list(col.type.value_type))
    flat, off = np.asarray(col.flatten()).astype(np.float64), np.asarray(col.offsets)
    n = np.diff(off)
    x = np.zeros((len(n), int(n.max()) if len(n) else 0))
    row = np.repeat(np.arange(len(n)), n)
    x[row, np.arange(len(flat)) - np.repeat(off[:-1] - off[0], n)] = flat
    x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(float).tiny) if x.size else 1
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x, n


def signatures(x: np.ndarray, dim: int, salt: np.ndarray, k: int, tables: int, width: float, seed: int) -> np.ndarray:
    """A 64-bit name of each row's bucket in each table; salt tells rows apart that must not meet."""
    out = np.empty((len(x), tables), np.uint64)
    together = max(1, (1 << 20) // max(1, k * dim))
    for a in range(0, tables, together):
        some = np.arange(a, min(a + together, tables))
        rng = [np.random.default_rng([seed, dim, int(t)]) for t in some]
        axes = np.concatenate([r.standard_normal((dim, k)) for r in rng], axis=1)
        shift = np.concatenate([r.uniform(0, width, k) for r in rng])
        times = np.concatenate([r.integers(1, 1 << 62, k) for r in rng]).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        step = np.floor((x[:, :dim] @ axes + shift) / width).astype(np.int64).astype(np.uint64) * times
        names = step.reshape(len(x), len(some), k).sum(axis=2, dtype=np.uint64)
        out[:, some] = S.mix(names + S.mix(salt[:, None] + some.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return out


def _sign(k: int, tables: int, width: float, seed: int):
    def sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for a in range(0, whole.num_rows, 2048):
                rb = whole.slice(a, 2048)
                x, n = unit(rb.column("v"))
                salt = S.mix(np.asarray(rb.column("salt")).astype(np.uint64) + n.astype(np.uint64))
                sig = np.empty((len(x), tables), np.uint64)
                for dim in np.unique(n):
                    at = n == dim
                    sig[at] = signatures(x[at], int(dim), salt[at], k, tables, width, seed)
                off = pa.array((np.arange(len(x) + 1) * tables).astype(np.int32))
                yield pa.RecordBatch.from_arrays([rb.column("node"), pa.ListArray.from_arrays(off, pa.array(sig.ravel().view(np.int64)))], names=["node", "sig"])

    return sign


def _links(x: np.ndarray, code: np.ndarray, block: np.ndarray, crossing: np.ndarray, h: np.ndarray, sig: np.ndarray, cells: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows that meet here for the first time; cells are the first rows of each cell and the end."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    sizes = np.diff(cells)
    for s in np.unique(sizes[sizes > 1]):
        starts = cells[:-1][sizes == s]
        i, j = np.triu_indices(s, 1)
        for a in range(0, len(starts), max(1, HELD // int(s * s))):
            at = starts[a : a + max(1, HELD // int(s * s)), None] + np.arange(s)
            near = (x[at] @ x[at].transpose(0, 2, 1))[:, i, j] >= least
            c, q = np.nonzero(near)
            u, w = at[c, i[q]], at[c, j[q]]
            ok = (code[u] == code[w]) & (~crossing[u] | (block[u] != block[w]))
            u, w = u[ok], w[ok]
            for b in range(0, len(u), 16384):
                u2, w2 = u[b : b + 16384], w[b : b + 16384]
                first = (sig[u2] == sig[w2]).argmax(axis=1)
                mine = sig[u2, first] == h[u2]
                found.append((u2[mine], w2[mine]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def roots(n: int, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows is joined with."""
    lab = np.arange(n)
    while len(u):
        new = lab.copy()
        low = np.minimum(lab[u], lab[w])
        np.minimum.at(new, u, low)
        np.minimum.at(new, w, low)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    return lab


def _compare(least: float, tables: int):
    def settle(t: pa.Table, cells: np.ndarray) -> pa.RecordBatch | None:
        t = t.combine_chunks()
        col = lambda c: np.asarray(t.column(c).combine_chunks())
        x, n = unit(t.column("v"))
        label = np.asarray(t.column("label").combine_chunks().dictionary_encode().indices).astype(np.int64)
        sig = np.asarray(t.column("sig").combine_chunks().flatten()).view(np.uint64).reshape(-1, tables)
        u, w = _links(x, label * (int(n.max()) + 1) + n, col("block"), col("lo") != col("hi"), col("h").view(np.uint64), sig, cells, least)
        if not len(u):
            return None
        node, m = col("node"), col("copies")
        count = np.bincount(u, m[w], len(node)).astype(np.int64) + np.bincount(w, m[u], len(node)).astype(np.int64)
        at = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(count[at]), pa.array(node[roots(len(node), u, w)[at]])], names=["node", "n", "root"])

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush(last: bool):
            t = pa.Table.from_batches(held)
            h, lo, hi = (np.asarray(t.column(c).combine_chunks()) for c in ("h", "lo", "hi"))
            cells = np.append(np.concatenate(([0], np.flatnonzero((h[1:] != h[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1)), len(h))
            # the last cell may go on in the next batch
            cells = cells if last else cells[:-1]
            out = settle(t.slice(0, int(cells[-1])), cells) if len(cells) > 1 else None
            return out, t.slice(int(cells[-1])).to_batches()

        try:
            for whole in it:
                for a in range(0, whole.num_rows, TAKEN):
                    held.append(whole.slice(a, TAKEN))
                    rows += held[-1].num_rows
                    if rows >= TAKEN:
                        out, held = flush(False)
                        rows = sum(b.num_rows for b in held)
                        if out is not None:
                            yield out
            if held:
                out, held = flush(True)
                if out is not None:
                    yield out
        finally:
            S.release(trim=True)

    return compare


def similar(vectors: DataFrame, least: float = 0.93, key: str = "vec_id", vector: str = "embedding", group: str = "label", miss: float = MISS, apart: float = 0.0, seed: int = 17) -> DataFrame:
    """(key, n_links, component_id, kept), a row for each row of vectors: links to others of one group with a cosine of ``least`` or more.

    n_links counts rows, copies among them; component_id is the smallest key reachable by links, its own included; kept
    says whether it is the row's own. A vector that is null, zero or holds null or non-finite components, and a null
    group, link with nothing. Vectors of different length do not link. Rows of equal keys are rows of their own; a row
    of a null key counts and links but names no component; other columns are ignored; an empty table gives none.
    """
    root = S.shared_root(vectors.sparkSession)
    rows = vectors.select(F.col(key).alias("id"), F.col(group).alias("label"), F.col(vector).alias("v"))
    part = usable(F.col("v")) & F.col("label").isNotNull()
    nodes = rows.filter(part).groupBy("label", "v").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least_id"))
    nodes = S.materialised(nodes.select(F.monotonically_increasing_id().alias("node"), "label", "v", "copies", "least_id"), f"{root}/nodes")
    k, tables = plan_tables(nodes.count(), least, miss, apart)
    signed = nodes.select("node", "v", F.xxhash64("label").alias("salt")).mapInArrow(_sign(k, tables, WIDTH, seed), "node long, sig array<long>")
    signed = S.materialised(signed, f"{root}/signed")
    named = signed.select("node", F.explode("sig").alias("h"))
    shared = named.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = named.join(shared, "h").select("h", "node", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    met = met.withColumn("block", F.pmod(F.xxhash64("node", F.lit(seed)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("h", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node")
    full = met.join(signed, "node").join(nodes.select("node", F.col("label").cast("string").alias("label"), "v", "copies"), "node")
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4)
    dealt = full.repartition(parts, "h", "lo", "hi").sortWithinPartitions("h", "lo", "hi")
    linked = S.materialised(dealt.mapInArrow(_compare(least, tables), "node long, n long, root long"), f"{root}/linked")
    S.remove(f"{root}/signed")
    degree = linked.groupBy("node").agg(F.sum("n").alias("n"))
    joined = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")), root)
    state = nodes.select("node", "copies", "least_id").join(joined, "node", "left").join(degree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named_by = state.groupBy("root").agg(F.min("least_id").alias("component_id"))
    state = state.join(named_by, "root").select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    state = nodes.select("node", "label", "v").join(state, "node").drop("node")
    taking = rows.filter(part).join(state, ["label", "v"]).select("id", "n_links", "component_id")
    alone = rows.filter(~part).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = taking.unionByName(alone)
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
