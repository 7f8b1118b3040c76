"""Approximate nearest neighbours by NN-descent.

A graph of each vector's nearest neighbours found so far is begun from rows that lie side by side along random
directions, and refined by iterative joins: each vector's neighbours, forward and reverse, meet, and pairs of them
become neighbours where they are nearer than what they have. Queries walk the graph greedily, both ways along its
edges: the nearest candidates found so far are expanded by their neighbours until none is left to expand; a query holds
the more candidates the more nodes there are. Equal vectors are one node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import _shared as S

#: Neighbours of a node in the graph; reverse neighbours that take part in a round, by a seeded choice.
DEGREE, REVERSE = 20, 40
#: Random directions of the first graph, and how far along each a row looks.
DIRECTIONS, REACH = 3, 12
#: Rounds of descent at most; they end when fewer than this share of edges is new.
ROUNDS, STILL = 12, 0.01
#: Candidates that a query holds at least.
BEAM = 80
#: Nodes of a partition at most, on average.
NODES_PER_PART = 20_000


def matrix(col: pa.Array) -> np.ndarray:
    """An Arrow list column as rows of doubles."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = np.asarray(col.flatten()).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def usable(c: Column) -> Column:
    """Whether a vector takes part: not null or zero, all components finite numbers."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(c, lambda x: x != 0)


def _along(direction: int, seed: int, dim: int):
    rng = np.random.default_rng([seed, direction])
    axis = rng.standard_normal(dim)

    def project(it):
        for rb in it:
            x = matrix(rb.column("v"))
            yield pa.RecordBatch.from_arrays([rb.column("id"), rb.column("v"), pa.array(x @ axis)], names=["id", "v", "at"])

    return project


def _side_by_side(reach: int, degree: int):
    def pairs(it):
        held = [rb for rb in it if rb.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        ids, x = np.asarray(t.column("id").combine_chunks()), matrix(t.column("v"))
        for a in range(0, len(ids), 4096):
            lo, hi = max(0, a - reach), min(len(ids), a + 4096 + reach)
            near, to = [], []
            rows = np.arange(a, min(a + 4096, len(ids)))
            for step in range(-reach, reach + 1):
                if step:
                    other = rows + step
                    ok = (other >= lo) & (other < hi) & (other >= 0) & (other < len(ids))
                    o = np.where(ok, other, rows)
                    near.append(np.where(ok, np.sqrt(((x[rows] - x[o]) ** 2).sum(1)), np.inf))
                    to.append(ids[o])
            near, to = np.array(near).T, np.array(to).T
            pick = np.argsort(near, axis=1)[:, :degree]
            d = np.take_along_axis(near, pick, 1)
            w = np.take_along_axis(to, pick, 1)
            u = np.repeat(ids[rows], pick.shape[1])
            ok = np.isfinite(d).ravel()
            yield pa.RecordBatch.from_pydict({"u": pa.array(u[ok]), "w": pa.array(w.ravel()[ok]), "d": pa.array(d.ravel()[ok])})

    return pairs


def _rows_of(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column as (flat values, offsets)."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = col.cast(pa.large_list(col.type.value_type))
    flat, off = np.asarray(col.flatten()), np.asarray(col.offsets)
    return flat, off - off[0] if len(off) else np.zeros(1, np.int64)


def _members(seed: int):
    def members(left: pa.Table, right: pa.Table) -> pa.Table:
        """Nodes with those they list and a choice of those that list them (of, by, old), and the partitions all those are in."""
        ids, parts = np.asarray(left.column("id").combine_chunks()), left.column("parts")[0].as_py() if left.num_rows else 1
        w, off = _rows_of(left.column("w"))
        old, _ = _rows_of(left.column("old"))
        of, by, old2 = (np.asarray(right.column(c).combine_chunks()) for c in ("of", "by", "old"))
        order = np.argsort(ids)
        at2 = order[np.searchsorted(ids[order], of)] if len(of) else of.astype(np.int64)
        at = np.repeat(np.arange(len(ids)), np.diff(off))
        # every node that lists this one meets it, so its partition needs this vector, chosen or not
        own = np.arange(len(ids))
        to = np.unique(np.concatenate((own, at, at2)) * parts + _place(np.concatenate((ids, w, by)).astype(np.int64), parts))
        # new ones first, then by a seeded choice
        keep = np.lexsort((S.mix(by.astype(np.uint64) ^ S.mix(of.astype(np.uint64) + np.uint64(seed))), old2, at2))
        first = S.runs(at2[keep])
        rank = np.arange(len(keep)) - np.repeat(first, np.diff(np.append(first, len(keep))))
        keep = keep[rank < REVERSE]
        at, w, old = np.concatenate((at, at2[keep])), np.concatenate((w, by[keep])).astype(np.int64), np.concatenate((old, old2[keep])).astype(bool)
        keep = np.lexsort((old, w, at))
        new = np.ones(len(keep), bool)
        new[1:] = (at[keep][1:] != at[keep][:-1]) | (w[keep][1:] != w[keep][:-1])
        keep = keep[new]
        lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(k, minlength=len(ids))))).astype(np.int32)), pa.array(x)) for k, x in ((at[keep], w[keep]), (at[keep], old[keep]), (to // parts, (to % parts).astype(np.int32)))]
        return pa.table([left.column("id"), left.column("v"), left.column("far"), left.column("p"), *lists], names=["id", "v", "far", "p", "w", "old", "to"])

    return members


def _messages(it):
    """Each node's vector to each partition where it takes part, once, and to its own with its members: (p, id, v, far, w, old)."""
    for rb in it:
        if not rb.num_rows:
            continue
        to, off = _rows_of(rb.column("to"))
        of = np.repeat(np.arange(rb.num_rows), np.diff(off))
        row = pa.array(of)
        away = pa.array(to != np.asarray(rb.column("p"))[of])
        lists = (pa.compute.if_else(away, pa.scalar(None, rb.column(c).type), rb.column(c).take(row)) for c in ("w", "old"))
        yield pa.RecordBatch.from_arrays([pa.array(to), *(rb.column(c).take(row) for c in ("id", "v", "far")), *lists], names=["p", "id", "v", "far", "w", "old"])


def _meeting(degree: int):
    def meet(t: pa.Table) -> pa.Table:
        """Of all pairs of a node and its members, not two old ones, the nearest of each that are nearer than its farthest."""
        t = t.sort_by("id")
        ids, far, v = np.asarray(t.column("id").combine_chunks()), np.array(t.column("far").combine_chunks()), matrix(t.column("v"))
        here = t.filter(pa.compute.is_valid(t.column("w")))
        w, off = _rows_of(here.column("w"))
        old, _ = _rows_of(here.column("old"))
        size = np.diff(off)
        # a node is its own first member; what it lists anew meets it, what it lists since earlier has met it
        wide = 1 + int(size.max(initial=0))
        who, used, stale = np.zeros((len(size), wide), np.int64), np.zeros((len(size), wide), bool), np.ones((len(size), wide), bool)
        who[:, 0], used[:, 0] = np.searchsorted(ids, np.asarray(here.column("id").combine_chunks())), True
        at = np.repeat(np.arange(len(size)), size)
        nth = 1 + np.arange(len(w)) - np.repeat(off[:-1], size)
        who[at, nth], used[at, nth], stale[at, nth] = np.searchsorted(ids, w), True, old.astype(bool)
        sq = (v * v).sum(1)
        held, more, waiting = np.zeros((2, 0), np.int64), [], 0
        dist = np.zeros(0)
        order = np.argsort(size, kind="stable")
        k = 0
        while k < len(order) or more:
            if k < len(order):
                step = max(1, min(256, (1 << 20) // int(1 + size[order[min(len(order) - 1, k + 256)]]) ** 2))
                rows = order[k : k + step]
                k += step
                m = 1 + int(size[rows].max())
                a, x = who[rows, :m], v[who[rows, :m]]
                near = sq[a][:, :, None] + sq[a][:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
                slack = 1e-9 * sq[a][:, :, None] + far[a][:, :, None] ** 2
                ok = (near <= slack) & used[rows, :m, None] & used[rows, None, :m] & ~(stale[rows, :m, None] & stale[rows, None, :m])
                g, i, j = np.nonzero(ok)
                more.append(a[g, i] * len(ids) + a[g, j])
                waiting += len(g)
            if waiting > 1 << 20 or k >= len(order):
                pair = np.unique(np.concatenate(more))
                i, j = pair // len(ids), pair % len(ids)
                d = np.concatenate([np.sqrt(((v[i[z : z + 65536]] - v[j[z : z + 65536]]) ** 2).sum(1)) for z in range(0, max(1, len(i)), 65536)])
                use = (i != j) & (d < far[i])
                held, dist = np.concatenate((held, np.stack((i[use], j[use]))), axis=1), np.concatenate((dist, d[use]))
                first = np.unique(held[0] * len(ids) + held[1], return_index=True)[1]
                held, dist = held[:, first], dist[first]
                by = np.lexsort((held[1], dist, held[0]))
                start = S.runs(held[0][by])
                rank = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
                last = by[rank == degree - 1]
                far[held[0][last]] = np.minimum(far[held[0][last]], dist[last])  # nothing farther can stay
                by = by[rank < degree]
                held, dist, more, waiting = held[:, by], dist[by], [], 0
        return pa.table({"u": pa.array(ids[held[0]], pa.int64()), "w": pa.array(ids[held[1]], pa.int64()), "d": pa.array(dist)})

    return meet


def graph_schema(kind: str) -> str:
    return f"id long, v {kind}, far double, w array<long>, d array<double>, old array<boolean>, fresh int"


GRAPH = graph_schema("array<float>")


def kind_of(rows: DataFrame, column: str = "v") -> str:
    """The SQL type of a vector column: floats stay floats, anything wider is double."""
    return rows.schema[column].dataType.simpleString()


def _merging(degree: int):
    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        """Nodes with their nearest distinct neighbours of those they had, which are old now, and new ones."""
        ids = np.asarray(left.column("id").combine_chunks())
        w, off = _rows_of(left.column("w"))
        d, _ = _rows_of(left.column("d"))
        row = {k: n for n, k in enumerate(ids.tolist())}
        u2 = np.asarray(right.column("u").combine_chunks())
        at2 = np.fromiter((row.get(k, -1) for k in u2.tolist()), np.int64, len(u2))
        at = np.concatenate((np.repeat(np.arange(len(ids)), np.diff(off)), at2))
        w = np.concatenate((w, np.asarray(right.column("w").combine_chunks()))).astype(np.int64)
        d = np.concatenate((d, np.asarray(right.column("d").combine_chunks()))).astype(np.float64)
        new = np.arange(len(at)) >= len(at) - len(u2)
        keep = np.flatnonzero(at >= 0)
        keep = keep[np.lexsort((new[keep], w[keep], at[keep]))]  # an edge that is there already stays old
        same = np.zeros(len(keep), bool)
        same[1:] = (at[keep][1:] == at[keep][:-1]) & (w[keep][1:] == w[keep][:-1])
        keep = keep[~same]
        keep = keep[np.lexsort((w[keep], d[keep], at[keep]))]
        first = S.runs(at[keep])
        rank = np.arange(len(keep)) - np.repeat(first, np.diff(np.append(first, len(keep))))
        keep = keep[rank < degree]
        n = np.bincount(at[keep], minlength=len(ids))
        ends = np.cumsum(n)
        far = np.full(len(ids), np.inf)
        full = n >= degree
        far[full] = d[keep][ends[full] - 1]
        offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (w[keep], d[keep], ~new[keep])]
        fresh = np.bincount(at[keep], new[keep], len(ids)).astype(np.int32)
        return pa.table([left.column("id"), left.column("v"), pa.array(far), *lists, pa.array(fresh)], names=["id", "v", "far", "w", "d", "old", "fresh"])

    return merge


def _dealt(df: DataFrame, column: str, parts: int) -> DataFrame:
    return df.withColumn("p", F.pmod(F.xxhash64(column), F.lit(parts)).cast("int"))


def _merged(graph: DataFrame, found: DataFrame, degree: int, parts: int, path: str) -> DataFrame:
    both = _dealt(graph, "id", parts).groupBy("p").cogroup(_dealt(found.select(F.col("u").alias("u"), F.col("w").alias("w"), F.col("d").alias("d")), "u", parts).groupBy("p"))
    return S.materialised(both.applyInArrow(_merging(degree), graph_schema(kind_of(graph))), path)


def descend(graph: DataFrame, degree: int, seed: int, parts: int, path: str) -> DataFrame:
    """A round: at each node, it, all that it lists and REVERSE of those that list it meet."""
    listed = _placed(graph.select(F.explode(F.arrays_zip("w", "old")).alias("c"), F.col("id").alias("by")).select(F.col("c.w").alias("of"), "by", F.col("c.old").alias("old")), "of", parts)
    nodes = _placed(graph.select("id", "v", "far", "w", "old", F.lit(parts).alias("parts")), "id", parts)
    kind = kind_of(graph)
    both = nodes.groupBy("p").cogroup(listed.groupBy("p")).applyInArrow(_members(seed), f"id long, v {kind}, far double, p int, w array<long>, old array<boolean>, to array<int>")
    met = both.mapInArrow(_messages, f"p int, id long, v {kind}, far double, w array<long>, old array<boolean>")
    return _merged(graph, met.groupBy("p").applyInArrow(_meeting(degree), "u long, w long, d double"), degree, parts, path)


def build_graph(nodes: DataFrame, root: str, dim: int, degree: int = DEGREE, seed: int = 7) -> DataFrame:
    """nodes (id, v) to rows (id, v, far, w, d, old, fresh): each node's nearest neighbours w found, at distances d."""
    spark = nodes.sparkSession
    parts = parts_for(spark, nodes)
    lines = min(parts, 1 + nodes.count() // 512)  # a short line is not cut: rows at a cut see one side only
    first = None
    for k in range(DIRECTIONS):
        lined = nodes.mapInArrow(_along(k, seed, dim), f"id long, v {kind_of(nodes)}, at double").repartitionByRange(lines, "at").sortWithinPartitions("at", "id")
        found = lined.select("id", "v").mapInArrow(_side_by_side(REACH, degree), "u long, w long, d double")
        first = found if first is None else first.unionByName(found)
    none = nodes.select("id", "v", F.lit(float("inf")).alias("far"), F.array().cast("array<long>").alias("w"), F.array().cast("array<double>").alias("d"), F.array().cast("array<boolean>").alias("old"), F.lit(0).alias("fresh"))
    graph = _merged(none, first, degree, parts, f"{root}/graph0")
    for k in range(1, ROUNDS + 1):
        graph = descend(graph, degree, seed + k, parts, f"{root}/graph{k}")
        S.remove(f"{root}/graph{k - 1}")
        new, total = graph.agg(F.sum("fresh"), F.sum(F.size("w"))).first()
        if (new or 0) <= STILL * max(1, total or 0):
            break
    return graph


def parts_for(spark, nodes: DataFrame) -> int:
    """Partitions that the nodes are dealt to: enough for the session's tasks, and for some tens of thousands of nodes each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // NODES_PER_PART))


def _place(ids: np.ndarray, parts: int) -> np.ndarray:
    """The partition that a node's row is dealt to."""
    return (S.mix(ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)


def _placed(df: DataFrame, column: str, parts: int) -> DataFrame:
    """df with p, the partition of the node named by a column."""

    def place(it):
        for rb in it:
            yield rb.append_column("p", pa.array(_place(np.asarray(rb.column(column)), parts)))

    return df.mapInArrow(place, df.withColumn("p", F.lit(0)).schema)


def _both_ways(left: pa.Table, right: pa.Table) -> pa.Table:
    """Nodes (id, v, w) with those that list them (of, by, d), the nearest REVERSE, after those they list."""
    ids = np.asarray(left.column("id").combine_chunks())
    w, off = _rows_of(left.column("w"))
    order = np.argsort(ids)
    of, by, d = (np.asarray(right.column(c).combine_chunks()) for c in ("of", "by", "d"))
    at = order[np.searchsorted(ids[order], of)] if len(of) else of
    keep = np.lexsort((by, d, at))
    first = S.runs(at[keep])
    rank = np.arange(len(keep)) - np.repeat(first, np.diff(np.append(first, len(keep))))
    keep = keep[rank < REVERSE]
    at, w = np.concatenate((np.repeat(np.arange(len(ids)), np.diff(off)), at[keep])), np.concatenate((w, by[keep])).astype(np.int64)
    keep = np.lexsort((w, at))
    new = np.ones(len(keep), bool)
    new[1:] = (at[keep][1:] != at[keep][:-1]) | (w[keep][1:] != w[keep][:-1])
    keep = keep[new]
    offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(at[keep], minlength=len(ids))))).astype(np.int32))
    return pa.table([left.column("id"), left.column("v"), pa.ListArray.from_arrays(offsets, pa.array(w[keep])), left.column("p")], names=["id", "v", "w", "p"])


def _asking(parts: int):
    def ask(it):
        """Each query to the partitions of the nodes it asks for, once to each: (p, q, qv, far, ask)."""
        for rb in it:
            nodes, off = _rows_of(rb.column("ask"))
            if not len(nodes):
                continue
            of, p = np.repeat(np.arange(rb.num_rows), np.diff(off)), _place(nodes, parts)
            order = np.lexsort((p, of))
            of, p, nodes = of[order], p[order], nodes[order]
            first = S.runs(of * parts + p)
            row = pa.array(of[first])
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(of)).astype(np.int32)), pa.array(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(p[first]), *(rb.column(c).take(row) for c in ("q", "qv", "far")), lists], names=["p", "q", "qv", "far", "ask"])

    return ask


def _answer(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of the nodes asked for, those nearer than the query's farthest candidate, with their neighbours: (q, id, d, n, w), lists."""
    ids, v = np.asarray(left.column("id").combine_chunks()), matrix(left.column("v"))
    q, qv, far = np.asarray(right.column("q").combine_chunks()), matrix(right.column("qv")), np.asarray(right.column("far").combine_chunks())
    nodes, off = _rows_of(right.column("ask"))
    of, order = np.repeat(np.arange(len(q)), np.diff(off)), np.argsort(ids)
    at = order[np.searchsorted(ids[order], nodes)] if len(nodes) else nodes.astype(np.int64)
    d = np.zeros(len(at))
    for a in range(0, len(at), 1 << 16):
        z = slice(a, a + (1 << 16))
        d[z] = np.sqrt(((qv[of[z]] - v[at[z]]) ** 2).sum(1))
    ok = np.flatnonzero(d < far[of])
    w, woff = _rows_of(left.column("w"))
    size = np.diff(woff)[at[ok]]
    near = w[np.arange(int(size.sum())) + np.repeat(woff[:-1][at[ok]] - np.cumsum(size) + size, size)].astype(np.int64)
    # one row a query: its nodes and distances, and their neighbours one after the other
    asked = np.unique(of[ok])
    cut = np.concatenate((np.searchsorted(of[ok], asked), [len(ok)])).astype(np.int32)
    ends = np.concatenate(([0], np.cumsum(size)))[cut].astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(o), pa.array(x)) for o, x in ((cut, ids[at[ok]].astype(np.int64)), (cut, d[ok]), (cut, size.astype(np.int32)), (ends, near))]
    return pa.table([pa.array(q[asked], pa.int64()), *lists], names=["q", "id", "d", "n", "w"])


def _walking(beam: int):
    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        """Queries (q, qv, far, ids, d, ask) and the answers (q, id, d, n, w): the beam's nearest, and the neighbours of the new ones to ask for."""
        qs = np.asarray(left.column("q").combine_chunks())
        row = {k: n for n, k in enumerate(qs.tolist())}
        ids, off = _rows_of(left.column("ids"))
        d, _ = _rows_of(left.column("d"))
        told = np.fromiter((row[k] for k in np.asarray(right.column("q").combine_chunks()).tolist()), np.int64, right.num_rows)
        ids2, off2 = _rows_of(right.column("id"))
        at2 = np.repeat(told, np.diff(off2))
        at = np.concatenate((np.repeat(np.arange(len(qs)), np.diff(off)), at2))
        had = len(at) - len(at2)
        ids = np.concatenate((ids, ids2)).astype(np.int64)
        d = np.concatenate((d, _rows_of(right.column("d"))[0])).astype(np.float64)
        keep = np.lexsort((ids, d, at))
        first = S.runs(at[keep])
        rank = np.arange(len(keep)) - np.repeat(first, np.diff(np.append(first, len(keep))))
        keep = keep[rank < beam]
        n = np.bincount(at[keep], minlength=len(qs))
        ends, far = np.cumsum(n), np.full(len(qs), np.inf)
        far[n >= beam] = d[keep][ends[n >= beam] - 1]
        # neighbours of what is new in the beam, each once, that are not in it
        new = keep[keep >= had] - had
        w, each = _rows_of(right.column("w"))[0], _rows_of(right.column("n"))[0].astype(np.int64)
        woff = np.cumsum(each) - each
        size = each[new] if len(new) else np.zeros(0, np.int64)
        start = np.repeat(woff[new] if len(new) else size, size)
        ask = w[start + np.arange(len(start)) - np.repeat(np.cumsum(size) - size, size)].astype(np.int64) if len(start) else np.zeros(0, np.int64)
        of = np.concatenate((at[keep], np.repeat(at[new + had], size)))
        ask = np.concatenate((ids[keep], ask))
        order = np.lexsort((np.arange(len(ask)), ask, of))  # what is in the beam comes first of its equals
        once = np.ones(len(order), bool)
        once[1:] = (of[order][1:] != of[order][:-1]) | (ask[order][1:] != ask[order][:-1])
        order = order[once & (order >= len(keep))]
        lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(k, minlength=len(qs))))).astype(np.int32)), pa.array(x)) for k, x in ((at[keep], ids[keep]), (at[keep], d[keep]), (of[order], ask[order]))]
        return pa.table([left.column("q"), left.column("qv"), pa.array(far), *lists], names=["q", "qv", "far", "ids", "d", "ask"])

    return walk


def search(graph: DataFrame, queries: DataFrame, root: str, beam: int) -> DataFrame:
    """queries (q, qv, start) to (q, id, d): the beam's nodes nearest to qv by a greedy walk from start, until none is open."""
    parts, kind = parts_for(graph.sparkSession, graph), kind_of(queries, "qv")
    listed = _placed(graph.select(F.explode(F.arrays_zip("w", "d")).alias("c"), F.col("id").alias("by")).select(F.col("c.w").alias("of"), "by", F.col("c.d").alias("d")), "of", parts)
    nodes = _placed(graph.select("id", "v", "w"), "id", parts).groupBy("p").cogroup(listed.groupBy("p")).applyInArrow(_both_ways, f"id long, v {kind_of(graph)}, w array<long>, p int")
    nodes = S.materialised(nodes, f"{root}/both")
    held = queries.select("q", "qv", F.lit(float("inf")).alias("far"), F.array().cast("array<long>").alias("ids"), F.array().cast("array<double>").alias("d"), F.array("start").alias("ask"))
    k = 0
    while not held.filter(F.size("ask") > 0).isEmpty():
        asked = held.mapInArrow(_asking(parts), f"p int, q long, qv {kind}, far double, ask array<long>")
        told = nodes.groupBy("p").cogroup(asked.groupBy("p")).applyInArrow(_answer, "q long, id array<long>, d array<double>, n array<int>, w array<long>")
        both = _placed(held, "q", parts).groupBy("p").cogroup(_placed(told, "q", parts).groupBy("p"))
        held = S.materialised(both.applyInArrow(_walking(beam), f"q long, qv {kind}, far double, ids array<long>, d array<double>, ask array<long>"), f"{root}/beam{k}")
        if k:
            S.remove(f"{root}/beam{k - 1}")
        k += 1
    return held.select("q", F.explode(F.arrays_zip("ids", "d")).alias("c")).select("q", F.col("c.ids").alias("id"), F.col("c.d").alias("d"))


def beam_for(nodes: int) -> int:
    """Candidates that a query holds: neighbours grow harder to find as nodes grow more."""
    return max(BEAM, int(2 * nodes**0.5))


def nearest(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = 10, every: int = 100, seed: int = 7) -> DataFrame:
    """The top nearest rows, by Euclidean distance in doubles, of each row whose key is divisible by ``every``.

    Returns (query_id, rank, vec_id, score), nearest first, ties to the smaller key; every other row is a candidate.
    Vectors that are null or zero or hold null or non-finite components take no part, nor do null keys or vectors of a
    length other than the most common one; repeated keys are rows of their own; other columns are ignored; an empty
    table gives none.
    """
    spark, root = rows.sparkSession, S.shared_root(rows.sparkSession)
    kind = kind_of(rows, vector) if kind_of(rows, vector) in ("array<float>", "array<double>") else "array<double>"
    good = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v")).filter(usable(F.col("v")) & F.col("id").isNotNull())
    lengths = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], out)
    dim = lengths[0].n
    # equal vectors are one node, named by the smallest key; x + 0 makes -0 and 0 alike
    good = good.filter(F.size("v") == dim).withColumn("v", F.transform("v", lambda x: x + F.lit(0).cast(kind[6:-1]))).withColumn("h", F.concat(F.hex(F.xxhash64("v")), F.hash("v").cast("string")))
    good = S.materialised(good, f"{root}/rows")
    nodes = S.materialised(good.groupBy("h").agg(F.min(F.struct("id", "v")).alias("f"), F.count(F.lit(1)).alias("n")).select("h", F.col("f.id").alias("id"), F.col("f.v").alias("v"), "n"), f"{root}/nodes")
    graph = build_graph(nodes.select("id", "v"), root, dim, seed=seed)
    queries = good.filter(F.col("id") % every == 0).select(F.col("id").alias("row"), "h").distinct().join(nodes.select("h", F.col("id").alias("q")), "h").select("row", "q")
    walks = queries.select("q").distinct().join(nodes.select(F.col("id").alias("q"), F.col("v").alias("qv")), "q").withColumn("start", F.col("q"))
    found = S.materialised(search(graph, S.materialised(walks, f"{root}/walks"), root, beam_for(nodes.count())), f"{root}/found")
    # the nodes' smallest keys, salted so that a vector of a third of all rows is no one task's
    members = good.select("h", F.col("id").alias("vec_id"), F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt"))
    for by in (["h", "salt"], ["h"]):
        members = members.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).filter(F.col("r") <= top + 1).drop("r")
    members = members.join(nodes.select("h", "id"), "h").select("id", "vec_id", F.row_number().over(Window.partitionBy("h").orderBy("vec_id")).alias("nth"))
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))).filter(F.col("r") <= top + 1).drop("r")
    pairs = queries.join(best, "q").join(members, "id")
    # a row is not its own candidate; a repeated key loses one row to the query
    own = (F.col("vec_id") == F.col("row")) & (F.col("id") == F.col("q"))
    pairs = pairs.withColumn("self", own).withColumn("copy", F.row_number().over(Window.partitionBy("row", "self").orderBy("nth"))).filter(~(F.col("self") & (F.col("copy") == 1)))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy("d", "vec_id")).cast("int")).filter(F.col("rank") <= top)
    return ranked.select(F.col("row").alias("query_id"), "rank", "vec_id", F.col("d").alias("score"))
