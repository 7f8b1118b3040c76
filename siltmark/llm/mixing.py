"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). A flow routes words from patterns,
which offer their words once at cost 0, again at cost 1, a third time at cost 2 and so on, to the sources' quotas.
What a pattern gives in all becomes whole repeats of all its documents and a rest, which documents fill in a seeded
order: whole hash buckets below the rest's border, and in the border bucket each next document that still fits, and then one change that brings the bucket nearest to the rest.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import _shared as S

#: Distinct membership patterns that the driver will plan for; more is an error, never a cut.
MAX_PATTERNS = 100_000
#: Documents a bucket of the seeded order has at least, where there are enough.
BUCKET_ROWS = 4096
INF = 1 << 62


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null: 0."""
    one = F.translate(F.coalesce(text.cast("string"), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(one, " "), "")).cast("long")


def fill_targets(sizes: list[int], weights: list[float], total: float, most: int) -> list[float]:
    """Shares of total by weight; what is above most times a size is reshared by weight until nothing is."""
    out, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        whole = sum(weights[k] for k in open_)
        full = [k for k in open_ if rest * weights[k] / whole > most * sizes[k]]
        if not full:
            for k in open_:
                out[k] = rest * weights[k] / whole
            break
        for k in full:
            out[k] = float(most * sizes[k])
        open_ -= set(full)
        rest = max(0.0, rest - sum(out[k] for k in full))
    return out


def whole_numbers(targets: list[float]) -> list[int]:
    """Targets rounded to whole numbers that keep their sum."""
    low = [int(x) for x in targets]
    order = sorted(range(len(targets)), key=lambda k: (low[k] - targets[k], k))
    for k in order[: round(sum(targets)) - sum(low)]:
        low[k] += 1
    return low


def min_cost_flow(capacity: list[int], member: list[list[int]], quota: list[int], most: int) -> dict[tuple[int, int], int]:
    """Words from pattern p to source s at least cost: {(p, s): words}. Epoch e of a pattern costs e a word, most epochs in all.

    Patterns and sources that no overlap joins are solved in closed form; each joined part by shortest augmenting paths.
    """
    of_source: dict[int, list[int]] = {}
    for p, ss in enumerate(member):
        for s in ss:
            of_source.setdefault(s, []).append(p)
    flow: dict[tuple[int, int], int] = {}
    seen: set[int] = set()
    for s0 in sorted(of_source):
        if s0 in seen:
            continue
        part, todo = [], [s0]
        seen.add(s0)
        while todo:
            s = todo.pop()
            part.append(s)
            for p in of_source[s]:
                for x in member[p]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
        patterns = sorted({p for s in part for p in of_source[s]})
        if len(part) == 1 and len(patterns) == 1:
            flow[patterns[0], s0] = min(quota[s0], most * capacity[patterns[0]])
        else:
            flow |= _augment(patterns, sorted(part), capacity, member, quota, most)
    return flow


def _augment(patterns, sources, capacity, member, quota, most):
    n_p, n_s = len(patterns), len(sources)
    node = {s: 1 + n_p + k for k, s in enumerate(sources)}
    sink = 1 + n_p + n_s
    to, cap, cost, out = [], [], [], [[] for _ in range(sink + 1)]

    def arc(a, b, c, w):
        for u, v, x, y in ((a, b, c, w), (b, a, 0, -w)):
            out[u].append(len(to))
            to.append(v)
            cap.append(x)
            cost.append(y)

    for k, p in enumerate(patterns):
        for e in range(most):
            arc(0, 1 + k, capacity[p], e)
    middle = len(to)
    for k, p in enumerate(patterns):
        for s in member[p]:
            arc(1 + k, node[s], INF, 0)
    after = len(to)
    for s in sources:
        arc(node[s], sink, quota[s], 0)
    while True:
        far, via, held = [INF] * (sink + 1), [-1] * (sink + 1), [False] * (sink + 1)
        far[0], todo = 0, deque([0])
        while todo:
            u = todo.popleft()
            held[u] = False
            for a in out[u]:
                if cap[a] and far[u] + cost[a] < far[to[a]]:
                    far[to[a]], via[to[a]] = far[u] + cost[a], a
                    if not held[to[a]]:
                        held[to[a]] = True
                        todo.append(to[a])
        if far[sink] >= INF:
            break
        most_here, v = INF, sink
        while v:
            most_here, v = min(most_here, cap[via[v]]), to[via[v] ^ 1]
        v = sink
        while v:
            cap[via[v]] -= most_here
            cap[via[v] ^ 1] += most_here
            v = to[via[v] ^ 1]
    return {(patterns[to[a ^ 1] - 1], sources[to[a] - 1 - n_p]): cap[a ^ 1] for a in range(middle, after, 2) if cap[a ^ 1]}


@dataclass
class Plan:
    """What the mix takes: sources (name, size, weight, target), patterns by key with their flow, and the seed."""

    sources: list[dict]
    patterns: pd.DataFrame
    flow: dict[tuple[str, str | None], int]
    seed: int
    border: DataFrame | None = None


def _with_order(docs: DataFrame, key: str, seed: int) -> DataFrame:
    return docs.withColumn("_h", F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 11))


def plan_mix(sized: DataFrame, root: str, key: str, weights, total_share: float = 1.0, most: int = 3, seed: int = 17) -> Plan:
    """Plans a mix of sized rows (key of any type, size, sources array); no rows give an empty plan. weights: {source: weight}, or a function of the sorted sources."""
    spark = sized.sparkSession
    rows = sized.select(F.col(key).alias("_doc"), "size", "sources").withColumn("_pattern", F.to_json(F.struct(F.array_sort(F.array_distinct("sources")).alias("s")), {"ignoreNullFields": "false"}))
    found = rows.groupBy("_pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns: name fewer, broader sources")
    found.sort(key=lambda r: r._pattern)
    names = sorted({s for r in found for s in set(r.sources or [])}, key=lambda s: (s is None, s or ""))
    at = {s: k for k, s in enumerate(names)}
    member = [sorted({at[s] for s in r.sources or []}) for r in found]
    sizes = [0] * len(names)
    for r, ss in zip(found, member, strict=True):
        for s in ss:
            sizes[s] += r.size
    w = weights(names) if callable(weights) else [weights.get(s, 0) for s in names]
    targets = fill_targets(sizes, w, total_share * sum(r.size for r in found), most) if names else []
    flow = min_cost_flow([r.size for r in found], member, whole_numbers(targets), most)
    given = [0] * len(found)
    for (p, _), words in flow.items():
        given[p] += words
    patterns = pd.DataFrame({"_pattern": [r._pattern for r in found], "epochs": [g // r.size if r.size else 0 for g, r in zip(given, found, strict=True)], "rest": [g % r.size if r.size else 0 for g, r in zip(given, found, strict=True)], "buckets": [max(1, min(int(np.ceil(np.sqrt(r.n))), r.n // BUCKET_ROWS)) for r in found]})
    plan = Plan([{"source": s, "size": z, "weight": x, "target": t} for s, z, x, t in zip(names, sizes, w, targets, strict=True)], patterns, {(found[p]._pattern, names[s]): n for (p, s), n in flow.items()}, seed)
    # where the rest ends, by the sums of hash buckets
    if not len(patterns):
        return plan
    table = F.broadcast(spark.createDataFrame(patterns))
    dealt = _bucketed(_with_order(rows, "_doc", seed), table)
    sums = dealt.filter("rest > 0").groupBy("_pattern", "_bucket", "rest").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("_pattern").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = sums.withColumn("before", before).filter("before <= rest and before + words > rest").select("_pattern", F.col("_bucket").alias("border"), F.expr("rest - before").alias("room"))
    ends = pd.DataFrame([r.asDict() for r in ends.collect()], columns=["_pattern", "border", "room"])  # one row a pattern
    plan.patterns = patterns.merge(ends, "left", "_pattern")
    for c, none in (("border", -1), ("room", 0)):
        plan.patterns[c] = pd.to_numeric(plan.patterns[c]).fillna(none).astype("int64")
    table = F.broadcast(spark.createDataFrame(plan.patterns))
    inside = _bucketed(_with_order(rows, "_doc", seed), table).filter("rest > 0 and _bucket = border")
    inside = inside.groupBy("_pattern", "_h", F.col("_doc").alias("_key"), "size", "room").agg(F.count(F.lit(1)).alias("n"))
    plan.border = S.materialised(inside.groupBy("_pattern").applyInPandas(_fill_border, f"_pattern string, _h long, _key {sized.schema[key].dataType.simpleString()}, size long, extra int"), f"{root}/border")
    return plan


def _fill_border(rows: pd.DataFrame) -> pd.DataFrame:
    """The border bucket's documents in seeded order: each that still fits the room, then one change that brings them nearest to it."""
    rows = rows.sort_values(["_h", "_key", "size"], na_position="first")
    words = (rows["size"] * rows.n).to_numpy(np.int64)
    return rows.assign(extra=fill_room(words, int(rows.room.iloc[0]) if len(rows) else 0))[["_pattern", "_h", "_key", "size", "extra"]]


def fill_room(words: np.ndarray, room: int) -> np.ndarray:
    """0 or 1 for each, in order: what still fits is taken.

    Then, if that brings the sum nearer to the room, one more is taken, or one goes or gives way to another; of equally
    near changes the first.
    """
    extra, left = np.zeros(len(words), np.int64), room
    for k, w in enumerate(words.tolist()):
        if w <= left:
            extra[k], left = 1, left - w
    if not left or not len(words):
        return extra
    out, taken = np.flatnonzero(extra == 0), np.flatnonzero(extra)
    changes = [(left, 0, -1, -1)]  # what is then left or over, order, one to add, one to drop
    if len(out):
        k = int(np.argmin(np.abs(words[out] - left)))
        changes.append((abs(int(words[out[k]]) - left), 1, int(out[k]), -1))
    if len(out) and len(taken):
        by = taken[np.argsort(words[taken], kind="stable")]
        want = words[out] - left
        at = np.searchsorted(words[by], want)
        for near in (np.clip(at - 1, 0, len(by) - 1), np.clip(at, 0, len(by) - 1)):
            off = np.abs(want - words[by[near]])
            k = int(np.argmin(off))
            changes.append((int(off[k]), 2, int(out[k]), int(by[near[k]])))
    _, _, add, drop = min(changes)
    if add >= 0:
        extra[add] = 1
    if drop >= 0:
        extra[drop] = 0
    return extra


def _bucketed(rows: DataFrame, table: DataFrame) -> DataFrame:
    return rows.join(table, "_pattern").withColumn("_bucket", F.expr("cast(floor(_h / 9007199254740992D * buckets) as long)"))


def apply_mix(docs: DataFrame, plan: Plan, key: str = "doc_id") -> DataFrame:
    """docs (with size and sources) and how often the mix takes each: copies int. Only border buckets are shuffled.

    Other columns may have any names, and pass; one named copies is replaced. Rows that share key, size and sources are
    taken alike; null keys, and null or empty sources, are ordinary values. No rows of docs are lost.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c != "copies"]
    docs = docs.select(*names)
    if plan.border is None:
        return docs.withColumn("copies", F.lit(0))
    # columns of the plan must not meet those of docs
    rows = docs.toDF(*(f"_c{k}" for k in range(len(names)))).withColumns({n: F.col(f"_c{names.index(c)}") for n, c in (("_doc", key), ("size", "size"), ("sources", "sources"))})
    rows = rows.withColumn("_pattern", F.to_json(F.struct(F.array_sort(F.array_distinct("sources")).alias("s")), {"ignoreNullFields": "false"}))
    rows = _bucketed(_with_order(rows, "_doc", plan.seed), F.broadcast(spark.createDataFrame(plan.patterns)))
    at_border = (F.col("rest") > 0) & (F.col("_bucket") == F.col("border"))
    plain = rows.filter(~at_border).withColumn("extra", F.expr("int(rest > 0 and (border < 0 or _bucket < border))"))
    b = plan.border.select("_pattern", "_h", F.col("_key").alias("_k"), F.col("size").alias("_s"), "extra")
    inside = rows.filter(at_border).alias("r").join(b.alias("b"), (F.col("r._pattern") == F.col("b._pattern")) & (F.col("r._h") == F.col("b._h")) & F.col("r._doc").eqNullSafe(F.col("b._k")) & (F.col("r.size") == F.col("b._s")), "left").select("r.*", "b.extra")
    both = plain.unionByName(inside).withColumn("copies", (F.col("epochs") + F.coalesce("extra", F.lit(0))).cast("int"))
    return both.select(*(F.col(f"_c{k}").alias(c) for k, c in enumerate(names)), "copies")


def repeating_weights(names: list) -> list[float]:
    """1, 2, 3, 1, 2, 3, ... over the sorted sources."""
    return [1 + k % 3 for k in range(len(names))]


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=repeating_weights, most: int = 3, seed: int = 17) -> DataFrame:
    """Mixes documents of one source each: (key, size, source, source_size, target, copies, taken), one row a document.

    A document's size is its number of words; taken is copies times size. A null text has no words; null is a source
    of its own, sorted last; a null key is ordered first; equal rows are taken together. An empty table gives none.
    For documents with several sources use plan_mix() and apply_mix().
    """
    spark, root = docs.sparkSession, S.shared_root(docs.sparkSession)
    sized = docs.select(F.col(key).alias("doc_id"), word_count(F.col(text)).alias("size"), F.array(F.col(source).cast("string")).alias("sources"))
    sized = S.materialised(sized, f"{root}/sized")
    plan = plan_mix(sized, root, "doc_id", weights, most=most, seed=seed)
    taken = apply_mix(sized, plan, "doc_id")
    known = spark.createDataFrame([(s["source"], s["size"], float(s["target"])) for s in plan.sources], "s string, source_size long, target double")
    out = taken.withColumn("source", F.col("sources")[0]).join(F.broadcast(known), F.col("source").eqNullSafe(F.col("s")))
    return out.select(F.col("doc_id").alias(key), "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
