"""Targets, the flow and the mix."""

from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st

from siltmark.llm import _shared as S, mixing
from siltmark.llm.queries import QUERIES


def test_targets_reshare_the_excess():
    assert mixing.fill_targets([10, 100], [1, 1], 110, 3) == [30.0, 80.0]
    assert mixing.fill_targets([0, 5], [1, 1], 5, 3) == [0.0, 5.0]
    assert sum(mixing.whole_numbers([1.5, 1.5, 2.0])) == 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.sets(st.integers(0, 2), min_size=1)), min_size=1, max_size=3), st.lists(st.integers(0, 5), min_size=3, max_size=3))
def test_flow_is_cheapest(patterns, quota):
    cap, member = [c for c, _ in patterns], [sorted(m) for _, m in patterns]
    flow = mixing.min_cost_flow(cap, member, quota, 2)

    def cost(given):
        return sum(max(0, g - c) for g, c in zip(given, cap))

    given = [sum(n for (p, _), n in flow.items() if p == k) for k in range(len(cap))]
    for s in range(3):
        assert sum(n for (_, x), n in flow.items() if x == s) <= quota[s]
    # brute force over what each pattern gives each source
    arcs = [(p, s) for p in range(len(cap)) for s in member[p]]
    best = (0, 0)
    for pick in product(range(6), repeat=len(arcs)) if len(arcs) <= 5 else []:
        g, q = defaultdict(int), defaultdict(int)
        for (p, s), n in zip(arcs, pick):
            g[p] += n
            q[s] += n
        if all(q[s] <= quota[s] for s in q) and all(g[p] <= 2 * cap[p] for p in g):
            best = min(best, (-sum(pick), cost([g[p] for p in range(len(cap))])))
    if len(arcs) <= 5:
        assert (-sum(given), cost(given)) == best


def check(rows, docs):
    size, members = defaultdict(int), defaultdict(int)
    for r in rows:
        size[r.source] += r.size
        members[r.source] += r.taken
        assert r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
    names = sorted(size, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, mixing.fill_targets([size[s] for s in names], [1 + k % 3 for k in range(len(names))], sum(size.values()), 3)))
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(targets[r.source])
    return {s: (members[s], targets[s]) for s in names}


def test_op1(spark, sf):
    docs = {d["doc_id"]: d for d in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    rows = QUERIES["op1_source_mix"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.size == len((docs[r.doc_id]["text"] or "").encode().split()) and r.source == docs[r.doc_id]["source"]
    n = Counter(r.source for r in rows)
    for s, (taken, target) in check(rows, docs).items():
        assert abs(taken - target) <= max(20, 0.5 * min(r.size for r in rows if r.source == s)) or n[s] < 12
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op1_source_mix"](spark, sf).repartition(3).collect()))


def test_edges(spark):
    schema = "doc_id long, text string, source string, size string, copies int, target string"
    rows = [(k, "w " * (k % 7), ["a", "b", None, "é"][k % 4], "x", 1, "y") for k in range(400)] + [(1, "w", "a", "x", 1, "y")] * 3 + [(None, None, None, None, None, None)]
    got = mixing.mix(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    for taken, target in check(got, rows).values():
        assert abs(taken - target) <= 8
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    assert [r.taken for r in mixing.mix(spark.createDataFrame([(1, "", "a", "", 1, "")], schema)).collect()] == [0]


def test_overlapping_sources(spark):
    rows = [(k, 5, ["a", "b"] if k % 3 == 0 else ["a"] if k % 3 == 1 else ["b", "a", "a"]) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, size long, sources array<string>")
    plan = mixing.plan_mix(docs, S.shared_root(spark), "doc_id", {"a": 3, "b": 1})
    got = mixing.apply_mix(docs, plan).collect()
    assert abs(sum(r.size * r.copies for r in got) - sum(s["target"] for s in plan.sources)) <= 15
    assert len(plan.patterns) == 2 and max(r.copies for r in got) <= 3


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=9), st.integers(0, 120))
def test_room_is_filled_by_one_rule(words, room):
    """No single addition, removal or exchange comes nearer, whatever the number of documents."""
    extra = mixing.fill_room(np.array(words, np.int64), room)
    off = abs(int((np.array(words, np.int64) * extra).sum()) - room)
    taken, out = [w for w, x in zip(words, extra) if x], [w for w, x in zip(words, extra) if not x]
    total, greedy = sum(taken), 0
    for w in words:
        greedy += w if greedy + w <= room else 0
    assert off <= room - greedy
    if total == greedy:
        assert all(abs(total + w - room) >= off for w in out)
        assert all(abs(total + w - t - room) >= off for w in out for t in taken)


def targets_by_hand(sizes, weights, most):
    """Shares of all words by weight, found by bisection of the common level: a source stops at most times its size."""
    lo, hi = 0.0, 1.0 + most * sum(sizes)
    total = sum(sizes)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if sum(min(w * mid, most * n) for n, w in zip(sizes, weights)) >= total else (mid, hi)
    return [min(w * hi, most * n) for n, w in zip(sizes, weights)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=8))
def test_targets_by_another_way(sizes):
    weights = mixing.repeating_weights(sizes)
    assert mixing.fill_targets(sizes, weights, sum(sizes), 3) == pytest.approx(targets_by_hand(sizes, weights, 3), abs=1e-6)


def test_clashing_columns_text_keys_and_a_very_long_text(spark):
    names = ("epochs", "rest", "buckets", "border", "room", "extra", "_h", "_pattern", "_bucket")
    rows = [(f"d{k}", 5 if k else 90_000, ["a" if k % 3 else "b"], *range(len(names))) for k in range(200)] + [(None, 5, ["a"], *range(len(names)))]
    docs = spark.createDataFrame(rows, "doc string, size long, sources array<string>, " + ", ".join(f"`{n}` int" for n in names))
    plan = mixing.plan_mix(docs, S.shared_root(spark), "doc", {"a": 1, "b": 2})
    got = mixing.apply_mix(docs, plan, "doc").collect()
    assert len(got) == 201 and all(r.rest == 1 and r.room == 4 for r in got) and max(r.copies for r in got) <= 3
    one = mixing.mix(spark.createDataFrame([("k", "w " * 200_000, "a")], "doc_id string, text string, source string")).first()
    assert (one.doc_id, one.size, one.taken) == ("k", 200_000, 200_000)
