"""Recall and exact scores against brute force."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from siltmark.llm import _shared as S
from siltmark.llm import ann
from siltmark.llm.queries import QUERIES


def brute(ids, x, top=10, every=100):
    out = {}
    for k in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[k]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if i != k][:top]
        out[int(ids[k])] = [(int(ids[i]), float(d[i])) for i in order]
    return out


def recall(got, want):
    mine = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        mine.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(mine[r.query_id])
    assert mine.keys() == want.keys()
    hit = total = 0
    for q, w in want.items():
        assert len(mine[q]) == len(w) and len({v for v, _ in mine[q]}) == len(w)
        assert [s for _, s in mine[q]] == sorted(s for _, s in mine[q])
        hit += sum(s <= w[-1][1] + 1e-12 for _, s in mine[q])
        total += len(w)
    return hit / total


@pytest.mark.parametrize("where", ["sf0.001", "sf0.1"])
def test_op10(spark, where):
    t = pq.read_table(f"/root/testdata/{where}/embeddings.parquet").to_pandas()
    ids, x = t.vec_id.to_numpy(), np.array(t.embedding.tolist(), np.float64)
    got = QUERIES["op10_nn_descent_search"](spark, f"/root/testdata/{where}").collect()
    place = {int(k): n for n, k in enumerate(ids)}
    for r in got:
        assert r.score == pytest.approx(np.sqrt(((x[place[r.query_id]] - x[place[r.vec_id]]) ** 2).sum()), abs=1e-12)
    assert recall(got, brute(ids, x)) >= 0.97


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, q long, d double, id long"
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    rows += [(k, [1.0, 0.0]) for k in range(10, 60)] + [(100, [2.0, 0.0]), (200, [-0.0, 3.0]), (201, [0.0, 3.0])]
    got = ann.nearest(spark.createDataFrame([(*r, 1, 2.0, 3) for r in rows], schema)).collect()
    by = {q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (0, 100, 200)}
    assert by[0] == [(k, 0.0) for k in range(10, 20)]
    assert by[100] == [(0, 1.0)] + [(k, 1.0) for k in range(10, 19)]
    assert by[200][0] == (201, 0.0) and len(by[200]) == 10
    assert {r.query_id for r in got} == {0, 100, 200}
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0], 1, 2.0, 3)], schema)).count() == 0
    twice = ann.nearest(spark.createDataFrame([(0, [1.0], 1, 2.0, 3)] * 2 + [(1, [2.0], 1, 2.0, 3)], schema)).collect()
    assert [(r.vec_id, r.score) for r in sorted(twice, key=lambda r: r.rank)][:2] == [(0, 0.0), (1, 1.0)]


def test_walk_goes_on_until_no_candidate_is_open(spark):
    nodes = spark.createDataFrame([(k, [float(k), 1.0], [k + 1] if k < 30 else [], [1.0] if k < 30 else []) for k in range(31)], "id long, v array<float>, w array<long>, d array<double>")
    queries = spark.createDataFrame([(0, [30.0, 1.0], 0)], "q long, qv array<float>, start long")
    got = ann.search(nodes, queries, S.shared_root(spark), beam=4).collect()
    assert sorted((r.d, r.id) for r in got) == [(0.0, 30), (1.0, 29), (2.0, 28), (3.0, 27)]


def test_recall_of_many_random_vectors(spark):
    ids, x = np.arange(20_000), np.random.default_rng(5).standard_normal((20_000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    got = ann.nearest(spark.createDataFrame(list(zip(ids.tolist(), x.tolist())), "vec_id long, embedding array<float>")).collect()
    assert recall(got, brute(ids, x.astype(np.float64))) >= 0.95


def test_neighbours_that_a_node_lists_meet_each_other_and_those_that_list_it(spark):
    at = {0: 0.0, 1: 10.0, 2: 11.0, 3: 50.0, 4: 60.0, 5: 9.0}
    lists = {0: [1, 2], 1: [3, 4], 2: [3, 4], 3: [4], 4: [3], 5: [0]}  # 0 lists 1 and 2; 5 lists 0
    rows = [(k, [at[k], 1.0], float("inf"), w, [abs(at[k] - at[x]) for x in w], [False] * len(w), 0) for k, w in lists.items()]
    got = {r.id: r.w for r in ann.descend(spark.createDataFrame(rows, ann.GRAPH), 4, 7, 4, f"{S.shared_root(spark)}/round").collect()}
    assert 2 in got[1] and 1 in got[2]
    assert {1, 2} <= set(got[5]) and 5 in got[1]


def test_doubles_keep_their_precision(spark):
    rows = [(0, [1.0, 1.0]), (1, [1.0, 1.0 + 1e-9]), (2, [1.0, 3.0])]
    got = sorted(map(tuple, ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert [r[:3] for r in got] == [(0, 1, 1), (0, 2, 2)] and got[0][3] == pytest.approx(1e-9, rel=1e-6)
