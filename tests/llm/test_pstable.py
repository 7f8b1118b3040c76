"""Links found by hashing against all pairs of a group."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from siltmark.llm import pstable
from siltmark.llm.queries import QUERIES


def brute(rows, least=0.93):
    """rows (key, label, vector) to sorted (key, n_links, component, kept)."""
    fit = [lab is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, lab, v in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    n = [0] * len(rows)
    groups = {}
    for i, (_, lab, v) in enumerate(rows):
        if fit[i]:
            groups.setdefault((lab, len(v)), []).append(i)
    for members in groups.values():
        x = np.array([rows[i][2] for i in members], float)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= least, 1)), strict=True):
            i, j = members[a], members[b]
            n[i], n[j] = n[i] + 1, n[j] + 1
            root[top(i)] = top(j)
    least_key = {}
    for i, (key, *_) in enumerate(rows):
        if key is not None:
            least_key[top(i)] = min(key, least_key.get(top(i), key))
    return sorted(((key, n[i], least_key.get(top(i)), key is not None and key == least_key[top(i)]) for i, (key, *_) in enumerate(rows)), key=str)


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_op11(spark, sf):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in pq.read_table(f"{sf}/embeddings.parquet").to_pylist()]
    assert plain(QUERIES["op11_embedding_near_dedup"](spark, sf)) == brute(rows)


def near(rng, v, cos):
    """A vector with this cosine to v."""
    v = v / np.linalg.norm(v)
    w = rng.standard_normal(len(v))
    w -= w @ v * v
    return cos * v + math.sqrt(1 - cos * cos) * w / np.linalg.norm(w)


def test_recall_and_precision_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(1500):
        v = rng.standard_normal(48)
        cos = rng.choice([0.90, 0.9299, 0.9301, 0.94, 0.97, 0.999])
        rows += [(2 * k, k % 3, v.tolist()), (2 * k + 1, k % 3, (near(rng, v, cos) * rng.uniform(0.1, 9)).tolist())]
    got = {r[0]: r for r in plain(pstable.similar(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")))}
    want = {r[0]: r for r in brute(rows)}
    assert all(got[i][1] <= want[i][1] for i in got)  # none below the threshold
    assert sum(r[1] for r in got.values()) >= 0.99 * sum(r[1] for r in want.values()) > 1500


def test_large_group_of_near_copies_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    center = rng.standard_normal(32)
    rows = [(k, 1 if k % 3 else 2, near(rng, center, 0.985).tolist()) for k in range(700)] + [(1000 + k, 1, rng.standard_normal(32).tolist()) for k in range(700)]
    rows += [(5000 + k, 1, rows[1][2]) for k in range(40)]
    monkeypatch.setattr(pstable, "BLOCK", 64)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(8)
    rows = [(r.vec_id, r.label, r.embedding) for r in df.collect()]
    got, want = plain(pstable.similar(df)), brute(rows)
    assert sum(r[1] for r in got) >= 0.998 * sum(r[1] for r in want)
    assert [(r[0], r[2], r[3]) for r in got] == [(r[0], r[2], r[3]) for r in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))


def test_edges(spark):
    schema = "vec_id long, label string, embedding array<double>, node long, h long, copies int, root string"
    a, b = [1.0, 2.0, 3.0], [1.0, 2.0, 3.0001]
    rows = [(1, "x", a), (2, "x", b), (2, "x", b), (3, "y", a), (4, None, a), (5, "x", None), (6, "x", [0.0, 0.0]), (7, "x", [1.0, None, 3.0]), (8, "x", [float("nan"), 1.0, 1.0]), (9, "x", [float("inf"), 1.0, 1.0]), (10, "x", []), (None, "x", [2.0, 4.0, 6.0]), (None, "z", a), (11, "x", [1.0, 2.0]), (12, "x", [1e300, 2e300, 3e300]), (13, "x", [-1.0, -2.0, -3.0])]
    df = spark.createDataFrame([(*r, 1, 2, 3, "r") for r in rows], schema)
    assert plain(pstable.similar(df)) == brute(rows)
    assert pstable.similar(spark.createDataFrame([], schema)).count() == 0
    assert plain(pstable.similar(df.filter("vec_id in (5, 6)"))) == [(5, 0, 5, True), (6, 0, 6, True)]


@pytest.mark.parametrize("n", [10, 10_000, 10**9])
def test_tables_reach_the_stated_chance(n):
    k, tables = pstable.plan_tables(n, 0.93)
    assert (1 - pstable.collision(math.sqrt(0.14)) ** k) ** tables <= pstable.MISS
    assert n * pstable.collision(math.sqrt(2)) ** k <= 1
