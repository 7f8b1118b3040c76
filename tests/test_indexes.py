"""Full-text index, inverted lists and tiers against SQL and plain versions."""

import re

import numpy as np
import pytest

from siltmark import catalog
from siltmark.operators import candidates, fulltext, vectors


def test_websearch():
    show = lambda q: [[("-" if u.without else "") + " ".join(u.words) for u in g] for g in fulltext.websearch(q)]
    assert show('fat "Big Rat" -cat or dog') == [["fat", "big rat", "-cat"], ["dog"]]
    assert show("foo-bar or or -\"x y\" ''") == [["foo bar"], ["-x y"]]
    assert show("") == [] and show("OR") == []


def test_full_text_edges(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "Ä b ä"), (4, "a b a b a"), (5, "b a " * 50_000), (6, "c")]
    path = f"file://{tmp_path}/i"
    fulltext.build(spark.createDataFrame(rows, "id long, body string"), "id", "body", path, 8, 2)
    ids = lambda q: sorted(r.key for r in fulltext.search(spark, path, q, 8).collect())
    assert ids("ä") == [3] and ids('"a b a"') == [4, 5] and ids("a or c") == [4, 5, 6] and ids("-a") == [1, 2, 3, 6] and ids("a -c") == [4, 5] and ids("...") == []
    scores = {r.key: r.score for r in fulltext.search(spark, path, "a", 8).collect()}
    assert scores[4] == pytest.approx(0.1 * (1 + 1 / 4 + 1 / 9) / 1.6449340668482264, abs=1e-8) and scores[5] == pytest.approx(0.1 * (1 + 1 / 2) / 2, rel=1e-3)
    plan = fulltext.search(spark, path, "a c", 8)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "In(term" in plan and "/texts" not in plan
    fulltext.build(spark.createDataFrame([], "id long, body string"), "id", "body", f"{path}2", 8, 2)
    spark.createDataFrame([(1, "a")], "id long, body string")


def test_places_are_found_without_a_shuffle(spark):
    texts = {k: [f"w{(k * j) % 7}" for j in range(k % 11)] for k in range(40)}
    words = spark.createDataFrame(list(texts.items()), "key long, ws array<string>").coalesce(1)
    found = fulltext.places(words, 8)
    want = {(t, k): [j for j, w in enumerate(ws) if w == t] for k, ws in texts.items() for t in ws}
    assert sorted((r.term, r.key, r["at"]) for r in found.collect()) == sorted((t, k, at) for (t, k), at in want.items())
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def plain_files(paths, framework):
    """paths in listed order, read rule by rule."""
    from siltmark import fixed

    known = fixed.ROUTE_SOURCES[framework]
    fits = lambda p: re.search(known["files"], p.split("/")[-1])
    name = lambda p: p.split("/")[-1]
    under = lambda p, dirs: set(p.split("/")[:-1]) & set(dirs)
    out = [p for p in reversed(paths) if name(p) in known["always"]]
    out += [p for p in paths if p not in out and (("/" not in p and name(p) in known["names"]) or (under(p, known["dirs"]) and fits(p)))]
    if len(out) < 8:
        out += [p for p in paths if name(p) in known["names"] and p not in out]
    out = out or [p for p in paths if fits(p) and under(p, fixed.BROAD_DIRS)]
    out = out or [p for p in paths if "/" not in p and fits(p)]
    return out[:30]


@pytest.mark.parametrize("framework", ["fastapi", "django", "express", "nextjs", "generic"])
def test_tiers_equal_a_plain_reading(spark, framework):
    rng = np.random.default_rng(5)
    dirs, names = ["", "app/", "lib/", "docs/", "pages/api/", "src/core/", "routes/"], ["main.py", "urls.py", "x.py", "index.js", "route.ts", "a.md"]
    repos = {}
    for repo in range(40):
        pool = sorted({f"{d}{k}/{n}" if k and d else f"{d}{n}" for d in rng.choice(dirs, 3) for n in rng.choice(names, 3) for k in range(rng.integers(1, 30))})
        repos[repo] = [str(p) for p in rng.permutation(pool)]
    rows = [(repo, p, "blob", k) for repo, ps in repos.items() for k, p in enumerate(ps)] + [(99, "app/main.py", "tree", 0)]
    got = {}
    for r in candidates.route_files(spark.createDataFrame(rows, "repo_id int, path string, type string, place int"), framework).orderBy("repo_id", "rank").collect():
        got.setdefault(r.repo_id, []).append(r.path)
    assert got == {repo: want for repo, ps in repos.items() if (want := plain_files(ps, framework))}


@pytest.mark.parametrize("clustered", [True, False])
def test_recall_of_opened_lists(spark, tmp_path, clustered):
    rng = np.random.default_rng(6)
    centers = rng.standard_normal((60, 24)) * (3 if clustered else 0)
    x = centers[rng.integers(0, 60, 4000)] + rng.standard_normal((4000, 24))
    x[:1300] = x[0] + 0.01 * rng.standard_normal((1300, 24))  # a third in one list
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 24)], "id long, v array<double>")
    index = vectors.build(df, "id", "v", f"file://{tmp_path}", lists=40)
    asked = df.filter("id % 100 = 0 and id < 4000").selectExpr("id as query", "v")
    found = {}
    for r in vectors.nearest(spark, index, asked).collect():
        found.setdefault(r.query, {})[r.rank] = (r.key, r.score)
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, got in found.items():
        near = y @ y[q]
        near[q] = -np.inf
        true = np.argsort(-near)[:10]
        assert sorted(got) == list(range(1, 11)) and all(s == pytest.approx(near[k]) for k, s in got.values())
        hits += sum(near[k] >= near[true[-1]] - 1e-12 for k, _ in got.values())
    assert len(found) == 40 and hits / 400 >= 0.9
    if clustered:
        assert index.probes <= 12


def test_recall_on_the_tables(spark, sf):
    near = lambda name: {(r.query, r.vec_id) for r in catalog.QUERIES[name](spark, sf).collect()}
    true, got = near("exact_list_neighbours"), near("list_neighbours")
    assert len(true & got) >= 0.9 * len(true)


def test_no_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "id long, v array<double>")
    index = vectors.build(df, "id", "v", f"file://{tmp_path}")
    assert vectors.nearest(spark, index, df.selectExpr("id as query", "v")).count() == 0
