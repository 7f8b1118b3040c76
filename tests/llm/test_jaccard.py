"""The join against all pairs of an inverted index, and the tree's bounds."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from siltmark.llm import jaccard
from siltmark.llm.queries import QUERIES

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, n=5, percent=75):
    sets, same = {}, defaultdict(list)
    for k, (key, text) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
        for s in sets[k]:
            same[s].append(k)
    up = {k: k for k in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        if rows[a][0] is None:
            continue
        for b, both in Counter(b for s in sets[a] for b in same[s] if b < a and rows[b][0] is not None).items():
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[top(a)] = top(b)
    least = {}
    for k, (key, _) in enumerate(rows):
        if key is not None:
            least[top(k)] = min(key, least.get(top(k), key))
    return sorted(((key, len(sets[k]), None if key is None else least[top(k)]) for k, (key, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("where", ["sf0.001", "sf0.01"])
def test_op7(spark, where):
    sf = f"/root/testdata/{where}"
    rows = [(d["doc_id"], d["text"]) for d in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    got = QUERIES["op7_ngram_jaccard_join"](spark, sf).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def family(r, base, edits):
    w = list(base)
    for _ in range(edits):
        w[r.randrange(len(w))] = r.choice("abcdefgh") * r.randrange(1, 9)
    return " ".join(w)


def test_families_near_the_border(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 40)  # several blocks a group
    r = random.Random(4)
    rows, key = [], 0
    for f in range(6):
        base = ["".join(r.choice("xyzuvw") for _ in range(5)) for _ in range(60 + 20 * f)]
        for _ in range(60):
            rows.append((key, family(r, base, r.randrange(0, 5))))
            key += 1
    shared = " ".join("p%d" % k for k in range(30))
    for _ in range(60):
        rows.append((key, " ".join(r.choice("abcdefghijk") * 3 for _ in range(40)) + " " + shared))
        key += 1
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = jaccard.similar(df).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == brute(rows)


def test_edges(spark):
    schema = "doc_id long, text string, node long, root long, p int"
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, "x " * 30000), (8, "X " * 40000), (None, "one two"), (9, "É a b c d e"), (10, "é a b c d e"), (11, "same text as the other one"), (11, "same text as the other one"), (11, "quite another text than that one")]
    got = jaccard.similar(spark.createDataFrame([(*x, 1, 2, 3) for x in rows], schema)).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == brute(rows)
    assert jaccard.similar(spark.createDataFrame([], schema)).count() == 0


def test_links_equal_all_pairs():
    rng = np.random.default_rng(1)
    for trial in range(30):
        base = rng.integers(1, 1 << 40, 50).astype(np.uint64)
        sets = []
        for _ in range(90):
            s = base.copy()
            hit = rng.random(50) < rng.choice([0.02, 0.1, 0.3])
            s[hit] = rng.integers(1, 1 << 40, hit.sum()).astype(np.uint64)
            sets.append(np.unique(s[: rng.integers(20, 51)]))
        want = {k: {k} for k in range(90)}
        for a in range(90):
            for b in range(a):
                i = len(np.intersect1d(sets[a], sets[b]))
                if 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
                    both = want[a] | want[b]
                    for x in both:
                        want[x] = both
        got = {k: {k} for k in range(90)}
        for a, b in jaccard.links(sets, 75):
            both = got[a] | got[b]
            for x in both:
                got[x] = both
        assert got == want


def test_links_of_tiny_sets():
    a, b = np.array([1, 2, 3], np.uint64), np.array([1, 2, 3, 4], np.uint64)
    assert len(jaccard.links([a, b, np.array([9], np.uint64), a], 75)) == 2
    assert jaccard.links([np.array([k], np.uint64) for k in range(5)], 75) == []
