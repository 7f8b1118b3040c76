"""Runs of words against the definition, tried at every period and start."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from siltmark.llm import periodic
from siltmark.llm.queries import QUERIES


def brute(w, least=12):
    """(start, period, end) of every run."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        same = np.array([a == b for a, b in zip(w, w[q:])] + [False])
        i = 0
        for j in np.flatnonzero(~same):
            if j > i and j - i + q >= max(least, 2 * q):
                out.setdefault((i, int(j) + q), q)
            i = int(j) + 1
    return sorted((s, p, e) for (s, e), p in out.items())


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def kept(w, runs):
    return [x for i, x in enumerate(w) if not any(s + p <= i < e for s, p, e in runs)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digest(doc_id, text):
    w = words_of(text)
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = brute(w)
    best = max(runs, key=lambda r: (r[2] - r[0], -r[0], -r[1]), default=None)
    one = (best[0], best[2] - best[0], best[1], 1000 * (best[2] - best[0]) // best[1]) if best else (None,) * 4
    return (doc_id, len(runs), *one, sha("".join(f"{s},{e - s},{p}\n" for s, p, e in runs)), sha(" ".join(kept(w, runs))))


def test_op12(spark, sf):
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    docs = [d for d in docs if len(words_of(d["text"])) < 4000]  # the plain version is quadratic; SQL holds all texts
    got = {r[0]: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, sf).collect()}
    assert len(docs) > 150 and all(got[d["doc_id"]] == digest(d["doc_id"], d["text"]) for d in docs)
    assert sum(r[1] > 0 for r in got.values()) > 10


@pytest.mark.parametrize("least", [2, 5, 12])
def test_find_equals_the_definition(least):
    rng = random.Random(least)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 4)):
            n, k = rng.choice([0, 1, 5, 12, 13, 40, 100, rng.randint(0, 200)]), rng.choice([1, 2, 2, 3, 5, 50])
            w = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.6:
                a, b = rng.randrange(n), rng.randint(0, n)
                p = 1 + rng.randrange(max(1, (n - a) // 2))
                w = [w[a + (i - a) % p] if a <= i < b else w[i] for i in range(n)]
            docs.append(w)
        x = np.array([v for w in docs for v in w], np.int32)
        d, s, e, p = periodic.find(x, np.concatenate(([0], np.cumsum([len(w) for w in docs]))), least)
        for k, w in enumerate(docs):
            got = [(int(a), int(b), int(c)) for a, b, c in zip(s[d == k], p[d == k], e[d == k])]
            assert got == brute(w, least)


def test_long_repetitive_texts_stay_quick():
    a, b = "0", "01"
    while len(b) < 60_000:
        a, b = b, b + a
    for w in ([0] * 200_000, [0, 1] * 100_000, [0] * 50_000 + [1] + [0] * 50_000 + [2], list(map(int, b))):
        x = np.array(w, np.int32)
        began = time.process_time()
        d, *_ = periodic.find(x, np.array([0, len(x)]))
        assert len(d) and time.process_time() - began < 60


def test_edges(spark):
    schema = "doc_id long, text string, n_words int, _0 string"
    long = " ".join(["lorem ipsum"] * 60_000)
    rows = [(1, None), (2, ""), (3, " \t\n\x0b"), (4, "a " * 11), (5, "a " * 12), (6, "x a b é " * 5 + "tail"), (6, "x a b é " * 5 + "tail"), (None, "b " * 12), (7, long)]
    df = spark.createDataFrame([(*r, 9, "z") for r in rows], schema)
    got = sorted(map(tuple, periodic.digests(periodic.find_runs(df, keep=["doc_id"])).collect()), key=str)
    want = []
    for key, text in rows:
        w = words_of(text)
        runs = brute(w) if len(w) < 1000 else [(0, 2, len(w))]
        best = runs[0] if runs else None
        want.append((key, len(runs), *((best[0], best[2] - best[0], best[1], 1000 * (best[2] - best[0]) // best[1]) if best else (None,) * 4), sha("".join(f"{s},{e - s},{p}\n" for s, p, e in runs)), sha(" ".join(kept(w, runs)))))
    assert got == sorted(want, key=str)
    everything = periodic.find_runs(df.drop("n_words")).filter("doc_id = 6").collect()
    assert [r._0 for r in everything] == ["z", "z"] and everything[0].collapsed_text == "x a b é tail" and everything[0].n_words == 16
    assert [tuple(r) for r in everything[0].runs] == [(0, 15, 3)]
    assert periodic.find_runs(spark.createDataFrame([], schema), keep=["doc_id"]).count() == 0
    planted = {r.doc_id: r.text for r in periodic.with_planted_runs(spark.createDataFrame([(k, "q w e r t y u i o p a s d f g h") for k in range(60)] + [(61, None)], "doc_id long, text string")).collect()}
    assert planted[61] is None and len(set(planted.values())) > 3
