"""Resampling against plain counting, at one order and at more."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow.parquet as pq

from siltmark.llm import resample
from siltmark.llm.queries import QUERIES


def grams(text, orders):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return ws, [" ".join(ws[i : i + n]) for n in range(1, orders + 1) for i in range(len(ws) - n + 1)]


def brute(docs, target, orders=1, buckets=10_000, least=20, share=(10, 100), seed=2024):
    at = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(at, grams(x, orders)[1]))
    for x in target:
        t.update(map(at, grams(x, orders)[1]))
    alls, allt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (alls + buckets) / ((s[b] + 1.0) * (allt + buckets)))) for b in s}
    rows = []
    for k, (key, x) in enumerate(docs):
        ws, fs = grams(x, orders)
        weight = sum(gain[at(g)] for g in fs)
        h = int(hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(ws), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, k])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[6]))
    for place, r in enumerate(fit[: len(fit) * share[0] // share[1]], 1):
        r[5] = place
    return [tuple(r[:6]) for r in rows]


def plain(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)


def test_op13(spark, sf):
    docs = [(d["doc_id"], d["text"]) for d in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    target = pq.read_table(f"{sf}/benchmark.parquet").column("text").to_pylist()
    want = brute(docs, target)
    assert plain(QUERIES["op13_importance_resampling"](spark, sf)) == sorted(want, key=str)
    assert sum(r[5] is not None for r in want) > 5


def test_longer_orders_by_windows(spark):
    docs = [(k, " ".join(f"W{(k * j) % 17} é{j % 5}" for j in range(k % 40))) for k in range(120)]
    target = ["w1 é1 w2 é2 w3", None, ""]
    got = resample.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x,) for x in target], "text string"), share=(1, 3), orders=3, buckets=97)
    assert plain(got) == sorted(brute(docs, target, 3, 97, share=(1, 3)), key=str)


def test_edges(spark):
    schema = "doc_id long, text string, _row int, bucket string, rank int, pos int, word string"
    long = " ".join(f"w{k % 900}" for k in range(200_000))
    docs = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (3, "c " * 30), (None, "x " * 25), (None, "x " * 25), (9, long), (10, "ÀB\x00c-d_e 9"), (11, "same " * 20), (12, "same " * 20)]
    df = spark.createDataFrame([(*r, 7, "b", 1, 2, "w") for r in docs], schema)
    target = spark.createDataFrame([("x w1", 1), (None, 2)], "text string, gain int")
    got = plain(resample.resample(df, target, share=(1, 2), orders=1))
    want = brute(docs, ["x w1", None], share=(1, 2))
    assert got == sorted(want, key=str)
    none = spark.createDataFrame([], schema)
    assert resample.resample(none, target).count() == 0
    assert plain(resample.resample(df, target.limit(0), share=(1, 2), orders=1)) == sorted(brute(docs, [], share=(1, 2)), key=str)


def test_no_text_is_shuffled(spark, sf, tmp_path):
    docs, aim = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = resample.weights(docs, aim, f"file://{tmp_path}", orders=1)._jdf.queryExecution().executedPlan().toString()
    import re as r

    assert not any("text" in line for line in plan.split("\n") if r.search(r"Exchange (hash|range)", line))
    assert plan.count("BroadcastHashJoin") >= 1 and "CartesianProduct" not in plan
