"""The chain on held-out labels, and on odd tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltmark.llm import _shared as S, toxicity
from siltmark.llm.queries import QUERIES


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    away = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    chain = toxicity.train(docs, labels.filter(~away), toxicity.TARGETS, S.shared_root(spark))
    got = toxicity.score(docs, chain, keep=["doc_id"]).join(labels.filter(away), "doc_id").toPandas()
    p, y = got.p_toxic >= 0.5, got.toxic == 1
    assert (p & y).sum() / y.sum() >= 0.88
    assert (p & ~y).sum() / (~y).sum() <= 0.005
    assert ((got.p_low_quality >= 0.5) == (got.quality == 0)).mean() >= 0.85


def test_op9_covers_every_document(spark, sf):
    got = QUERIES["op9_toxicity_chain"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
    assert all(0 <= r.p_toxic <= 1 and r.toxic == int(r.p_toxic >= 0.5) for r in got)


def test_later_models_use_earlier_probabilities(spark):
    r = random.Random(1)
    docs, labels = [], []
    for k in range(600):
        a = r.random() < 0.4
        docs.append((k, " ".join([r.choice(["red", "blue", "green", "grey"]) for _ in range(20)] + ["vile"] * a)))
        labels.append((k, int(a), int(a)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, first int, second int")
    chain = toxicity.train(docs, labels, {"first": "first", "second": "second"}, S.shared_root(spark))
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1 and chain.weights[1][-2] > 0.1


def test_edges(spark):
    schema = "doc_id long, text string, toxic string, _p int, key int"
    docs = spark.createDataFrame([(1, None, "x", 1, 2), (2, "", "x", 1, 2), (None, "some idiot", "x", 1, 2), (4, "long " * 50_000, "x", 1, 2), (4, "long", "x", 1, 2)], schema)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 1, 1), (4, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.classify(docs, labels).count() == 5
    assert toxicity.classify(docs, labels.limit(0)).agg(F.sum("rejected")).first()[0] == 0
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    assert toxicity.classify(docs, labels, keep=docs.columns).columns == [*docs.columns, "p_low_quality", "p_toxic", "rejected"]


def test_fit_separates():
    x = toxicity.Sparse([[0], [0, 1], [1], []] * 10, np.zeros((40, 1)), 2)
    y = np.array([1, 1, 0, 0] * 10, float)
    w = toxicity.fit_logistic(x, y, np.ones(40))
    assert ((toxicity.sigmoid(x.times(w[:-1]) + w[-1]) > 0.5) == (y > 0)).all()
    assert w[0] == pytest.approx(max(w))


def plain_chain(texts, marks):
    """{key: probabilities of the marks in turn} of all texts, from whole matrices and plain counting; marks: {key: (mark, ...)} of some."""
    keys = sorted(k for k in marks if k in texts)
    words = {k: toxicity.WORD.findall((t or "").lower()) for k, t in texts.items()}
    held = {k: {f for w in set(ws) for f in toxicity.word_features(w)} for k, ws in words.items()}
    y = np.array([marks[k] for k in keys], float)
    with_f = {}
    for i, k in enumerate(keys):
        for f in held[k]:
            with_f.setdefault(f, []).append(i)
    chosen = {}
    for c in range(y.shape[1]):
        pos, neg, found = y[:, c].sum(), (1 - y[:, c]).sum(), []
        for f, rows in with_f.items():
            n, a = len(rows), y[rows, c].sum()
            if n >= toxicity.LEAST_TEXTS and pos and neg:
                det = a * (neg - (n - a)) - (n - a) * (pos - a)
                chi = det * det * (pos + neg) / (n * (pos + neg - n + 1e-9) * pos * neg)
                if chi > toxicity.LEAST_CHI:
                    found.append((-chi, f))
        for _, f in sorted(found)[: toxicity.FEATURES]:
            chosen.setdefault(f, len(chosen))

    def matrix(some):
        x = np.zeros((len(some), len(chosen) + len(toxicity.DENSE)))
        for i, k in enumerate(some):
            x[i, [chosen[f] for f in held[k] if f in chosen]] = 1
            x[i, len(chosen) :] = toxicity.dense(texts[k] or "", words[k])
        return x

    x, every = matrix(keys), matrix(list(texts))
    own = slice(len(chosen), None)
    center, scale = x[:, own].mean(0), (x[:, own].std(0) + 1e-9) / toxicity.FIGURES
    for m in (x, every):
        m[:, own] = (m[:, own] - center) / scale

    def fit(x, y, use):
        x1 = np.hstack((x, np.ones((len(x), 1))))
        w, m, v = np.zeros(x1.shape[1]), 0.0, 0.0
        weight = use * np.where(y > 0, ((use * (1 - y)).sum() / (use * y).sum()) ** toxicity.BALANCE, 1.0)
        weight /= weight.sum()
        for step in range(1, toxicity.STEPS + 1):
            g = x1.T @ ((1 / (1 + np.exp(-x1 @ w)) - y) * weight) + toxicity.RIDGE * np.append(w[:-1], 0)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        return lambda z: 1 / (1 + np.exp(-(z @ w[:-1] + w[-1])))

    fold, out = toxicity.folds_of(np.array(keys)), []
    for c in range(y.shape[1]):
        out.append(fit(x, y[:, c], np.ones(len(keys)))(every))
        away = np.zeros(len(keys))
        for f in range(toxicity.FOLDS):
            away[fold == f] = fit(x, y[:, c], (fold != f).astype(float))(x)[fold == f]
        x, every = np.column_stack((x, away)), np.column_stack((every, out[-1]))
    return dict(zip(texts, zip(*out, strict=True), strict=True))


def test_op9_equals_a_plain_chain(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    marks = {r.doc_id: (1 - r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    want = plain_chain(texts, marks)
    got = QUERIES["op9_toxicity_chain"](spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.p_low_quality, r.p_toxic) == pytest.approx(want[r.doc_id], abs=1e-4)
