"""Toxicity by classifier chains.

Categories are predicted one after the other by logistic models over the words and word beginnings of a text; each
later model also sees the earlier categories' probabilities. For training these come from models that did not see the
text (out-of-fold predictions), so that the chain learns from probabilities like those it meets when it is applied.
Feature statistics are counted in Spark; the fit itself is over a bounded sample of labelled texts on the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _shared as S

#: Labelled texts to fit on at most (an expected number: a seeded hash of the key picks them).
TRAIN_ROWS = 12_000
#: Word features of a category's model, and texts a feature must occur in.
FEATURES, LEAST_TEXTS, LEAST_CHI = 1500, 3, 20
FOLDS, STEPS, RIDGE = 4, 120, 1e-4
#: Weight of the rarer class against the other: their ratio to this power.
BALANCE = 0.3
#: Weight of the standardised figures beside word features, which weigh 1.
FIGURES = 0.3
#: Words a worker keeps the features of.
KEPT_WORDS = 100_000
WORD = re.compile(r"[^\W\d_]+")
DENSE = ("words", "mean_length", "symbols", "digits", "distinct", "upper")


def word_features(word: str) -> list[str]:
    """A word and its beginnings, which inflected forms share."""
    out = [f"w:{word}"]
    for n in (3, 4, 5):
        if len(word) >= n:
            out.append(f"{n}:{word[:n]}")
    return out


def dense(text: str, words: list[str]) -> list[float]:
    n, k = max(1, len(text)), len(words)
    symbols = sum(text.count(c) for c in "&$#%*|<>{}[]@^~=+\\/_")
    digits = len(re.findall(r"[0-9]", text))
    upper = len(re.findall(r"[A-Z]", text))
    return [np.log1p(k), sum(map(len, words)) / max(1, k), symbols / n, digits / n, len(set(words)) / max(1, k), upper / n]


class _Count:
    """Texts with each feature, in all and by category, for a task."""

    def __init__(self, n: int):
        self.n = n

    def __call__(self, it):
        total, by = Counter(), [Counter() for _ in range(self.n)]
        for rb in it:
            for text, *marks in zip(rb.column("text").to_pylist(), *(rb.column(f"y{k}").to_pylist() for k in range(self.n)), strict=True):
                found = {f for w in set(WORD.findall((text or "").lower())) for f in word_features(w)}
                total.update(found)
                for c, y in zip(by, marks, strict=True):
                    if y:
                        c.update(found)
        names = list(total)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(names, pa.string()), "n": pa.array([total[f] for f in names], pa.int64()), **{f"n{k}": pa.array([c[f] for f in names], pa.int64()) for k, c in enumerate(by)}})


class Featurizer:
    """Texts to the numbers of the chosen features they hold (each once) and dense figures."""

    def __init__(self, chosen: dict[str, int]):
        self.chosen, self.kept = chosen, {}

    def __call__(self, text: str | None) -> tuple[list[int], list[float]]:
        text = text or ""
        words = WORD.findall(text.lower())
        if len(self.kept) > KEPT_WORDS:
            self.kept = {}
        found: set[int] = set()
        for w in set(words):
            f = self.kept.get(w)
            if f is None:
                f = self.kept[w] = tuple(self.chosen[x] for x in word_features(w) if x in self.chosen)
            found.update(f)
        return sorted(found), dense(text, words)


class _Features:
    def __init__(self, chosen: dict[str, int], n: int):
        self.chosen, self.n = chosen, n

    def __call__(self, it):
        make = Featurizer(self.chosen)
        for rb in it:
            rows = [make(x) for x in rb.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column("key"), *(rb.column(f"y{k}") for k in range(self.n)), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["key", *(f"y{k}" for k in range(self.n)), "found", "dense"])


class Sparse:
    """Rows of feature numbers of weight 1, with dense columns beside them."""

    def __init__(self, found: list[list[int]], dense_: np.ndarray, width: int):
        self.col = np.fromiter((c for f in found for c in f), np.int64)
        self.row = np.repeat(np.arange(len(found)), [len(f) for f in found])
        self.dense, self.width, self.n = dense_, width, len(found)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n) + self.dense @ w[self.width :]

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.concatenate((np.bincount(self.col, g[self.row], self.width), self.dense.T @ g))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: Sparse, y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Weights, the last one the bias's, by accelerated steps on the weighted log loss of the used rows with a ridge."""
    k = x.width + x.dense.shape[1]
    w, b, m, v = np.zeros(k), 0.0, np.zeros(k + 1), np.zeros(k + 1)
    pos, neg = (use * y).sum(), (use * (1 - y)).sum()
    weight = use * np.where(y > 0, (neg / pos) ** BALANCE if pos else 1.0, 1.0)
    weight = weight / max(1e-9, weight.sum())
    for step in range(1, STEPS + 1):
        g = (sigmoid(x.times(w) + b) - y) * weight
        grad = np.append(x.back(g) + RIDGE * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return np.append(w, b)


@dataclass
class Chain:
    """categories in order; a model has a weight for each chosen feature, dense figure and earlier category, and a bias."""

    categories: list[str]
    chosen: dict[str, int]
    center: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray] = field(default_factory=list)

    def scores(self, found: list[list[int]], dense_: np.ndarray) -> np.ndarray:
        """Probabilities, one column a category."""
        x = (dense_ - self.center) / self.scale
        out = np.zeros((len(found), 0))
        for w in self.weights:
            s = Sparse(found, np.concatenate((x, out), 1), len(self.chosen))
            out = np.column_stack((out, sigmoid(s.times(w[:-1]) + w[-1])))
        return out


def folds_of(keys: np.ndarray) -> np.ndarray:
    return (S.mix(keys.astype(np.int64).view(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, targets: dict[str, str], root: str, key: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS, seed: int = 3) -> Chain:
    """Fits a chain for targets {category: SQL of its 0/1 mark over labels}, in their order.

    Labelled rows whose marks or key are null are left out; several labels of a key count as their largest. Without
    labelled rows, or with one class only, a category's probability is the mean of its marks (0 without any).
    """
    names = list(targets)
    marks = labels.select(F.col(key).cast("long").alias("key"), *(F.expr(q).cast("int").alias(f"y{k}") for k, q in enumerate(targets.values()))).dropna()
    marks = marks.groupBy("key").agg(*(F.max(f"y{k}").alias(f"y{k}") for k in range(len(names))))
    share = min(1.0, train_rows / max(1, marks.count()))
    picked = marks.filter(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)))
    # bounded by train_rows, so it may be sent to all
    sample = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(picked), "key")
    sample = S.materialised(sample, f"{root}/sample")
    ys = ", ".join(f"n{k} long" for k in range(len(names)))
    counts = sample.mapInArrow(_Count(len(names)), f"feature string, n long, {ys}").groupBy("feature").agg(F.sum("n").alias("n"), *(F.sum(f"n{k}").alias(f"n{k}") for k in range(len(names)))).filter(F.col("n") >= LEAST_TEXTS)
    counts = S.materialised(counts, f"{root}/counts")
    size = sample.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(f"y{k}"), F.lit(0)).alias(f"n{k}") for k in range(len(names)))).first()
    chosen: dict[str, int] = {}
    for k in range(len(names)):
        # the strongest features by chi-square of presence against the mark
        pos, neg = float(size[f"n{k}"]), float(size.n - size[f"n{k}"])
        if pos and neg:
            a, n = F.col(f"n{k}"), F.col("n")
            det = a * (F.lit(neg) - (n - a)) - (n - a) * (F.lit(pos) - a)
            chi = det * det * (pos + neg) / (n * (F.lit(pos + neg) - n + 1e-9) * pos * neg)
            for r in counts.select("feature", chi.alias("chi")).filter(f"chi > {LEAST_CHI}").orderBy(F.desc("chi"), "feature").limit(FEATURES).collect():
                chosen.setdefault(r.feature, len(chosen))
    rows = sample.mapInArrow(_Features(chosen, len(names)), "key long, " + ", ".join(f"y{k} int" for k in range(len(names))) + ", found array<int>, dense array<double>").orderBy("key").toArrow()
    found = rows.column("found").to_pylist()
    figures = np.array(rows.column("dense").to_pylist(), float).reshape(len(found), len(DENSE))
    y = np.array([rows.column(f"y{k}").to_pylist() for k in range(len(names))], float).reshape(len(names), -1)
    fold = folds_of(np.array(rows.column("key").to_pylist(), np.int64))
    center, scale = (figures.mean(0), (figures.std(0) + 1e-9) / FIGURES) if len(found) else (np.zeros(len(DENSE)), np.ones(len(DENSE)))
    chain = Chain(names, chosen, center, scale)
    x, out = (figures - center) / scale, np.zeros((len(found), 0))
    for k in range(len(names)):
        s = Sparse(found, np.concatenate((x, out), 1), len(chosen))
        if len(found) and 0 < y[k].sum() < len(found):
            chain.weights.append(fit_logistic(s, y[k], np.ones(len(found))))
            # what the next model learns from, if there is one: each fold as the others predict it
            away = np.zeros(len(found))
            for f in range(FOLDS if k + 1 < len(names) else 0):
                w = fit_logistic(s, y[k], (fold != f).astype(float))
                away[fold == f] = sigmoid(s.times(w[:-1]) + w[-1])[fold == f]
        else:
            p = y[k].mean() if len(found) else 0.0
            chain.weights.append(np.append(np.zeros(len(chosen) + s.dense.shape[1]), np.log((p + 1e-12) / (1 - p + 1e-12))))
            away = np.full(len(found), p)
        out = np.column_stack((out, away))
    S.remove(f"{root}/sample")
    return chain


class _Score:
    def __init__(self, chain: Chain, column: str, columns: list[str], made: str):
        self.chain, self.column, self.columns, self.made = chain, column, columns, made

    def __call__(self, it):
        make = Featurizer(self.chain.chosen)
        for rb in it:
            for a in range(0, rb.num_rows, 500):
                part = rb.slice(a, 500)
                rows = [make(x) for x in part.column(self.column).to_pylist()]
                p = self.chain.scores([r[0] for r in rows], np.array([r[1] for r in rows], float).reshape(len(rows), -1))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in self.columns), pa.array(list(p), pa.list_(pa.float64()))], names=[*self.columns, self.made])


def score(docs: DataFrame, chain: Chain, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs (all, if not given) with p_<category> of each category. A null text is empty."""
    keep = docs.columns if keep is None else keep
    need = list(dict.fromkeys([*keep, text]))
    kinds = dict(docs.dtypes)
    made = "_p"
    while made in keep:
        made += "_"
    out = docs.select(*need).mapInArrow(_Score(chain, text, keep, made), ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"{made} array<double>"]))
    return out.select(*keep, *(F.col(made)[k].alias(f"p_{c}") for k, c in enumerate(chain.categories)))


#: The categories that the labels have, in the chain's order: what makes a text unusable, then whether it is toxic.
TARGETS = {"low_quality": "1 - quality", "toxic": "toxic"}


def classify(docs: DataFrame, labels: DataFrame, targets: dict[str, str] | None = None, reject: str = "toxic", threshold: float = 0.5, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Trains a chain and returns (key or keep, p_<category> ..., rejected: 0 or 1), one row a document.

    Null texts are empty and null keys are scored like others; repeated rows get equal scores; an empty table gives none.
    """
    root = S.shared_root(docs.sparkSession)
    chain = train(docs, labels, targets or TARGETS, root, key, text)
    return score(docs, chain, text, keep or [key]).withColumn("rejected", (F.col(f"p_{reject}") >= threshold).cast("int"))
