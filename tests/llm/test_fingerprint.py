"""Sketches against plain sets of paragraphs."""

import hashlib
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siltmark.llm import fingerprint
from siltmark.llm.queries import QUERIES


def units(t):
    out = []
    for p in t.split("\n"):
        out += re.findall(r"(?s).{%d,}?[.!?](?=[ ])|.+" % fingerprint.PARAGRAPH, p)
    return {p.strip(" ") for p in out if p.strip(" ")}


def near(a, b):
    a, b = units(a), units(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for k, (key, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        out.append((key, len(t), hashlib.sha256(e.encode()).hexdigest(), near(t, e), near(t, nxt)))
    return out


def check(got, rows):
    want = brute(rows)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=order)
    for g, w in zip(got, sorted(want, key=order), strict=True):
        assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:])


def test_op6(spark, sf):
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    got = QUERIES["op6_document_fingerprints"](spark, sf).collect()
    check(got, [(d["doc_id"], d["text"]) for d in docs])
    by_text = {}
    for d in docs:
        by_text.setdefault(d["text"], set()).add(next(r.fingerprint for r in got if r.doc_id == d["doc_id"]))
    assert all(len(x) == 1 for x in by_text.values())


def test_no_python_in_the_plan(spark, sf):
    plan = QUERIES["op6_document_fingerprints"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_edges(spark):
    schema = "doc_id long, text string, row int, b int, edited string"
    rows = [(1, None), (2, ""), (3, "abc"), (3, "abc"), (3, "abd\nx"), (None, "n\nm"), (9, "\n".join(f"p{k}" for k in range(3000))), (10, "\n".join(f"p{k}" for k in range(5, 3000))), (11, "q. " * 900), (12, "é" * 40)]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], schema)
    check(fingerprint.compare_versions(df).collect(), rows)
    assert fingerprint.compare_versions(spark.createDataFrame([], schema)).count() == 0
    one = fingerprint.compare_versions(spark.createDataFrame([(5, "abcdefgh", 1, 2, "")], schema)).collect()
    assert [(r.near_next, r.n_chars) for r in one] == [(1.0, 8)]
    prints = fingerprint.with_fingerprint(df).select(F.countDistinct("fingerprint")).first()[0]
    assert prints == 8


def test_sketches_that_fail_are_doubled_until_they_peel(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BLOCK_CELLS", (3, 6))
    rows = [(k, "\n".join(f"p{(k * j) % 97}" for j in range(60))) for k in range(1, 6)]
    check(fingerprint.compare_versions(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)
