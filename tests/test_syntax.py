"""Syntax trees, YAML and the scout against SQL; large pools against a plain sort."""

import random

import pytest
from pyspark.sql import functions as F

from siltmark.functions import syntax
from siltmark.operators import ranking


def test_texts_without_structure(spark):
    df = spark.createDataFrame([(None,), ("",), ("\x00",), ("a: [",), ("services: 3",), ("jobs: []",)], "t string")
    got = df.select(syntax.workflow_commands("t").alias("w"), syntax.script_commands("t").alias("c"), syntax.compose_services("t").alias("s"), syntax.python_env_references("t").alias("p")).collect()
    assert all(tuple(r) == ([], [], [], []) for r in got)
    two = spark.createDataFrame([("a:\n  script: [pytest, 3]\nb:\n  script:\n    - x\nc: 1\n",)], "t string").select(syntax.script_commands("t").alias("c")).first()
    assert two.c == ["pytest", "x"]


def test_ranks_of_a_large_pool(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(60), k % 9 == 0) for k in range(3000)]
    df = spark.createDataFrame(rows, "id int, quality int, excluded boolean").repartition(6)
    flat = lambda d: d.withColumn("relevance", F.lit(50))
    got = {r.rank: r.id for r in ranking.score_pool(df, [("only", "x")], relevance=flat).collect()}
    score = lambda q, out: -1 if out else min(100, round(0.4 * q + 0.6 * 50))
    want = sorted(rows, key=lambda r: (-score(r[1], r[2]), r[0]))
    assert got == {k: r[0] for k, r in enumerate(want, 1)}


def test_yaml_is_read_once_and_deep_texts_do_no_harm(monkeypatch):
    import pandas as pd

    assert all(syntax._document(x * 50_000) is None for x in ("[", "- ", "{a: "))
    assert syntax._document("a:\n  - b: [1, {c: 2}]\n") == {"a": [{"b": [1, {"c": 2}]}]}
    read, plain = [], syntax._document
    monkeypatch.setattr(syntax, "_document", lambda x: read.append(x) or plain(x))
    assert syntax.workflow_commands.func(pd.Series(["jobs: {a: {steps: [{run: x}]}}"] * 3 + [None], dtype=object)).tolist() == [["x"]] * 3 + [[]] and len(read) == 2


def test_small_tables_are_dealt_to_all_tasks(spark, sf):
    """A table of one file is as many tasks as the session has partitions, before its rows' work is done."""
    from siltmark import catalog
    from siltmark.plans import facts, sources

    for df in (sources.python_files(spark, sf), sources.script_files(spark, sf), facts.facts(spark, sf), *(catalog.QUERIES[q](spark, sf) for q in ("python_parse", "script_parse", "confidence_badges", "model_findings"))):
        assert df.rdd.getNumPartitions() == 4
    plan = catalog.QUERIES["model_findings"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan[plan.index("Repartition") :]
