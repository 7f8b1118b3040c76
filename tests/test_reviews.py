"""Reports, actions, badges, attention and exact searches against SQL and by hand."""

import json

from pyspark.sql import functions as F

from siltmark.functions import columns as C
from siltmark.operators import findings, review
from siltmark.sources import readers




def test_composite_rounds_the_true_sum(spark):
    terms = [F.lit(float(v)) * F.lit(w) for v, w in ((48, 0.3), (92, 0.15), (20, 0.2), (18, 0.15), (97, 0.12), (37, 0.08))]
    whole, plain = spark.range(1).select(findings.precise_sum(terms), sum(terms[1:], terms[0])).first()
    assert (whole, plain) == (49.49999999999999, 49.5) and round(whole) == 49


def test_rounding_by_the_binary_value(spark):
    xs = [0.575, 2.675, 1.005, 0.125, 0.375, 0.0625, 49.5, 0.285, 1e-9, 0.0, 0.9995, *[k / 1000 for k in range(5, 1000, 10)], *[k / 7 for k in range(50)]]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", C.rounded(F.col("x"), 2).alias("a"), C.rounded(F.col("x"), 3).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(round(x, 2), round(x, 3)) for x in xs]
    assert spark.range(1).select(C.rounded(F.lit(None), 2)).first()[0] is None


def test_flips_by_hand(spark):
    rows = [(1, "B", "critical", "fb", None, 1), (1, "A", "critical", "fa", None, 2), (1, "S", "high", "s1", -5, 3), (1, "S", "high", "s2", -9, 4), (1, "TEST-CI-001", "low", "ci", None, 5), (1, "H", "high", "h", 0, 6), (2, "H", "high", "h", None, 1), (2, "H", "high", "h", None, 2), (3, "H", "low", "l", None, 1)]
    f = spark.createDataFrame(rows, "r int, rule_id string, severity string, fix string, security_impact int, o int")
    s = spark.createDataFrame([(1, 60, 40), (2, 90, 90), (3, 0, 0), (4, 0, 0)], "r int, security int, testing int")
    got = {r.r: r.actions for r in review.flip_actions(f, s, ["r"], "o").collect()}
    assert got == {1: ["fa", "s2", "ci"], 2: ["h", "h"], 3: [], 4: []}


def test_report_as_json(spark):
    rows = spark.createDataFrame([(1, None, [("a", ["x"])])], "id int, url string, findings array<struct<id:string, evidence:array<string>>>")
    text = readers.report_json(rows, "id").first().json
    assert json.loads(text) == {"id": 1, "url": None, "findings": [{"id": "a", "evidence": ["x"]}]} and "\n  " in text
