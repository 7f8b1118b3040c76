"""Stored scans, running sums and containment against SQL and plain versions."""

import random
import re
import uuid

from pyspark.sql import functions as F

from siltmark.operators import access, prefix, scans, search


def test_scan_is_rebuilt_without_an_exchange(spark):
    none = {k: spark.createDataFrame([], "result_id long") for k in scans.TABLES}
    files = spark.createDataFrame([(1, "b.py", "a,,b", 0.5), (1, "a.py", None, 1.0), (2, "c.py", "", 1.0)], "result_id long, path string, sensitive_operations string, confidence double")
    scores = spark.createDataFrame([(1, 70, "u")], "result_id long, composite_score int, repo_url string")
    dims = spark.createDataFrame([(1, "security", 60, "Fair", "x\n\ny")], "result_id long, dimension string, adjusted_score int, label string, deductions_text string")
    name = f"scan_{uuid.uuid4().hex}"
    scans.save(none | {"files": files, "scores": scores, "dimensions": dims}, name, 4)
    df = scans.load(spark, name)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 4
    one, two = df.orderBy("result_id").collect()
    assert [(f.path, f.sensitive_operations) for f in one.files] == [("a.py", []), ("b.py", ["a", "b"])] and one.edges == [] and one.repo_url == "u"
    assert one.metadata.parse_success_rate == 0.75 and one.metadata.files_skipped is None and one.metadata.languages_detected == {} and one.default_branch is None
    assert one.scorecard.dimensions[0].deductions_text == ["x", "y"] and one.scorecard.dimensions[0].explanation == "Fair (60/100)" and one.scorecard.dimensions[0].finding_ids == []
    assert two.scorecard is None and two.confidence is None and two.repo_url == ""


def test_running_sums_of_one_large_group(spark):
    rng = random.Random(1)
    rows = [("hot" if k % 2 else rng.choice("abc"), k, rng.randrange(9)) for k in range(4000)] + [(None, 5000, 1), (None, 5001, 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k int, v long").repartition(7)
    got = {r.k: r.before for r in prefix.before(df, ["g"], ["k"], F.col("v")).collect()}
    want, so_far = {}, {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        want[k] = so_far.get(g, 0)
        so_far[g] = want[k] + v
    assert got == want
    taken = access.within_budget(df, ["g"], ["k"], "v", 300).collect()
    plain, at = {}, {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        plain.setdefault((g, at.get(g, 0) // 30), []).append((k, v))
        at[g] = at.get(g, 0) + 1
    spent, keep = {}, set()
    for (g, b), held in sorted(plain.items(), key=lambda x: (str(x[0][0]), x[0][1])):
        if spent.get(g, 0) <= 300:
            keep |= {k for k, _ in held}
        spent[g] = spent.get(g, 0) + sum(v for _, v in held)
    assert {r.k for r in taken} == {k for k in keep if k < 5000}  # a null group is no repository


def test_first_files_of_each_repository(spark):
    rows = [(r, f"src/f{k:04}.py", "blob", 10 * k) for r, n in ((1, 1000), (2, 3)) for k in range(n)]
    got = access.first_to_scan(spark.createDataFrame(rows, "repo_id int, path string, kind string, size long"), 800, ["repo_id"]).collect()
    assert sorted((r.repo_id, r.path) for r in got) == sorted((r, p) for r, p, _, s in rows if s < 8000)


def test_untraced_equals_a_plain_check(spark):
    rng = random.Random(2)
    traces = ["".join(rng.choice("ab .") for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["The score is 70 overall because of tests, which are few.", None]
    texts = [". ".join("".join(rng.choice("ab ") for _ in range(rng.randint(1, 6))) for _ in range(4)) + "!" for _ in range(60)] + ["Score is 70 overall because of tests, WHICH ARE many. Nothing backs this?  b", None, "", "a", "z"]
    want = []
    for k, t in enumerate(texts):
        for s in [s.strip() for s in re.split(r"(?<=[.!?])\s+", t or "") if s.strip()]:
            if not any(s[:40].lower().strip() in x.lower() for x in traces if x is not None):
                want.append((k, s))
    claims = search.sentences(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t")
    got = search.untraced(claims, spark.createDataFrame([(x,) for x in traces], "trace string"), "sentence", "trace")
    assert sorted((r.id, r.sentence) for r in got.collect()) == sorted(want) and want
    assert search.untraced(claims, spark.createDataFrame([], "trace string"), "sentence", "trace").count() == claims.count()


def test_untraced_looks_few_fragments_up_by_all_their_strings(spark):
    claims = spark.createDataFrame([("A fragment that is long enough.",), ("long enough",), ("x",)], "sentence string")
    df = search.untraced(claims, spark.createDataFrame([("such a fragment that is long enough. so",)], "trace string"), "sentence", "trace")
    assert [r.sentence for r in df.collect()] == ["x"] and "LeftSemi" in df._jdf.queryExecution().optimizedPlan().toString()


def test_scans_are_saved_by_one_exchange_each(spark, sf):
    from siltmark.operators import scans
    from siltmark.plans import storage

    tables = storage._tables(spark, sf)
    assert all("Exchange" not in t._jdf.queryExecution().executedPlan().toString() for k, t in tables.items() if k in storage._SETS)
    scans.save({k: t.unionByName(t) for k, t in tables.items()}, "twice", distinct=storage._SETS)
    assert all(spark.table(f"twice_{k}").count() == t.distinct().count() for k, t in tables.items() if k in storage._SETS)


def test_result_reuse_has_no_distinct_over_all(spark, sf):
    from siltmark import catalog

    plan = catalog.QUERIES["result_reuse"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.lstrip().startswith("Aggregate")
