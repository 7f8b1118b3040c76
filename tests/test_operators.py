"""Operators that have no query: readers, sinks, streams, state, and edge cases."""

import pytest
from pyspark.sql import functions as F

from siltmark.functions import columns as C, parse
from siltmark.operators import access, findings, graph, ops, ranking, review, search
from siltmark.sources import readers
from siltmark.streaming import metrics


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_empty_and_null_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "\n"), (4, "a\n\n# c\n    b")], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in df.select("doc_id", parse.loc(F.col("text")), parse.nesting(F.col("text")), F.size(C.lines(F.col("text")))).collect()}
    assert got == {1: (0, 0, 0), 2: (0, 0, 0), 3: (0, 0, 1), 4: (2, 1, 4)}
    assert findings.line_findings(df).count() == 0


def test_short_numbers_round_as_floats_do(spark):
    numbers = [*range(950, 12_000, 10), 999_950, 1_024_050, 1_500_250, 123_456_750]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", C.short_number(F.col("n")).alias("s")).collect()
    assert [r.s for r in got] == [f"{r.n / 1000:.1f}k" if r.n >= 1000 else str(r.n) for r in got]


def test_accessors(spark):
    files = spark.createDataFrame([(1, "a/main.py", "entrypoint", True, ["eval_exec"]), (1, "b.py", "module", False, [])], "repo_id int, path string, role string, is_entrypoint boolean, sensitive_ops array<string>")
    contexts = spark.createDataFrame([(1, "b.py", True), (1, "a/main.py", False)], "repo_id int, path string, is_on_critical_path boolean")
    paths = lambda df: [r.path for r in df.collect()]
    assert paths(access.by_role(files, "module")) == ["b.py"] and paths(access.entrypoints(files)) == ["a/main.py"] and paths(access.high_risk(files)) == ["a/main.py"]
    assert paths(access.critical(files, contexts, ["repo_id", "path"])) == ["b.py"]
    assert access.unsuppressed(spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, is_suppressed boolean")).count() == 2
    tree = spark.createDataFrame([("x/util.py", "blob", 10), ("main.py", "blob", 99_000), ("d", "tree", None), ("node_modules/a.js", "blob", 1)], "path string, kind string, size long")
    assert paths(access.first_to_scan(tree, 2)) == ["main.py", "x/util.py"]


def test_role_order(spark):
    for path, role in {"tests/config.py": "test", "k8s/main.py": "infra", "a/b/user_model.py": "schema", "x/routes/a.py": "service", "lib/z.rs": "utility", "LICENSE": "unknown"}.items():
        assert one(spark, C.role(F.lit(path))) == role
    assert one(spark, C.role(F.lit("application.py"), F.array(F.lit("flask")))) == "entrypoint"
    assert one(spark, C.is_generated(F.lit("a/x_pb2.py"))) and one(spark, C.is_generated(F.lit("gen/a.py"))) and not one(spark, C.is_generated(F.lit("a/gen.py")))


def test_penalties_stop_at_zero_step_by_step(spark):
    q = lambda stars, flags: one(spark, ranking.quality(F.lit(stars), F.lit(0), F.lit(None).cast("string"), F.lit(False), F.lit(""), F.lit(0), F.lit(0), F.lit(0), F.array(*map(F.lit, flags))))
    assert q(10, ["fork", "no description"]) == 0 and q(6000, ["fork"]) == 9 and q(6000, []) == 24


def test_penalty_decay_of_one_hot_rule(spark):
    rows = spark.range(50_000).select(F.lit(1).alias("repo"), F.lit("security").alias("domain"), F.lit("R").alias("rule_id"), F.lit("low").alias("severity"), F.lit(-1).alias("impact"))
    assert review.domain_penalties(rows, ["repo"]).first().penalty == 20.0
    three = review.domain_penalties(rows.limit(3), ["repo"]).first().penalty
    assert three == pytest.approx(0.4 * 1.75)
    assert review.domain_penalties(rows.limit(0), ["repo"]).count() == 0


def test_resolution_is_stable_and_ignores_row_order(spark):
    files = [(1, p, "python") for p in ("a/util.py", "b/util.py", "c/__init__.py", "c/d.py")]
    index = graph.module_keys(spark.createDataFrame(files, "repo_id int, path string, language string"))
    again = graph.module_keys(spark.createDataFrame(files[::-1], "repo_id int, path string, language string").repartition(3))
    assert sorted(map(tuple, index.collect())) == sorted(map(tuple, again.collect()))
    assert {r.key: r.path for r in index.collect()}["util"] == "a/util.py"


def test_chunks_and_scores(spark):
    d = spark.createDataFrame([(1, "a b c a"), (2, "b b"), (3, None)], "id long, text string")
    assert [r.id for r in search.contains(d, "text", "C A").collect()] == [1]


def test_checkout_and_sinks(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "pkg").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "pkg" / "a.py").write_text("x = 1\n")
    (root / "node_modules" / "b.js").write_text("1")
    got = readers.checkout(spark, str(root)).collect()
    assert [(r.path, r.content, r.lines) for r in got] == [("pkg/a.py", "x = 1\n", 1)]
    df = spark.createDataFrame([(7, "a"), (8, "b")], "result_id int, path string")
    readers.save({"files": df}, str(tmp_path / "store"), "result_id")
    assert [r.path for r in readers.load(spark, str(tmp_path / "store"), "files", "result_id", 8).collect()] == ["b"]
    secret = F.lit("0123456789abcdef")
    text = spark.createDataFrame([(1, "x")], "a int, b string").select(readers.decrypted(readers.encrypted(F.struct("a", "b"), secret), secret).alias("t")).first().t
    assert text == '{"a":1,"b":"x"}'
    assert one(spark, readers.decoded(F.lit("aGVs\nbG8="))) == "hello"


def test_fetch_errors_and_validity(spark):
    tree = spark.createDataFrame([("a",), ("b",)], "path string")
    got = readers.with_fetch_errors(tree, spark.createDataFrame([("a", "x")], "path string, content string"), ["path"]).orderBy("path").collect()
    assert [(r.fetch_error, r.confidence) for r in got] == [(False, 1.0), (True, 0.0)]
    rows = spark.createDataFrame([("s", 1, 2, -1), (" ", 1, 1, -1), ("s", 3, 2, -1), ("s", 1, 1, 5), (None, 1, 1, -1)], "snippet string, line int, line_end int, points int")
    good, bad = findings.valid_findings(rows)
    assert (good.count(), bad.count()) == (1, 4)


def run_stream(spark, df, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql(f"select * from {name}")


def test_streams_equal_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "src")
    events.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = run_stream(spark, metrics.latest_by_key(stream, "user_id"), tmp_path, "latest", "complete")
    want = ops.latest(events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", "event_id").select("user_id", "ts", "event_type")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    got = run_stream(spark, metrics.usage_by_window(stream, "1 day", "400 days"), tmp_path, "usage", "update")
    total = got.groupBy("start", "event_type").agg(F.max("calls").alias("calls"))
    want = events.groupBy(F.window("ts", "1 day")["start"].alias("start"), "event_type").count()
    assert sorted(map(tuple, total.collect())) == sorted(map(tuple, want.collect()))


def test_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).parent.parent
    for name in ("siltmark", "__spark_entry__.py"):
        (shutil.copytree if (here / name).is_dir() else shutil.copy)(here / name, tmp_path / name)
    shutil.rmtree(tmp_path / "siltmark" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert said.stdout.split()[1:] == ["False", "False"], said.stderr


def test_usage_is_appended_and_failures_swallowed(spark, sf, tmp_path):
    from siltmark.sources import sinks

    calls = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "stage string, tokens int")
    path = str(tmp_path / "usage")
    assert sinks.append_usage(calls, path) and sinks.append_usage(calls.limit(1), path)
    assert spark.read.parquet(path).count() == 4
    (tmp_path / "file").write_text("x")
    assert not sinks.append_usage(calls, str(tmp_path / "file" / "below"))
    calls.write.parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "src"))
    sinks.stream_usage(stream, path, str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(path).count() == 7


def test_job_layout_prunes(spark, tmp_path):
    from siltmark.sources import sinks

    jobs = spark.range(500).selectExpr("id", "if(id % 3 = 0, 'queued', 'running') status", "timestamp_seconds(id * 977 % 500) created_at")
    sinks.write_jobs(jobs, str(tmp_path / "jobs"))
    got = spark.read.parquet(str(tmp_path / "jobs")).filter("status = 'queued' and created_at > timestamp_seconds(100)")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(status" in plan and "GreaterThan(created_at" in plan
    assert got.count() == jobs.filter("status = 'queued' and created_at > timestamp_seconds(100)").count()
    assert ops.claim(spark.read.parquet(str(tmp_path / "jobs")), 4).count() == 4


def test_stale_jobs_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "started", 5), (2, "started", 10), (2, "ended", 20), (3, "started", 900)], "id long, status string, t long").selectExpr("id", "status", "timestamp_seconds(t) ts")
    rows.filter("t < 100").coalesce(1).write.parquet(str(tmp_path / "src"))
    rows.filter("t >= 100").coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    spark.createDataFrame([(4, "ended", 2000)], "id long, status string, t long").selectExpr("id", "status", "timestamp_seconds(t) ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema(rows.drop("t").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
    got = run_stream(spark, metrics.stale_jobs(stream, 600), tmp_path, "stale", "append")
    assert sorted((r.id, r.failed_at) for r in got.collect()) == [(1, 605), (3, 1500)]


def test_devcontainer_json(spark):
    import json

    from siltmark.sources import sinks

    rows = spark.createDataFrame([(1, ["python"], ["Django", "flask"], ["Postgres"], [])], "id int, languages array<string>, frameworks array<string>, services array<string>, custom array<string>")
    got = json.loads(sinks.devcontainer(rows, "id").first().json)
    assert got["name"] == "dev-python" and len(got["features"]) == 3 and got["services"] == {"postgres": {"image": "postgres:15", "ports": {"5432": 5432}}}
    assert got["customizations"]["vscode"]["settings"]["[python]"] == {"editor.defaultFormatter": "ms-python.python"} and got["postCreateCommand"].startswith("python -m pip")


def test_shares_round_as_floats_do(spark):
    from siltmark.functions import columns as C

    values = [0.1625, 0.0625, 0.125, 0.375, 0.0005, 0.9995, 1.0, 0.0, 0.2345, 0.005] + [k / 2000 for k in range(2001)] + [k / 97 for k in range(98)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", C.share_text(F.col("x"), 3).alias("a"), C.share_text(F.col("x"), 2).alias("b")).collect()
    assert [r for r in got if (r.a, r.b) != (f"{r.x:.3f}", f"{r.x:.2f}")] == []
