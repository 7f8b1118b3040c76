"""Rules and scores over facts of repositories, one a part: the numbers that make a repository's facts are one SQL text that both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed
from ..catalog import query, spread, table
from ..functions import columns as C
from ..operators import findings, ranking, repos, rules
from ..sources import readers
from .syntax import _stated, _variant

#: Numbers of a repository's facts, from the part's number k and size z.
NUMBERS = """SELECT p_partkey AS id, p_partkey * 5 % 29 AS sources, floor(p_partkey / 2) % 4 AS tests, p_partkey % 3 AS routers, floor(p_partkey / 3) % 9 AS total, p_partkey % 5 AS lang, p_partkey * 3 % 4 AS fw, p_partkey * 11 % 8 AS special,
  p_partkey * 37 % 701 AS main_lines, p_partkey * 53 % 301 AS route_lines, p_partkey * 19 % 30 AS test_lines, p_partkey * 7 % 6 AS dirs, p_partkey % 2 AS manifest, p_partkey * 13 % 5 AS docker,
  p_partkey * 17 % 4 AS heavy_entry, p_partkey * 29 % 3 AS heavy_other, p_partkey * 7 % 120 AS ruff, p_partkey * 31 % 9 AS ann, p_partkey * 23 % 5 AS light, p_size % 3 AS secrets, {flags} FROM part"""
_FLAGS = {name: (a, m) for name, a, m in zip(rules.FLAGS, (1, 2, 3, 5, 7, 4, 11, 6, 13, 9, 17, 8), (3, 2, 2, 2, 2, 3, 2, 2, 2, 2, 2, 3), strict=True)}
_BASE = NUMBERS.replace("{flags}", ", ".join(f"floor(p_partkey / {a}) % {m} = 0 AS has_{name}" for name, (a, m) in _FLAGS.items()))
_SPECIAL = ("x.py", "health.py", ".env.local", "app_logger.py", "Dockerfile", "status.ts", "readiness.go", "os.getenv.md")

_N = lambda *flags: "(" + " + ".join(f"has_{f}::INT" for f in flags) + ")"
_WEB, _PY = "fw IN (1, 2)", "lang IN (0, 1)"
_RATIO = "(tests / greatest(sources, 1))"
#: (rule, severity, what it needs) by the rules as they are listed; severities and conditions in DuckDB's SQL.
RULES = (
    ("HYGIENE-README-001", "'medium'", "NOT has_readme"), ("HYGIENE-LICENSE-001", "'medium'", "NOT has_license"), ("HYGIENE-CI-001", "'high'", "NOT has_ci"), ("TESTING-001", "'high'", "NOT has_tests"),
    ("DEPS-LOCKFILE-001", "'high'", "manifest = 1 AND NOT has_lockfile"), ("OPS-ENV-001", "'medium'", "special IN (2, 7) AND NOT has_env_example"), ("HYGIENE-LARGE-FILES-001", "'medium'", "main_lines >= 600"),
    ("DX-FORMAT-001", "'low'", "NOT has_formatter"), ("DX-LINT-001", "'medium'", "NOT has_linter"), ("TEST-CI-001", "'high'", "has_tests AND NOT has_ci"),
    ("OPS-HEALTH-001", "'medium'", f"{_WEB} AND special NOT IN (1, 5, 6) AND (routers > 0 OR sources >= 5)"), ("TESTING-RATIO-001", "'medium'", f"has_tests AND sources >= 5 AND tests > 0 AND {_RATIO} < 0.12"),
    ("TESTING-CI-DEPTH-001", "'medium'", "has_tests AND has_ci AND NOT has_github_actions"), ("PY-TYPING-001", "'medium'", f"{_PY} AND NOT has_type_checker"), ("PY-TEST-001", "'high'", f"{_PY} AND NOT has_pytest_config AND NOT has_tests"),
    ("PY-TYPECFG-001", "'medium'", f"{_PY} AND sources >= 8 AND NOT has_type_checker"), ("ARCH-BOUNDARY-001", "'medium'", f"{_PY} AND route_lines > 100 AND routers = 0"), ("ARCH-SERVICE-001", "'medium'", "lang IN (0, 1, 2) AND fw > 0 AND main_lines >= 300 AND dirs > 0"),
    ("GAMING-FACADE-001", "'medium'", f"total >= 5 AND has_readme AND has_license AND {_N('tests', 'ci', 'type_checker', 'linter')} < 2"),
    ("GAMING-TESTS-001", "'medium'", f"has_tests AND sources >= 4 AND tests >= 1 AND {_RATIO} < 0.08 AND ({_RATIO} < 0.05 OR (test_lines < 15)::INT / greatest(tests, 1) >= 0.5)"),
    ("GAMING-README-001", "'low'", f"has_readme AND total >= 5 AND {_N('tests', 'ci', 'linter', 'type_checker', 'env_example')} < 2 AND 3 - {_N('tests', 'ci', 'linter')} >= 2"),
    ("FASTAPI-ARCH-001", "'high'", "fw = 1 AND main_lines >= 250 AND routers < 3"), ("DOCKER-SEC-001", "'medium'", "docker IN (2, 3, 4)"), ("SEC-DENSITY-001", "'high'", "heavy_entry + heavy_other + secrets >= 3 AND heavy_entry >= 2"),
    ("PY-LINT-DENSITY-001", "CASE WHEN ruff >= 100 THEN 'high' WHEN ruff >= 40 THEN 'medium' ELSE 'low' END", "ruff >= 15"), ("SEC-BANDIT-GROUPED-001", "'medium'", "light >= 3"), ("PY-TYPING-SIGNAL-001", "'medium'", "NOT has_type_checker AND least(ann, ruff) >= 5"),
    ("OPS-LOGGING-001", "'low'", f"{_PY} AND {_WEB} AND NOT has_logging_dependency AND special <> 3"), ("OPS-DEPLOY-001", "'low'", f"{_WEB} AND sources >= 5 AND special <> 4"),
)


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts as the rules take them."""
    spread(table(spark, sf, "part").select("p_partkey", "p_size")).createOrReplaceTempView("_fact_parts")
    n = spark.sql(_BASE.replace("FROM part", "FROM _fact_parts"))
    c, none = F.col, F.array().cast("array<string>")
    pick = lambda xs, i: F.element_at(F.array(*(F.array(*(F.lit(v) for v in x)) if x else none for x in xs)), (i + 1).cast("int"))
    issue = lambda tool, severity, code, file, times: F.array_repeat(F.struct(F.lit(tool).alias("tool"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(file).alias("file")), times.cast("int"))
    lines = lambda path, n: F.struct(F.lit(path).alias("path"), n.alias("lines"))
    files = F.array(F.lit("src/a.py"), F.concat(F.lit("d/"), F.element_at(C.strings(_SPECIAL), (c("special") + 1).cast("int"))))
    docker = F.element_at(F.array(F.lit(None).cast("string"), F.lit("FROM x\nUSER app"), F.lit("FROM x\nUSER root"), F.lit("FROM x"), F.lit("USER app\nUSER root")), (c("docker") + 1).cast("int"))
    marked = F.least(c("ann"), c("ruff"))
    return n.select(
        "*", pick((("Python",), ("Python", "Docker"), ("TypeScript",), ("Go",), ()), c("lang")).alias("languages"), pick(((), ("FastAPI",), ("Express",), ("Celery",)), c("fw")).alias("frameworks"),
        F.when(c("manifest") == 1, F.array(F.lit("requirements.txt"))).otherwise(none).alias("manifests"), files.alias("files"), F.when(c("dirs") == 0, F.array(F.lit("Services"))).otherwise(F.array(F.lit("lib"))).alias("directories"),
        F.array(lines("src/main.py", c("main_lines")), lines("src/api_routes.py", c("route_lines")), lines("tests/test_x.py", c("test_lines"))).alias("file_lines"), docker.alias("docker_user"),
        F.concat(issue("bandit", "high", "B1", "src/main.py", c("heavy_entry")), issue("semgrep", "critical", "x", "src/a.py", c("heavy_other")), issue("ruff", "low", "ANN201", "a.py", marked), issue("ruff", "low", "E501", "a.py", c("ruff") - marked), issue("bandit", "low", "B2", "a.py", c("light")), issue("gitleaks", "critical", "key", "a.env", c("secrets"))).alias("issues"),
    )


@query(
    f"WITH n AS ({_BASE}), f AS ("
    + " UNION ALL ".join(f"SELECT id, '{rule}' AS rule_id, {severity} AS severity, 1 AS times FROM n WHERE {needs}" for rule, severity, needs in RULES)
    + " UNION ALL SELECT id, 'SEC-BANDIT-GROUPED-001', 'high', heavy_entry FROM n UNION ALL SELECT id, 'SEC-SECRETS-001', 'critical', secrets FROM n) SELECT id, rule_id, severity, sum(times)::BIGINT AS n FROM f WHERE times > 0 GROUP BY id, rule_id, severity"
)
def rule_findings(spark, sf):
    """Findings of every rule over repositories' facts, also of the one that is not registered (2.8)."""
    found = rules.review(facts(spark, sf), "id", extra=rules.UNREGISTERED)
    return found.groupBy("id", "rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


_LEVEL = lambda s, a, b: f"CASE WHEN {s} >= {a} THEN 'high' WHEN {s} >= {b} THEN 'medium' ELSE 'low' END"


@query(
    f"""WITH n AS ({_BASE}), s AS (SELECT id, least(100, CASE WHEN heavy_entry > 0 AND NOT has_env_example THEN 65 ELSE 0 END + CASE WHEN routers = 0 THEN 20 ELSE 0 END + CASE WHEN docker = 0 THEN 15 ELSE 0 END) AS setup,
  least(100, CASE WHEN has_logging_dependency THEN 0 ELSE 30 END + CASE WHEN has_tests THEN 0 ELSE 30 END + CASE WHEN has_linter THEN 0 ELSE 20 END + CASE WHEN has_ci THEN 0 ELSE 15 END + CASE WHEN has_readme THEN 0 ELSE 5 END) AS debug,
  least(100, CASE WHEN NOT has_ci THEN 35 WHEN NOT has_github_actions THEN 20 ELSE 0 END + CASE WHEN has_tests THEN 0 ELSE 25 END + CASE WHEN dirs = 0 THEN 15 ELSE 0 END + least(special * 5, 20)) AS change FROM n)
SELECT id, 'setup' AS section, setup::INT AS score, {_LEVEL("setup", 60, 30)} AS level FROM s UNION ALL SELECT id, 'debug', debug::INT, {_LEVEL("debug", 55, 25)} FROM s UNION ALL SELECT id, 'change', change::INT, {_LEVEL("change", 55, 25)} FROM s"""
)
def risk_sections(spark, sf):
    """Scores of the three risk sections (S-A28 to S-A30)."""
    n, c = facts(spark, sf), F.col
    each = (
        ("setup", repos.setup_risk(c("heavy_entry"), c("has_env_example"), c("routers"), c("docker"), c("light"))),
        ("debug", repos.debug_readiness(c("has_logging_dependency"), c("has_tests"), c("has_linter"), c("has_ci"), c("has_readme"), F.lit(0))),
        ("change", repos.change_risk(c("has_ci"), c("has_github_actions"), c("has_tests"), c("dirs") == 0, c("special"), F.lit(3), F.lit(1))),
    )
    rows = n.select("id", F.explode(F.array(*(F.struct(F.lit(name).alias("section"), r["score"].cast("int").alias("score"), r["level"].alias("level")) for name, r in each))).alias("r"))
    return rows.select("id", "r.*")


#: Paths, with the role, language and whether they are skipped.
PATHS = (
    ("shop/main~.py", ("module:python:false",)), ("a~/main.py", ("entrypoint:python:false",)), ("settings.py", ("config:python:false",)), ("x~/api/__init__.py", ("service:python:false",)), ("shop/models~/order.py", ("module:python:false",)), ("web~/app/page.tsx", ("entrypoint:typescript:false",)),
    ("src/cart~/list.ts", ("module:typescript:false",)), ("tests/test_~.py", ("test:python:false",)), ("package.json", ("config:json:false",)), ("requirements~.txt", ("unknown:unknown:false",)), (".github/workflows/ci~.yml", ("infra:yaml:false",)), ("node_modules/x~/index.js", ("entrypoint:javascript:true",)),
    ("README~.md", ("unknown:markdown:false",)), ("alembic/v~.py", ("migration:python:false",)), ("lib/user_model~.go", ("schema:go:false",)), ("k~/utils/z.rs", ("utility:rust:false",)),
)


@query(f"SELECT id, unnest({_stated(PATHS, 'id', 'id')}) AS said FROM (SELECT p_partkey AS id FROM part)")
def file_roles(spark, sf):
    """Role, language and skip flag by path."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id")).withColumn("path", _variant(PATHS, "id", "id"))
    p = F.col("path")
    return rows.select("id", F.concat_ws(":", C.role(p), C.language(p, F.lit("")), C.should_skip(p).cast("string")).alias("said"))


MANIFESTS = (
    ('package.json', '{"dependencies": {"react~": "1", "next": "2"}, "devDependencies": {"vitest": "1", "react~": "1"}}', "next,react~,vitest"), ("requirements.txt", "# web\nFastAPI==0.1\nsqlalchemy~>=2\n-r other.txt\npsycopg2 ~= 2.9\nplain\n".replace("psycopg2 ~=", "psycopg2 @="), "fastapi,plain,psycopg2 @= 2.9,sqlalchemy~"),
    ("pyproject.toml", '[project]\nname = "shop"\ndependencies = ["httpx~>=1", "uvicorn[standard]"]\n[tool.poetry.dependencies]\npython = "^3"\nRedis = "1"\n', "httpx~,redis,uvicorn"), ("pyproject.toml", "not [ toml", ""), ("package.json", "{broken", ""),
)
_MANIFEST_ROWS = tuple((text, (said,)) for _, text, said in MANIFESTS)


@query(f"SELECT id, lower(unnest({_stated(_MANIFEST_ROWS, 'id', 'id')})) AS deps FROM (SELECT p_partkey AS id FROM part)")
def manifest_dependencies(spark, sf):
    """Dependencies of three kinds of manifests, malformed ones too."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id")).withColumn("content", _variant(_MANIFEST_ROWS, "id", "id"))
    p, t = F.element_at(C.strings(tuple(m[0] for m in MANIFESTS)), (F.col("id") % len(MANIFESTS) + 1).cast("int")), F.col("content")
    deps = F.when(p == "package.json", repos.package_json_dependencies(t)).when(p == "requirements.txt", repos.requirements(t)).otherwise(repos.pyproject_dependencies(t))
    return rows.select("id", F.lower(F.array_join(F.array_sort(F.coalesce(deps, F.array().cast("array<string>"))), ",")).alias("deps"))


@query(
    """WITH b AS (SELECT o_orderkey AS id, o_orderkey % 101 AS security, o_custkey % 101 AS composite, o_orderkey % 17 AS n FROM orders), a AS (SELECT o_orderkey AS id, o_orderkey * 3 % 101 AS security, o_custkey * 7 % 101 AS composite, o_orderkey * 5 % 17 AS n FROM orders WHERE o_orderkey % 4 > 0)
SELECT a.id, (a.security - b.security)::BIGINT AS security_delta, (a.composite - b.composite)::BIGINT AS composite_delta, greatest(0, b.n - a.n)::BIGINT AS n_findings_resolved FROM a JOIN b ON a.id = b.id"""
)
def score_comparison(spark, sf):
    """Deltas of two scorecards (S-A10)."""
    o, c, k = table(spark, sf, "orders"), F.col("o_custkey"), F.col("o_orderkey")
    card = lambda s, t, n: o.select(k.alias("id"), (k * s % 101).alias("security"), *(F.lit(0).alias(d) for d in fixed.DIMENSION_WEIGHTS if d != "security"), (c * t % 101).alias("composite"), (k * n % 17).alias("n_findings"), F.lit(0).alias("n_critical"), F.lit(0).alias("n_high"))
    return findings.compare_scores(card(1, 1, 1), card(3, 7, 5).filter("id % 4 > 0"), "id").select("id", "security_delta", "composite_delta", "n_findings_resolved")


@query(
    """WITH b AS (SELECT c_custkey AS q, c_custkey % 11 / 10 AS v FROM customer), a AS (SELECT c_custkey AS q, c_custkey * 3 % 11 / 10 AS v FROM customer)
SELECT (SELECT avg(v) FROM a) >= (SELECT avg(v) FROM b) - 0.001 AS mean_held, (SELECT count(*) FROM a JOIN b ON a.q = b.q WHERE a.q % 3 = 0 AND a.v - b.v < -0.15) = 0 AS critical_held,
  (SELECT count(*) FROM customer WHERE c_custkey % 10 = 0 AND c_custkey % 20 > 0) = 0 AS noise_held"""
)
def ranking_gate(spark, sf):
    """Regression gate of two runs."""
    k = F.col("c_custkey")
    run = lambda m: table(spark, sf, "customer").select(k.alias("query"), (k * m % 11 / 10).alias("ndcg"), F.lit(0.0).alias("precision"))
    names = lambda test: table(spark, sf, "customer").filter(test).select(k.alias("query"))
    return ranking.gate(run(1), run(3), "query", names("c_custkey % 3 = 0"), names("c_custkey % 20 = 0"), names("c_custkey % 10 = 0"))


ROUTED = (
    ('from fastapi import FastAPI\n@router.post("/orders/{order_id}/lines~")\ndef add(): pass\n@router.get("/orders/{order_id}/lines~")\n', ("2 POST /orders/{order_id}/lines~ 1", "4 GET /orders/{order_id}/lines~ 1")),
    ('\n\n@app.get("/health~")\n@app.get("/health~")\n', ("3 GET /health~ 0",)), ("no routes ~", ()),
)


@query(f"SELECT id, unnest({_stated(ROUTED, 'id', 'id')}) AS route FROM (SELECT p_partkey AS id FROM part)")
def route_table(spark, sf):
    """Routes of a framework's sources, each once in a file."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id")).withColumn("content", _variant(ROUTED, "id", "id"))
    found = repos.routes(rows.withColumn("path", F.concat(F.lit("f"), F.col("id").cast("string"))), "fastapi")
    return found.select(F.substr("file", F.lit(2)).cast("long").alias("id"), F.concat_ws(" ", F.col("line").cast("string"), "method", "route", F.size("params").cast("string")).alias("route"))


_RAW = (
    ("ruff", '[{"code":"S101","message":"m~","filename":"a~.py","location":{"row":3}},{"code":"E501","message":"m","filename":"b.py","location":{"row":1}}]', ("S101 a~.py 3 low m~", "E501 b.py 1 low m")),
    ("bandit", '{"results":[{"test_id":"B307","issue_text":"t~","filename":"a.py","line_number":9,"issue_severity":"HIGH","issue_confidence":"HIGH"}]}', ("B307 a.py 9 critical t~",)),
    ("gitleaks", '[{"RuleID":"aws-key","Description":"d~","File":"c~.env","StartLine":2}]', ("aws-key c~.env 2 critical d~",)),
    ("ruff", "not json", ()),
)
_RAW_ROWS = tuple((text, said) for _, text, said in _RAW)


@query(f"SELECT id, unnest({_stated(_RAW_ROWS, 'id', 'id')}) AS issue FROM (SELECT p_partkey AS id FROM part)")
def tool_issues(spark, sf):
    """Tools' JSON as one table, with codes, files, lines and messages."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("repo_id"), (F.col("p_partkey") % len(_RAW)).alias("v")).withColumn("raw_json", _variant(_RAW_ROWS, "repo_id", "repo_id"))
    out = None
    for tool in ("ruff", "bandit", "gitleaks"):
        mine = rows.filter(F.col("v").isin([k for k, r in enumerate(_RAW) if r[0] == tool])).drop("v")
        df = readers.tool_issues(mine, tool)
        out = df if out is None else out.unionByName(df)
    return out.select(F.col("repo_id").alias("id"), F.concat_ws(" ", "code", "file", F.col("line").cast("string"), "severity", "message").alias("issue"))


#: Files of a repository (path, content; of paths alone the content is empty), and its stack: category, name, confidence, evidence.
STACKS = (
    ((("package.json", '{"dependencies": {"react": "1", "next": "2"}, "devDependencies": {"react": "1"}}'), ("requirements.txt", "# web\nFastAPI==0.1\npsycopg2==2.9\n-r other.txt\n"), "web~.tsx", "x/b.ts", "next.config.js", "main.py", "docker-compose.yml", "node_modules/z~/a.ts", "node_modules/z/Dockerfile"),
     ("frontend|Next.js|0.95|'next' in package.json,next.config.js", "frontend|React|0.95|'react' in package.json", "frontend|TypeScript|0.9|web~.tsx,x/b.ts", "backend|FastAPI|0.95|'fastapi' in python deps,main.py", "database|PostgreSQL|0.9|'psycopg2' in python deps", "infra|Docker Compose|0.95|docker-compose.yml")),
    ((("package.json", '{"devDependencies": {"vitest": "~"}}'), ("requirements.txt", "sqlalchemy>=2\nDjango\n"), ".github/workflows/c~.yml", ".github/workflows/d.yml", "a/Dockerfile", "manage.py"),
     ("backend|Django|0.95|'django' in python deps,manage.py", "database|SQLAlchemy|0.95|'sqlalchemy' in python deps", "infra|Docker|0.95|a/Dockerfile", "infra|GitHub Actions|0.95|.github/workflows/c~.yml,.github/workflows/d.yml", "testing|JS Testing|0.9|'vitest' in package.json")),
    ((("package.json", "{broken"), "notes~.txt", "node_modules/z/vercel.json"), ()),
)


def _stack_files(spark: SparkSession, sf: str) -> DataFrame:
    """(repo_id, path, content) of the repositories of STACKS, one a part."""
    file = lambda f: F.struct(*(F.lit(x).alias(c) for x, c in zip((f, "") if isinstance(f, str) else f, ("path", "content"))))
    k = F.col("repo_id")
    some = F.element_at(F.array(*(F.array(*map(file, files)) for files, _ in STACKS)), (k % len(STACKS) + 1).cast("int"))
    said = lambda c: F.replace(F.col(f"f.{c}"), F.lit("~"), F.concat(F.lit("V"), k.cast("string"))).alias(c)
    return spread(table(spark, sf, "part").select(F.col("p_partkey").alias("repo_id"))).select("repo_id", F.explode(some).alias("f")).select("repo_id", said("path"), said("content"))


@query(
    f"""WITH s AS (SELECT id, string_split(unnest({_stated(STACKS, 'id', 'id')}), '|') AS t FROM (SELECT p_partkey AS id FROM part))
SELECT id, t[1] || ':' || t[2] || ':' || string_split(t[4], ',')[1] AS item, t[3]::DOUBLE AS confidence, t[4] AS evidence FROM s"""
)
def stack_items(spark, sf):
    """Stack by dependencies, read off manifests, and by paths that are not skipped, with confidence and all evidence."""
    f = _stack_files(spark, sf).filter(~C.should_skip(F.col("path")))
    t, p = F.col("content"), F.col("path")
    listed = lambda name, read: F.flatten(F.collect_list(F.when(p == name, read(t))))
    r = f.groupBy("repo_id").agg(F.array_sort(F.collect_list("path")).alias("paths"), listed("package.json", repos.package_json_dependencies).alias("npm"), listed("requirements.txt", repos.requirements).alias("python"))
    found = repos.stack(r)
    return found.select(F.col("repo_id").alias("id"), F.concat_ws(":", "category", "name", F.col("evidence")[0]).alias("item"), F.col("confidence").cast("double").alias("confidence"), F.array_join("evidence", ",").alias("evidence"))


SOURCES = (("import logging\npassword = \"correct horse~\"\ndef save(x):\n    return eval(\"x\")\n", ("2 hardcoded_secret", "4 eval_exec")), ("x = ~\n", ()))


@query(f"SELECT id, unnest({_stated(SOURCES, 'id', 'id')}) AS finding FROM (SELECT p_partkey AS id FROM part)")
def source_findings(spark, sf):
    """Line findings of sources (C17)."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id")).withColumn("content", _variant(SOURCES, "id", "id"))
    found = findings.line_findings(rows, key="id", text="content")
    return found.select("id", F.concat_ws(" ", F.col("line").cast("string"), "pattern").alias("finding"))
