"""Queries of what parsers read: files in variants that SQL makes of the driver's tables, each variant's answer stated on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import ORACLE_SQL, query, spread, table
from ..functions import syntax
from ..operators import ranking
from .records import _candidates

#: (text with ~ for the part's number, references by the rules)
PYTHON = (
    ('import os\nX = os.getenv("A~")\n', ("python_os_getenv:A~",)),
    ('import os\nX = os.getenv(\n    "B~",\n    "default",\n)\nY = os.environ["C~"]\n', ("python_os_getenv:B~", "python_os_environ_bracket:C~")),
    ('# os.getenv("D~")\ntext = \'os.getenv("E~")\'\nZ = os.environ.get("F~")\n', ()),
    ('def broken(:\n    os.getenv("G~")\n    os.environ[\'H~\']\n', ("python_os_environ_bracket:H~",)),
    ('import os as o\no.getenv("I~")\nos.getenv(name)\nos.getenv("lower~", os.getenv("J~"))\n# os.environ["K~"]\n', ("python_os_getenv:lower~", "python_os_getenv:J~", "python_os_environ_bracket:K~")),
)
SCRIPT = (("const a = process.env.L~;\nprocess.env['M~'];\n", ("ts_process_env:L~", "ts_process_env:M~")), ("process.env.lower~; env.N~\n", ()))


def _variant(rows, column: str, number: str):
    """Column of the text of a row's variant, with ~ replaced."""
    pick = F.element_at(F.array(*(F.lit(t) for t, _ in rows)), (F.col(column) % len(rows) + 1).cast("int"))
    return F.replace(pick, F.lit("~"), F.concat(F.lit("V"), F.col(number).cast("string")))


def _stated(rows, column: str, number: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return f"list_transform([{', '.join('[' + ', '.join(map(quoted, r)) + ']::VARCHAR[]' for _, r in rows)}][({column} % {len(rows)} + 1)::INT], lambda x: replace(x, '~', 'V' || {number}))"


@query(
    f"""SELECT id, path, unnest(refs) AS reference FROM (SELECT p_partkey AS id, 'a.py' AS path, {_stated(PYTHON, 'p_partkey', 'p_partkey')} AS refs FROM part
UNION ALL SELECT p_partkey, 'b.ts', {_stated(SCRIPT, 'p_partkey', 'p_partkey')} FROM part)"""
)
def env_references(spark, sf):
    """References to environment variables, Python's calls by the syntax tree."""
    p = spread(table(spark, sf, "part").select(F.col("p_partkey").alias("id")))
    files = p.select("id", F.lit("a.py").alias("path"), _variant(PYTHON, "id", "id").alias("content")).unionByName(p.select("id", F.lit("b.ts").alias("path"), _variant(SCRIPT, "id", "id").alias("content")))
    found = files.select("id", "path", F.explode(syntax.env_references(F.regexp_extract("path", r"\.[a-z]+$", 0), F.col("content"))).alias("r"))
    return found.select("id", "path", F.concat("r.rule", F.lit(":"), "r.name").alias("reference"))


WORKFLOWS = (
    ("on: push\njobs:\n  a:\n    steps:\n      - run: pytest -q\n      - uses: x/y@v1\n      - run: echo ~\n", ("pytest -q", "echo ~")),
    ("jobs: {a: {steps: [{run: ruff check .}, {name: x, run: 'echo ~'}]}, b: {steps: null}, c: 3}\n", ("ruff check .", "echo ~")),
    ("jobs:\n    a:\n        steps:\n            - run: >\n                npm\n                test\n            - run: |\n                one\n                echo ~\n", ("npm test\n", "one\necho ~\n")),
    ("common: &s\n  - run: mypy ~\njobs:\n  a:\n    steps: *s\n  b:\n    steps:\n      - run: 7\n      - run: go test ./...\n", ("mypy ~", "go test ./...")),
    ("jobs:\n  a:\n    steps:\n   - run: pytest\n  b: [\n", ()),
    ("- run: pytest\n", ()),
    ("# jobs:\n#   run: pytest\n", ()),
)
COMPOSE = (
    ("services:\n  db~:\n    image: postgres:15\n  web:\n    build: .\nvolumes:\n  x: {}\n", ("db~=postgres:15", "web=")),
    ("services: {cache: {image: 'redis~'}, 5: {}}\n", ("cache=redis~", "5=")),
    ("x: &d\n    image: mysql\nservices:\n    one~: *d\n    two: null\n", ("one~=mysql", "two=")),
    ("services:\n  - db\n", ()),
    ("services:\n  db: {image\n", ()),
)


@query(
    f"""SELECT id, 'run' AS kind, unnest({_stated(WORKFLOWS, 'id', 'id')}) AS item FROM (SELECT o_orderkey AS id FROM orders)
UNION ALL SELECT id, 'service', unnest({_stated(COMPOSE, 'id', 'id')}) FROM (SELECT o_orderkey AS id FROM orders)"""
)
def yaml_structures(spark, sf):
    """Commands of workflows and services of compose files, by their structure."""
    o = spread(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")))
    runs = o.select("id", F.lit("run").alias("kind"), F.explode(syntax.workflow_commands(_variant(WORKFLOWS, "id", "id"))).alias("item"))
    services = o.select("id", F.lit("service").alias("kind"), F.explode(syntax.compose_services(_variant(COMPOSE, "id", "id"))).alias("s"))
    return runs.unionByName(services.select("id", "kind", F.concat("s.name", F.lit("="), "s.image").alias("item")))


_PACK = (("q1", "small steel part"), ("q2", "the economy tool x"))
_HITS = lambda words: f"(({' + '.join(f'contains(lower(descr || chr(32) || p_name || chr(32) || p_brand), {w!r})::INT' for w in words)}) / {len(words)} * 90)"


def _scout_sql(hook: str, of: str) -> str:
    return f"""SELECT '{hook}' AS hook, query, id, quality, relevance, overall, row_number() OVER (PARTITION BY query ORDER BY overall DESC, id)::INT AS rank FROM (
  SELECT query, id, quality, relevance, least(100, round_even(round_even(0.4 * quality + 0.6 * relevance, 6), 0))::INT AS overall FROM (
    SELECT query, id, quality, CASE WHEN query = 'q1' AND id % 4 = 0 THEN (id * 13 % 101)::INT ELSE {of} END AS relevance FROM kept, (VALUES ('q1'), ('q2')) AS p(query)))"""


@query(
    ORACLE_SQL["candidate_quality"].rpartition("SELECT id, stars")[0]
    + ", best AS (SELECT *, least(70, s3)::INT AS quality, row_number() OVER (PARTITION BY p_brand || '-' || (id % 40) ORDER BY stars DESC, id) AS r FROM m), kept AS (SELECT * FROM best WHERE r = 1) "
    + _scout_sql("terms", f"least(100, trunc(CASE query WHEN 'q1' THEN {_HITS(['small', 'steel', 'part'])} ELSE {_HITS(['the', 'economy', 'tool'])} END)::INT + least(10, stars // 5000))::INT")
    + " UNION ALL "
    + _scout_sql("fallback", "least(100, quality + 8 * topics)::INT")
)
def scout_results(spark, sf):
    """Candidates from search to rank, under two hooks of relevance and a model that answers some."""
    c = _candidates(spark, sf).withColumn("topics", F.array("license_name"))
    model = c.filter("id % 4 = 0").select(F.lit("q1").alias("query"), "id", (F.col("id") * 13 % 101).cast("int").alias("relevance"))
    plain = lambda rows: rows.withColumn("relevance", ranking.fallback_relevance(F.col("quality"), F.col("n_topics"), F.lit(0)).cast("int"))
    out = None
    for hook, f in (("terms", ranking.by_terms), ("fallback", plain)):
        one = ranking.scout(c, list(_PACK), F.concat("license_name", F.lit("-"), F.col("id") % 40), f, model).select(F.lit(hook).alias("hook"), "query", "id", "quality", F.col("relevance").cast("int").alias("relevance"), "overall", "rank")
        out = one if out is None else out.unionByName(one)
    return out
