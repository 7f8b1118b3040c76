"""Queries of source-file operators: over documents as they are, and over files whose texts SQL makes of the driver's tables.

The text expressions are the same in Spark and DuckDB; what is read off them is written twice, once with the engine's
operators and once in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed
from ..catalog import query, spread, table
from ..functions import columns as C, parse
from ..operators import graph, repos, review, risk
from ..sources import readers

END = r"\r\n|[\n\r\v\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
WHITE = r"[ \t\v]"
SOLID = r"[^ \t\n\v\f\r]"


def lines_sql(table_: str, key: str, text: str, end: str = END) -> str:
    """(key, line, i) of every line of a text, the empty one after a last line end left out."""
    cut = f"string_split_regex(coalesce({text}, ''), '{end}')"
    return f"SELECT {key}, line, i FROM (SELECT {key}, unnest({cut}) AS line, unnest(range(1, len({cut}) + 1)) AS i, len({cut}) AS n FROM {table_}) WHERE NOT (line = '' AND i = n)"


@query(
    rf"""WITH k AS ({lines_sql("documents", "doc_id", "text")}), m AS (SELECT *, regexp_matches(line, '{SOLID}') AND NOT regexp_matches(line, '^{WHITE}*#') AS solid FROM k)
SELECT d.doc_id, count(*) FILTER (solid)::INT AS loc, count(line)::INT AS n_lines, coalesce(max(length(regexp_extract(line, '^{WHITE}*'))) FILTER (solid) // 4, 0)::INT AS nesting
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id"""
)
def line_statistics(spark, sf):
    """Lines of code, lines and nesting of every document."""
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", parse.loc(t).alias("loc"), F.size(parse.text_lines(t)).alias("n_lines"), parse.nesting(t).alias("nesting"))


def stripped_sql(text: str) -> str:
    """A text without strings and comments, by chr(34) and chr(39) so that no quote needs doubling."""
    two, one = "chr(34)", "chr(39)"
    steps = [f"'(?s)' || repeat({q}, 3) || '.*?' || repeat({q}, 3)" for q in (two, one)] + [rf"{q} || '[^' || {q} || '\n]*' || {q}" for q in (two, one)]
    for k, pattern in enumerate(steps):
        text = f"regexp_replace({text}, {pattern}, repeat({(two, one)[k % 2]}, 2), 'g')"
    return rf"regexp_replace({text}, '#[^\n]*', '', 'g')"


def complexity_sql(table_: str, key: str, text: str) -> str:
    return rf"""WITH c AS (SELECT {key}, {stripped_sql(f"coalesce({text}, '')")} AS t FROM {table_}),
l AS (SELECT {key}, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM c),
e AS (SELECT *, regexp_matches(line, '^[ \t]*def\s+\w+\s*\(') AS d FROM l),
b AS (SELECT *, count(*) FILTER (d) OVER (PARTITION BY {key} ORDER BY i) AS block, bool_or(d) OVER (PARTITION BY {key}) AS any_def FROM e),
s AS (SELECT {key}, block, 1 + count(*) FILTER (regexp_matches(line, '^\s*(if|elif|for|while|except|case)\b')) + 0.5 * sum(len(regexp_extract_all(line, '\b(and|or)\b'))) AS x FROM b WHERE block > 0 OR NOT any_def GROUP BY {key}, block)
SELECT {key}, round_even(avg(x), 2)::DOUBLE AS complexity FROM s GROUP BY {key}"""


@query(complexity_sql("documents", "doc_id", "text"))
def complexity(spark, sf):
    """Complexity of every document taken as source."""
    return table(spark, sf, "documents").select("doc_id", parse.python_complexity(F.col("text")).alias("complexity"))


def made(*lines: str) -> str:
    """SQL of a text of lines; each is an expression that gives a text with its line end, or nothing."""
    return f"concat({', '.join(lines)})"


def line(text: str, when: str = "") -> str:
    """A line of fixed text, where a condition holds; ~ stands for the quote that SQL uses, ^ for a tab."""
    parts = f"concat({', '.join(_pieces(text))}, chr(10))"
    return f"CASE WHEN {when} THEN {parts} ELSE '' END" if when else parts


def _pieces(text: str) -> list[str]:
    out, plain = [], ""
    for ch in text:
        if ch in "~^":
            out += [f"'{plain}'"] * bool(plain) + ["chr(39)" if ch == "~" else "chr(9)"]
            plain = ""
        else:
            plain += ch
    return out + [f"'{plain}'"] * bool(plain or not out)


PYTHON_TEXT = made(
    line("import os, json as js"), line("from fastapi import FastAPI", "p_size % 3 = 0"), line("import redis, flask.json", "p_size % 3 = 1"), line("from app.models import order, Order, _hidden  # note", "p_size % 3 = 2"), line("import boto3 as b", "p_size % 5 = 0"),
    line("class Base:", "p_size % 4 = 0"), line('    """doc if a or b"""', "p_size % 4 = 0"), line("class _Own(Base): pass", "p_size % 4 = 1"), line("def first(a: int, b) -> str:", "p_size % 5 < 3"), line("def _second(a):", "p_size % 5 >= 3"),
    line("    # if a and b"), "repeat(concat('    if a and b:', chr(10)), cast(p_size % 7 as int))", line("    try:", "p_size % 2 = 0"), line('        x = "if (a or b)"'), line("    except ValueError:", "p_size % 2 = 0"), line("^^for y in ~a or b~:"), line("async def third(): return a and b", "p_size % 6 = 3"), line("def fourth(z):", "p_size % 6 = 4"),
    line('@app.get("/items/{id}")', "p_size % 6 = 1"), line("@bp.route(~/x~, methods=[~GET~, ~POST~])", "p_size % 6 = 2"), line('@thing.delete("/y/:a/{b}")', "p_size % 6 = 5"), line("path(~z/~, view)", "p_size % 9 = 2"), line('password = "supersecret"', "p_size % 8 = 0"), line("eval(x)", "p_size % 9 = 0"), line("requests.get(u)", "p_size % 10 = 0"), line("            deepest", "p_size % 11 = 0"),
)
SCRIPT_TEXT = made(
    line("import React from ~react~;", "s % 2 = 0"), line("import { z } from ~@tanstack/query~;", "s % 3 = 0"), line("export * from ~./all~;", "s % 3 = 1"), line("export { a } from ~../next/b~;", "s % 4 = 0"), line("import ~./side~;"), line("// if while"), line("/** if a */", "s % 5 = 0"), line("export default function Page() {", "s % 2 = 1"), line("export const go = async () => {"), line("const run = (x: number) => x && y || `a && b`;"),
    "repeat(concat('  if (a) { for (;;) {} } else { b }', chr(10)), cast(s % 4 as int))", line('  const u = "http://if"; // else', "s % 6 = 0"), line("  try { go() } catch (e) {}", "s % 2 = 0"), line("interface P { a: string }", "s % 7 = 0"), line("router.post(~/pay/:id~, run)", "s % 3 = 2"), line("fetch(~/x~)", "s % 5 = 1"),
)
PARTS = f"(SELECT p_partkey AS id, {PYTHON_TEXT} AS content FROM part)"
SCRIPTS = f"(SELECT c_custkey AS id, {SCRIPT_TEXT} AS content FROM (SELECT c_custkey, c_custkey % 97 AS s FROM customer))"


def python_files(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "part").select("p_partkey", "p_size")).select(F.col("p_partkey").alias("id"), F.expr(PYTHON_TEXT).alias("content"))


def script_files(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "customer").select("c_custkey")).withColumn("s", F.col("c_custkey") % 97).select(F.col("c_custkey").alias("id"), F.expr(SCRIPT_TEXT).alias("content"))


def csv(c: str):
    return F.array_join(c, ",").alias(c)


def _flags_sql(patterns) -> str:
    cases = ", ".join("CASE WHEN regexp_matches(content, '" + p[1].replace("'", "''") + f"') THEN '{p[0]}' END" for p in patterns)
    return f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ',')"


def _map_sql(table_: dict, key: str) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + " END"


SENSITIVE = [*fixed.LINE_PATTERNS[:8], *fixed.FLAG_ONLY_PATTERNS, *fixed.LINE_PATTERNS[8:]]


@query(
    rf"""WITH f AS {PARTS}, l AS ({lines_sql("f", "id", "content")}), s AS (SELECT id, i, trim(line, ' ' || chr(9)) AS x FROM l),
m AS (SELECT id, i, regexp_extract(x, '^from\s+([\w.]+)\s+import\s+([\w\s,*]+?)(?:\s*#.*)?$', 1) AS module, regexp_extract(x, '^from\s+([\w.]+)\s+import\s+([\w\s,*]+?)(?:\s*#.*)?$', 2) AS names, regexp_extract(x, '^import\s+([\w., ]+?)(?:\s*#.*)?(?:\s+as\s+\w+)?$', 1) AS bare FROM s),
n AS (SELECT id, i, CASE WHEN module <> '' THEN list_concat([module], list_transform(list_filter(list_transform(string_split(names, ','), lambda n: trim(n)), lambda n: regexp_matches(n, '^[a-z]')), lambda n: module || '.' || n))
  WHEN bare <> '' THEN list_transform(string_split(bare, ','), lambda n: trim(string_split(trim(n), ' as ')[1])) ELSE [] END AS here FROM m),
im AS (SELECT id, flatten(list(here ORDER BY i)) AS imports FROM n GROUP BY id),
x AS ({complexity_sql("f", "id", "content")}),
o AS (SELECT id, count(*) FILTER (regexp_matches(line, '{SOLID}') AND NOT regexp_matches(line, '^{WHITE}*#'))::INT AS loc, (max(length(regexp_extract(line, '^{WHITE}*'))) FILTER (regexp_matches(line, '{SOLID}') AND NOT regexp_matches(line, '^{WHITE}*#')) // 4)::INT AS nesting FROM l GROUP BY id),
d AS (SELECT *, regexp_extract_all(content, '(?m)^def\s+(\w+)\s*\(', 1) AS fn, regexp_extract_all(content, '(?m)^class\s+(\w+)', 1) AS cl FROM f)
SELECT d.id, loc, nesting, complexity, array_to_string(imports, ',') AS imports,
  array_to_string(list_filter(list_transform(imports, lambda i: {_map_sql(fixed.PYTHON_FRAMEWORKS, "lower(string_split(i, '.')[1])")}), lambda x: x IS NOT NULL), ',') AS framework_signals,
  array_to_string(fn, ',') AS function_names, array_to_string(cl, ',') AS class_names, array_to_string(list_filter(list_concat(fn, cl), lambda n: NOT starts_with(n, '_')), ',') AS exports,
  regexp_matches(content, 'def\s+\w+\s*\([^)]*:\s*\w') OR regexp_matches(content, '->\s*\w') AS has_type_annotations, regexp_matches(content, '(?s)""\".*?""\"') AS has_docstrings, regexp_matches(content, '\btry\s*:') AS has_error_handling,
  {_flags_sql(SENSITIVE)} AS sensitive_ops, {_flags_sql(fixed.EXTERNAL_CALLS)} AS external_calls, len(regexp_extract_all(content, '(?i)@\w+\.(?:get|post|put|delete|patch|route)\s*\([' || chr(34) || chr(39) || '][^' || chr(34) || chr(39) || ']+[' || chr(34) || chr(39) || ']'))::INT AS n_routes
FROM d JOIN o ON d.id = o.id JOIN im ON d.id = im.id JOIN x ON d.id = x.id""".replace('""\\"', '"""')
)
def python_parse(spark, sf):
    """Whole-file parse of Python sources."""
    p = python_files(spark, sf).select("id", parse.parse(F.lit("python"), F.col("content")).alias("p")).select("id", "p.*")
    return p.select("id", "loc", F.col("nesting_depth_max").alias("nesting"), F.col("complexity_score").alias("complexity"), csv("imports"), csv("framework_signals"), csv("function_names"), csv("class_names"), csv("exports"), "has_type_annotations", "has_docstrings", "has_error_handling", csv("sensitive_ops"), csv("external_calls"), F.size("route_methods").alias("n_routes"))


def _script_strip_sql(text: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({text}, '`[^`]*`', '``', 'g'), chr(34) || '[^' || chr(34) || '\n]*' || chr(34), repeat(chr(34), 2), 'g'), chr(39) || '[^' || chr(39) || '\n]*' || chr(39), repeat(chr(39), 2), 'g'), '(?s)/\*.*?\*/', '', 'g'), '//[^\n]*', '', 'g')"


@query(
    rf"""WITH f AS {SCRIPTS}, l AS ({lines_sql("f", "id", "content")}), o AS (SELECT id, count(*) FILTER (regexp_matches(line, '{SOLID}') AND NOT regexp_matches(line, '^{WHITE}*//'))::INT AS loc FROM l GROUP BY id),
q AS (SELECT *, '(?m)^(?:import|export)\s+.*?\s+from\s+[' || chr(34) || chr(39) || ']([^' || chr(34) || chr(39) || ']+)' AS im FROM f),
d AS (SELECT id, content, regexp_extract_all(content, im, 1) AS imports, list_filter(list_transform(regexp_extract_all(content, '(?:function\s+\w+|const\s+\w+\s*=\s*(?:async\s+)?\()'), lambda x: regexp_extract(x, '(?:function|const)\s+(\w+)', 1)), lambda x: x <> '') AS fn FROM q)
SELECT d.id, loc, array_to_string(imports, ',') AS imports, array_to_string(list_filter(list_transform(imports, lambda i: CASE WHEN starts_with(i, '@tanstack/') THEN 'tanstack' ELSE {_map_sql(fixed.SCRIPT_FRAMEWORKS, "lower(string_split(i, '/')[1])")} END), lambda x: x IS NOT NULL), ',') AS framework_signals,
  array_to_string(fn, ',') AS function_names, array_to_string(regexp_extract_all(content, '(?m)^export\s+(?:default\s+)?(?:function|class|const|type|interface)\s+(\w+)', 1), ',') AS exports,
  contains(content, ': ') AND (contains(content, 'interface ') OR contains(content, 'type ')) AS has_type_annotations, contains(content, '/**') AS has_docstrings, regexp_matches(content, '\btry\s*\{{') AS has_error_handling, {_flags_sql(fixed.EXTERNAL_CALLS)} AS external_calls,
  (len(fn) + len(regexp_extract_all({_script_strip_sql("content")}, '\b(?:if|else|for|while|catch)\b|&&|\|\|')))::DOUBLE AS complexity
FROM d JOIN o ON d.id = o.id"""
)
def script_parse(spark, sf):
    """Whole-file parse of scripts."""
    p = script_files(spark, sf).select("id", parse.parse(F.lit("typescript"), F.col("content")).alias("p")).select("id", "p.*")
    return p.select("id", "loc", csv("imports"), csv("framework_signals"), csv("function_names"), csv("exports"), "has_type_annotations", "has_docstrings", "has_error_handling", csv("external_calls"), F.col("complexity_score").alias("complexity"))


@query(rf"""WITH k AS ({lines_sql("pages", "page_id", "html")}), o AS (SELECT page_id, count(*) FILTER (regexp_matches(line, '{SOLID}'))::INT AS loc FROM k GROUP BY page_id) SELECT p.page_id, coalesce(loc, 0)::INT AS loc, {_flags_sql(SENSITIVE).replace("content", "coalesce(html, '')")} AS sensitive_ops FROM pages p LEFT JOIN o ON p.page_id = o.page_id""")
def generic_parse(spark, sf):
    """Parse of a language without a parser of its own."""
    return table(spark, sf, "pages").select("page_id", parse.parse(F.lit("html"), F.col("html")).alias("p")).select("page_id", "p.loc", F.array_join("p.sensitive_ops", ",").alias("sensitive_ops"))


def _route_sql() -> str:
    rows = [
        ("fastapi", "GET", "/items/{id}", "id", "p_size % 6 = 1"), ("fastapi", "DELETE", "/y/:a/{b}", "a,b", "p_size % 6 = 5"), ("flask", "GET", "/x", "", "p_size % 6 = 2"), ("flask", "POST", "/x", "", "p_size % 6 = 2"), ("django", "ANY", "z/", "", "p_size % 9 = 2"),
        ("generic", "GET", "/items/{id}", "id", "p_size % 6 = 1"), ("generic", "DELETE", "/y/:a/{b}", "a,b", "p_size % 6 = 5"), ("generic", "ROUTE", "/x", "", "p_size % 6 = 2"),
    ]
    parts = [f"SELECT '{fw}' AS framework, p_partkey AS file, '{m}' AS method, '{r}' AS route, '{ps}' AS params FROM part WHERE {when}" for fw, m, r, ps, when in rows]
    parts.append("SELECT 'express', c_custkey, 'POST', '/pay/:id', 'id' FROM customer WHERE (c_custkey % 97) % 3 = 2")
    return " UNION ALL ".join(parts)


@query(_route_sql())
def framework_routes(spark, sf):
    """Routes by each framework's patterns, an unknown one by the generic."""
    out = None
    for fw in ("fastapi", "flask", "django", "express", "generic"):
        files = script_files(spark, sf) if fw == "express" else python_files(spark, sf)
        rows = repos.routes(files, fw, key="id").select(F.lit(fw).alias("framework"), "file", "method", "route", F.array_join("params", ",").alias("params"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _fixed_values(table_: dict) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in table_.items())


_ISSUES = {
    "ruff": ("element_at(array('F401','S101','S608','B006','XX1','ANN201'), cast(o_orderkey % 6 as int) + 1)", "concat('[{\"code\":\"', c, '\",\"message\":\"m\",\"filename\":\"f\",\"location\":{\"row\":', cast(o_orderkey % 50 as string), '}}]')"),
    "bandit": ("element_at(array('HIGH/HIGH','HIGH/LOW','MEDIUM/LOW','LOW/HIGH','LOW/LOW','X/HIGH'), cast(o_orderkey % 6 as int) + 1)", "concat('{\"results\":[{\"test_id\":\"B1\",\"issue_text\":\"m\",\"filename\":\"f\",\"line_number\":', cast(o_orderkey % 50 as string), ',\"issue_severity\":\"', split(c, '/')[0], '\",\"issue_confidence\":\"', split(c, '/')[1], '\"}]}')"),
    "eslint": ("element_at(array('no-eval/1','eqeqeq/2','other/2','other/1','other/0','other/9'), cast(o_orderkey % 6 as int) + 1)", "concat('[{\"filePath\":\"f\",\"messages\":[{\"ruleId\":\"', split(c, '/')[0], '\",\"message\":\"m\",\"line\":', cast(o_orderkey % 50 as string), ',\"severity\":', split(c, '/')[1], '}]}]')"),
    "gitleaks": ("element_at(array('aws-key','generic-api-key','password-in-url'), cast(o_orderkey % 3 as int) + 1)", "concat('[{\"RuleID\":\"', c, '\",\"Description\":\"m\",\"File\":\"f\",\"StartLine\":', cast(o_orderkey % 50 as string), '}]')"),
    "hadolint": ("element_at(array('error','warning','info','style','odd'), cast(o_orderkey % 5 as int) + 1)", "concat('[{\"code\":\"DL1\",\"message\":\"m\",\"file\":\"f\",\"line\":', cast(o_orderkey % 50 as string), ',\"level\":\"', c, '\"}]')"),
    "pip-audit": ("element_at(array('Remote code','injection','nothing','an RCE here'), cast(o_orderkey % 4 as int) + 1)", "concat('{\"dependencies\":[{\"name\":\"f\",\"version\":\"1\",\"vulns\":[{\"id\":\"C1\",\"description\":\"', c, '\"}]},{\"name\":\"g\",\"version\":\"1\",\"vulns\":[]}]}')"),
}
_SEVERITIES = {
    "ruff": ("F401 medium", "S101 low", "S608 high", "B006 high", "XX1 low", "ANN201 low"),
    "bandit": ("HIGH/HIGH critical", "HIGH/LOW high", "MEDIUM/LOW medium", "LOW/HIGH medium", "LOW/LOW low", "X/HIGH medium"),
    "eslint": ("no-eval/1 high", "eqeqeq/2 medium", "other/2 medium", "other/1 low", "other/0 info", "other/9 medium"),
    "gitleaks": ("aws-key critical", "generic-api-key high", "password-in-url high"),
    "hadolint": ("error high", "warning medium", "info low", "style low", "odd medium"),
    "pip-audit": ("Remote_code high", "injection medium", "nothing medium", "an_RCE_here high"),
}


@query(" UNION ALL ".join(f"SELECT '{tool}' AS tool, o_orderkey AS id, {'NULL' if tool == 'pip-audit' else '(o_orderkey % 50)'}::INT AS line, [{', '.join(repr(x.split()[1]) for x in rows)}][(o_orderkey % {len(rows)})::INT + 1] AS severity FROM orders" for tool, rows in _SEVERITIES.items()))
def tool_severities(spark, sf):
    """Six tools' JSON, a broken one among it, as issues with the severities of the fixed tables."""
    o, raw = table(spark, sf, "orders").select("o_orderkey"), None
    for tool, (code, text) in _ISSUES.items():
        rows = o.withColumn("c", F.expr(code)).select(F.col("o_orderkey").alias("repo_id"), F.lit(tool).alias("tool"), F.expr(text).alias("raw_json"))
        raw = rows if raw is None else raw.unionByName(rows)
    broken = o.select((-F.col("o_orderkey")).alias("repo_id"), F.lit("ruff").alias("tool"), F.lit("{oops").alias("raw_json"))
    return readers.all_issues(raw.unionByName(broken)).select("tool", F.col("repo_id").alias("id"), "line", "severity")


_TAGS = (("F401", "correctness,pyflakes"), ("E501", "style,pycodestyle"), ("ANN201", "annotations,typing"), ("ERA001", "dead-code,style,pycodestyle"), ("RUF100", "ruff"), ("B904", "bugbear,correctness"), ("Q1", ""))


@query(f"SELECT l_orderkey AS id, l_linenumber AS line, [{', '.join(repr(t) for _, t in _TAGS)}][(l_partkey % 7)::INT + 1] AS tags FROM lineitem")
def issue_tags(spark, sf):
    """Tags of lint codes."""
    code = F.element_at(C.strings([c for c, _ in _TAGS]), (F.col("l_partkey") % 7 + 1).cast("int"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.array_join(readers.ruff_tags(code), ",").alias("tags"))


_RAW = (("python", "shop.models", "ambiguous_package_import"), ("python", "shop.missing", "file_not_scanned"), ("python", ".gone", "file_not_scanned"), ("python", "importlib.x", "dynamic_import"), ("typescript", "@/x", "file_not_scanned"), ("typescript", "@other/x", "alias_unknown"), ("typescript", "./y", "file_not_scanned"), ("javascript", "a${b}", "dynamic_import"), ("go", "x.models", "file_not_scanned"), ("python", "models", "file_not_scanned"), ("python", "..pkg.Utils", "ambiguous_package_import"))


@query(f"SELECT [{', '.join(repr(x[2]) for x in _RAW)}][(l_partkey % {len(_RAW)})::INT + 1] AS reason, count(*) AS n FROM lineitem GROUP BY 1")
def unresolved_reasons(spark, sf):
    """Why imports resolve to no file, by reason."""
    at = (F.col("l_partkey") % len(_RAW) + 1).cast("int")
    rows = table(spark, sf, "lineitem").select(F.element_at(C.strings([x[0] for x in _RAW]), at).alias("language"), F.element_at(C.strings([x[1] for x in _RAW]), at).alias("raw"), F.lit(None).cast("string").alias("target"))
    edges = rows.withColumn("reason", graph.unresolved_reason(F.col("raw"), F.col("language"), ["@/", "~/"]))
    return graph.unresolved_by_reason(edges, [])


PATHS = (
    "README.md", "docs/LICENSE", ".github/workflows/ci.yml", "tests/test_a.py", "src/app.py", "src/user_router.py", "lib/test/b.ts", "vendor/c.go", "Dockerfile", "poetry.lock", ".env.sample", "web/.prettierrc", "ruff.toml", "mypy.ini", "pyproject.toml", "src/spec_one/d.py",
    "src/settings.py", "src/auth.py", "app/migrations/0001_x.py", "src/log.py", "src/health.py", "tests/test_migrate.py", "package.json", "Makefile", "requirements.txt", ".gitlab-ci.yml", "node_modules/x/auth.js", "src/hub.py", "web/trace.ts", "setup.cfg",
)
TEXTS = {
    ".github/workflows/ci.yml": made(line("jobs:"), line("  a:"), line("    steps:"), line("      - run: pytest -q", "o % 2 = 0"), line("      - run: ruff check .", "o % 3 = 0"), line("      - run: echo no")),
    "tests/test_a.py": made(line("import pytest", "o % 2 = 0"), line("import unittest", "o % 2 = 1")), "src/log.py": made(line("import structlog", "o % 4 = 0"), line("import logging", "o % 4 = 1"), line("print(1)")),
    "src/app.py": made(line("@app.exception_handler(E)", "o % 3 = 0"), line("class X(BaseHTTPMiddleware): pass", "o % 3 = 1")), "src/health.py": made(line("@app.get(~/health~)", "o % 2 = 0"), line('@x.route("/ping")', "o % 3 = 0"), line('app.use("/status")', "o % 5 = 0")),
    "tests/test_migrate.py": made(line("from alembic import op", "o % 2 = 1")), "package.json": "'{\"scripts\":{\"dev\":\"x\",\"lint\":\"y\"},\"devDependencies\":{\"vitest\":\"1\",\"@playwright/test\":\"1\"}}'", "Makefile": made(line("run: deps"), line("^uvicorn a:b", "o % 2 = 0"), line(""), line("lint:"), line("^ruff")),
    "requirements.txt": made(line("uvicorn==1")), "src/settings.py": made(line("x = 1")), "src/user_router.py": made(line("class Settings(B): pass", "o % 2 = 0")), "src/hub.py": made(line("app.include_router(a)"), line("app.include_router(b)", "o % 2 = 1")), "web/trace.ts": made(line("import * as S from ~@sentry/node~", "o % 2 = 0"), line("import t from ~@opentelemetry/api~", "o % 3 = 0")),
    "pyproject.toml": made(line("[tool.black]", "o % 2 = 0"), line("[tool.mypy]", "o % 3 = 0")), ".gitlab-ci.yml": made(line("job:"), line("  script:"), line("    - go test ./...", "o % 2 = 0")),
}
#: Files of repositories made of orders: a customer is a repository, an order one of its files.
FILES = f"(SELECT DISTINCT o_custkey AS repo_id, path, o, CASE path {' '.join(f'WHEN {p!r} THEN {t}' for p, t in TEXTS.items())} ELSE '' END AS content FROM (SELECT o_custkey, o_custkey % 60 AS o, @pick@ AS path FROM orders))"
FILES_SQL = FILES.replace("@pick@", f"[{', '.join(map(repr, PATHS))}][(o_orderkey * 7 % {len(PATHS)})::INT + 1]")


def repo_files(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "orders").createOrReplaceTempView("_orders_as_files")
    pick = f"element_at(array({', '.join(map(repr, PATHS))}), cast(o_orderkey * 7 % {len(PATHS)} as int) + 1)"
    return spark.sql("SELECT repo_id, path, content FROM " + FILES.replace("@pick@", pick).replace("FROM orders)", "FROM _orders_as_files)"))


def _has(*paths: str) -> str:
    return f"coalesce(bool_or(path IN ({', '.join(map(repr, paths))})), false)"


@query(
    f"""WITH f AS (SELECT * FROM {FILES_SQL} WHERE path <> 'node_modules/x/auth.js' AND path <> 'vendor/c.go')
SELECT repo_id, {_has("README.md")} AS has_readme, {_has("docs/LICENSE")} AS has_license, {_has(".github/workflows/ci.yml", ".gitlab-ci.yml")} AS has_ci, {_has(".github/workflows/ci.yml")} AS has_github_actions, {_has("tests/test_a.py", "tests/test_migrate.py", "lib/test/b.ts", "src/spec_one/d.py")} AS has_tests,
  {_has("poetry.lock", "requirements.txt")} AS has_lockfile, {_has(".env.sample")} AS has_env_example, {_has("Dockerfile")} AS has_dockerfile, coalesce(bool_or(path = 'web/.prettierrc' OR (path = 'pyproject.toml' AND o % 2 = 0)), false) AS has_formatter, {_has("ruff.toml")} AS has_linter, coalesce(bool_or(path = 'mypy.ini' OR (path = 'pyproject.toml' AND o % 3 = 0)), false) AS has_type_checker,
  count(*) FILTER (path IN ('tests/test_a.py', 'tests/test_migrate.py', 'src/app.py', 'src/user_router.py', 'src/spec_one/d.py', 'src/settings.py', 'src/auth.py', 'app/migrations/0001_x.py', 'src/log.py', 'src/health.py', 'src/hub.py', 'web/trace.ts')) AS sources,
  count(*) FILTER (path IN ('tests/test_a.py', 'tests/test_migrate.py', 'lib/test/b.ts')) AS tests, count(*) FILTER (path = 'src/user_router.py') AS routers, count(*) AS total FROM f GROUP BY repo_id"""
)
def repo_facts(spark, sf):
    """Presence of tools and counts of files by repository (D11, S-A16)."""
    f = repos.facts(repo_files(spark, sf))
    return f.select("repo_id", *(f"has_{x}" for x in ("readme", "license", "ci", "github_actions", "tests", "lockfile", "env_example", "dockerfile", "formatter", "linter", "type_checker")), "sources", "tests", "routers", "total")


def _routes_of_health() -> str:
    return "list_sort(list_distinct(flatten(list(CASE WHEN path = 'src/health.py' THEN list_filter([CASE WHEN o % 2 = 0 THEN '/health' END, CASE WHEN o % 3 = 0 THEN '/ping' END, CASE WHEN o % 5 = 0 THEN '/status' END], lambda x: x IS NOT NULL) ELSE []::VARCHAR[] END))))"


@query(
    f"""WITH f AS {FILES_SQL}
SELECT repo_id, CASE WHEN bool_or(path = 'src/log.py' AND o % 4 = 0) THEN 'structlog' WHEN bool_or(path = 'src/log.py' AND o % 4 = 1) THEN 'stdlib_logging' END AS framework, bool_or(path = 'src/log.py' AND o % 4 > 1) AS print_only,
  CASE WHEN bool_or(path = 'src/app.py' AND o % 3 = 0) THEN 'exception_handler' WHEN bool_or(path = 'src/app.py' AND o % 3 = 1) THEN 'middleware' END AS handler_type, array_to_string({_routes_of_health()}, ',') AS routes,
  bool_or(path = 'web/trace.ts' AND o % 2 = 0) AS sentry, bool_or(path = 'web/trace.ts' AND o % 3 = 0) AS otel,
  array_to_string(list_filter([CASE WHEN bool_or(path = 'package.json') THEN 'playwright' END, CASE WHEN bool_or(path IN ('tests/test_a.py', 'tests/test_migrate.py', 'pyproject.toml', 'setup.cfg')) THEN 'pytest' END, CASE WHEN bool_or(path = 'tests/test_a.py' AND o % 2 = 1) THEN 'unittest' END, CASE WHEN bool_or(path = 'package.json') THEN 'vitest' END], lambda x: x IS NOT NULL), ',') AS frameworks,
  bool_or(path = 'setup.cfg') AS has_coverage, array_to_string(list_filter([CASE WHEN bool_or(path = '.github/workflows/ci.yml') THEN 'github_actions' END, CASE WHEN bool_or(path = '.gitlab-ci.yml') THEN 'gitlab_ci' END], lambda x: x IS NOT NULL), ',') AS platforms,
  bool_or(path IN ('.github/workflows/ci.yml', '.gitlab-ci.yml') AND o % 2 = 0) AS has_test_gate, bool_or(path = '.github/workflows/ci.yml' AND o % 3 = 0) AS has_lint_gate,
  CASE WHEN bool_or(path = 'app/migrations/0001_x.py') THEN 'app/migrations' ELSE '' END AS migration_paths, bool_or(path = 'tests/test_migrate.py' AND o % 2 = 1) AS has_migration_tests,
  count(*) FILTER (path = 'src/auth.py' OR (path = 'src/hub.py' AND o % 2 = 1)) AS hotspots, count(*) FILTER (path = 'src/settings.py' OR (path = 'src/user_router.py' AND o % 2 = 0)) AS config_files
FROM f GROUP BY repo_id"""
)
def risk_signals(spark, sf):
    """Detectors of the risk sections by repository (D8, G16, S-A34 to S-A41)."""
    s = risk.summary(repo_files(spark, sf))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    lists = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return s.select("repo_id", "framework", flag("print_only"), "handler_type", lists("routes"), flag("sentry"), flag("otel"), lists("frameworks"), flag("has_coverage"), lists("platforms"), flag("has_test_gate"), flag("has_lint_gate"), lists("migration_paths"), flag("has_migration_tests"), "hotspots", "config_files")


@query(
    f"""WITH f AS {FILES_SQL}, a AS (SELECT repo_id, bool_or(path = 'package.json') AS p, bool_or(path = 'Makefile') AS m, bool_or(path = 'requirements.txt') AS r, any_value(o) AS o FROM f WHERE path IN ('package.json', 'Makefile', 'requirements.txt', 'pyproject.toml') GROUP BY repo_id)
SELECT repo_id, array_to_string(list_filter([CASE WHEN p THEN 'npm run dev' END, CASE WHEN m THEN CASE WHEN o % 2 = 0 THEN 'uvicorn a:b' ELSE 'make run' END END, CASE WHEN r AND NOT (m AND o % 2 = 0) THEN 'uvicorn main:app --reload' END], lambda x: x IS NOT NULL), ',') AS commands FROM a"""
)
def start_commands(spark, sf):
    """Commands that start each repository's application."""
    return repos.start_commands(repo_files(spark, sf)).select("repo_id", F.array_join("commands", ",").alias("commands"))


_TOOLS = ("ruff", "bandit", "pip_audit", "gitleaks", "mypy")


@query(
    """WITH t AS (SELECT l_orderkey AS id, list_distinct(list(['ruff', 'bandit', 'pip_audit', 'gitleaks', 'mypy'][(l_partkey % 5)::INT + 1])) AS ts FROM lineitem GROUP BY 1)
SELECT id, CASE WHEN list_contains(ts, 'pip_audit') AND (list_contains(ts, 'ruff') OR list_contains(ts, 'bandit') OR list_contains(ts, 'gitleaks')) THEN 'full_toolchain' WHEN list_contains(ts, 'bandit') OR list_contains(ts, 'gitleaks') THEN 'security_augmented' WHEN list_contains(ts, 'ruff') THEN 'lint_augmented' ELSE 'structural_only' END AS depth FROM t"""
)
def analysis_depth(spark, sf):
    """Depth of a review by the tools that ran (S-A25)."""
    tool = F.element_at(C.strings(_TOOLS), (F.col("l_partkey") % 5 + 1).cast("int"))
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(tool).alias("ts")).select("id", review.depth_of(F.col("ts")).alias("depth"))


_RULES = ("GAMING-FACADE-001", "GAMING-TESTS-001", "GAMING-README-001", "TESTING-001", "SEC-SECRETS-001", "DX-LINT-001", "OPS-ENV-001")
_IMPACTS = f"i AS (SELECT l_orderkey AS id, [{', '.join(map(repr, _RULES))}][(l_partkey % 7)::INT + 1] AS rule_id, ['critical', 'high', 'medium', 'low'][(l_suppkey % 4)::INT + 1] AS severity, l_linenumber AS n FROM lineitem)"


def impacts(spark, sf):
    pick = lambda xs, c: F.element_at(C.strings(xs), (F.col(c) % len(xs) + 1).cast("int"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), pick(_RULES, "l_partkey").alias("rule_id"), pick(("critical", "high", "medium", "low"), "l_suppkey").alias("severity"), F.col("l_linenumber").alias("n"))


@query(
    f"""WITH {_IMPACTS}, g AS (SELECT id, count(*) FILTER (starts_with(rule_id, 'GAMING')) AS gaming, count(*) FILTER (NOT starts_with(rule_id, 'GAMING') AND severity IN ('critical', 'high')) AS hard,
  array_to_string(list_sort(list_distinct(list(CASE rule_id WHEN 'GAMING-FACADE-001' THEN 'facade_risk' WHEN 'GAMING-TESTS-001' THEN 'hollow_tests' WHEN 'GAMING-README-001' THEN 'readme_theater' END) FILTER (starts_with(rule_id, 'GAMING')))), ',') AS signals FROM i GROUP BY id)
SELECT id, gaming, hard, coalesce(signals, '') AS signals, CASE WHEN gaming = 0 AND hard <= 1 THEN 'likely_honest' WHEN gaming >= 2 THEN 'surface_polish' ELSE 'inconclusive' END AS verdict FROM g"""
)
def gaming_verdict(spark, sf):
    """Presentation against substance by order (S-A26)."""
    return review.anti_gaming(impacts(spark, sf), ["id"]).withColumn("signals", F.array_join("signals", ","))


@query(
    f"""WITH {_IMPACTS}, g AS (SELECT id, id % 100 AS security, id % 83 AS testing, bool_or(rule_id = 'TESTING-001') AS t, list('issue ' || rule_id || ' ' || n ORDER BY n, rule_id) FILTER (severity = 'critical') AS crit, arg_min('issue ' || rule_id || ' ' || n, ['critical', 'high', 'medium', 'low'].list_position(severity) * 100 + n) FILTER (rule_id = 'SEC-SECRETS-001') AS worst FROM i GROUP BY id)
SELECT id, array_to_string(list_slice(list_filter(list_concat([CASE WHEN security < 65 THEN 'Security score is ' || security || '/100' || coalesce(': ' || worst, '') END, CASE WHEN testing < 50 THEN CASE WHEN t THEN 'No test files detected — regressions cannot be validated' ELSE 'Testing score is ' || testing || '/100 — coverage is insufficient' END END], list_transform(list_slice(coalesce(crit, []), 1, CASE WHEN len(crit) > 1 AND crit[1] = crit[2] THEN 1 ELSE 2 END), lambda c: 'Critical finding: ' || c)), lambda x: x IS NOT NULL), 1, 3), '; ') AS reasons FROM g"""
)
def readiness_reasons(spark, sf):
    """Why orders, taken as repositories, are not fit for production (S-A27)."""
    rank = C.lookup(F.col("severity"), fixed.SEVERITY_RANK, 9)
    title = F.concat(F.lit("issue "), "rule_id", F.lit(" "), F.col("n").cast("string"))
    safety = F.col("rule_id") == "SEC-SECRETS-001"
    g = impacts(spark, sf).withColumn("title", title).groupBy("id").agg(F.collect_set("rule_id").alias("rules"), F.transform(F.array_sort(F.collect_list(F.when(F.col("severity") == "critical", F.struct("n", "title")))), lambda x: x["title"]).alias("critical"), F.min(F.when(safety, F.struct(rank.alias("r"), "n", "title"))).alias("worst"))
    why = review.readiness((F.col("id") % 100), (F.col("id") % 83), F.col("rules"), F.col("worst.title"), F.col("critical"))
    return g.select("id", F.array_join(why, "; ").alias("reasons"))


#: Tools by the number of a repository: what they said, as a record (tool|status|issues|error).
_RUNS = (("ruff", "success", 3, None), ("bandit", "timeout", 0, "e" * 200), ("mypy", "tool_not_found", 0, ""))


@query(
    f"""WITH f AS {FILES_SQL}, g AS (SELECT repo_id, count(*) FILTER (ends_with(path, '.py')) AS source, count(*) AS total, bool_or(path = 'Dockerfile') AS d, bool_or(path = '.github/workflows/ci.yml') AS a, bool_or(ends_with(path, '.py')) AS p, bool_or(path = 'vendor/c.go') AS g, repo_id % 4 AS n FROM f GROUP BY repo_id)
SELECT repo_id, round_even(source / total, 2)::DOUBLE AS scanned, round_even(p::INT / greatest(1, p::INT + g::INT), 2)::DOUBLE AS supported,
  array_to_string(['ruff|success|3|', 'bandit|timeout|0|' || repeat('e', 120), 'mypy|tool_not_found|0|'][1:n], ' ') AS tools,
  array_to_string(list_filter(['Runtime execution not performed', CASE WHEN NOT d THEN 'No Dockerfile found — container security checks skipped' END, CASE WHEN NOT a THEN 'No GitHub Actions workflows found — CI hygiene checks limited' END,
    CASE WHEN g THEN 'Unsupported language(s) detected: go — no rule pack available' END, CASE WHEN n >= 2 THEN 'Tool(s) timed out: bandit — findings may be incomplete' END, CASE WHEN n >= 3 THEN 'Tool(s) not installed: mypy — relevant checks skipped' END,
    'Dependency vulnerabilities reflect available lockfiles only', 'Generated files and vendor directories excluded from analysis'], lambda x: x IS NOT NULL), '; ') AS limits FROM g"""
)
def review_coverage(spark, sf):
    """What a review of each repository could see, what each tool said, and the limits (S-A24)."""
    path, ext = F.col("path"), C.extension(F.col("path"))
    g = repo_files(spark, sf).groupBy("repo_id").agg(F.count_if(ext == ".py").alias("source"), F.count(F.lit(1)).alias("total"), F.collect_set(F.when(ext == ".py", "Python").when(ext == ".go", "Go")).alias("langs"), F.bool_or(path == "Dockerfile").alias("d"), F.bool_or(path.rlike("^.github/workflows/")).alias("a"))
    tools = F.slice(F.array(*(F.struct(F.lit(t).alias("tool"), F.lit(s).alias("status"), F.lit(n).alias("issues"), F.lit(1.5).alias("seconds"), F.lit(e).cast("string").alias("error")) for t, s, n, e in _RUNS)), F.lit(1), (F.col("repo_id") % 4).cast("int"))
    c = review.coverage(F.col("source"), F.col("total"), F.col("langs"), F.col("d"), F.col("a"), tools)
    said = F.array_join(F.transform(c["tools"], lambda t: F.concat_ws("|", t["tool"], t["status"], t["issues_found"].cast("string"), F.coalesce(t["error_summary"], F.lit("")))), " ")
    return g.select("repo_id", c["repo_files_scanned_pct"].alias("scanned"), c["language_support_pct"].alias("supported"), said.alias("tools"), F.array_join(c["limits"], "; ").alias("limits"))
