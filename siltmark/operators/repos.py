"""Manifests, stacks, routes, risk sections: what is read off a repository's files."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import fixed
from ..functions import columns as C, parse


def package_json_dependencies(text: Column) -> Column:
    """Keys of the three dependency objects, each once; a malformed manifest has none."""
    keys = lambda f: F.coalesce(F.json_object_keys(F.get_json_object(text, f"$.{f}")), F.array().cast("array<string>"))
    return F.array_distinct(F.concat(keys("dependencies"), keys("devDependencies"), keys("peerDependencies")))


def package_json_scripts(text: Column) -> Column:
    """Names of a manifest's scripts."""
    return F.coalesce(F.json_object_keys(F.get_json_object(text, "$.scripts")), F.array().cast("array<string>"))


def requirements(text: Column) -> Column:
    """Names of a requirements file, cut at ==, >=, <= or ~= only, lower-cased."""
    kept = F.filter(F.transform(C.lines(text), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike("^[#-]"))
    return F.transform(kept, lambda x: F.lower(F.trim(F.regexp_extract(x, r"^(.*?)(?:==|>=|<=|~=|$)", 1))))


@F.pandas_udf(T.ArrayType(T.StringType()))
def pyproject_dependencies(text: pd.Series) -> pd.Series:
    """TOML has no reader in Spark: project and poetry dependencies, cut at [, >= or == only."""
    import re
    import tomllib

    def names(x):
        try:
            t = tomllib.loads(x or "")
        except (tomllib.TOMLDecodeError, TypeError):
            return []
        plain = [re.split(r"\[|>=|==", d)[0].strip().lower() for d in t.get("project", {}).get("dependencies", [])]
        poetry = [d.lower() for d in t.get("tool", {}).get("poetry", {}).get("dependencies", {}) if d.lower() != "python"]
        return list(dict.fromkeys(plain + poetry))

    return text.map(names)


def workflow_runs(text: Column) -> Column:
    """Commands of a workflow's run keys, single lines and blocks, from its text; no YAML reader is needed for these."""
    one = F.regexp_extract_all(text, F.lit(r"(?m)^\s*-?\s*run:\s*([^|>\s][^\n]*)$"), F.lit(1))
    block = F.regexp_extract_all(text, F.lit(r"(?m)^\s*-?\s*run:\s*[|>]-?\s*\n((?:[ ]{6,}[^\n]*\n?)+)"), F.lit(1))
    return F.concat(one, block)


def stack(repos: DataFrame, key: str = "repo_id") -> DataFrame:
    """(key, category, name, evidence, confidence) of repos (key, paths, npm, python: arrays)."""
    has = lambda side, *names: F.arrays_overlap(side, C.strings(names))
    first = lambda side, where, *names: F.transform(F.slice(F.filter(C.strings(names), lambda n: F.array_contains(side, n)), 1, 1), lambda n: F.concat(F.lit("'"), n, F.lit(f"' in {where}")))
    paths = lambda pattern, n: F.slice(F.filter("paths", lambda p: p.rlike(pattern)), 1, n)
    js, py = "package.json", "python deps"
    rules = [
        ("frontend", "Next.js", F.concat(first("npm", js, "next"), F.when(has("npm", "next"), paths(r"next\.config", 1)).otherwise(F.array().cast("array<string>"))), 0.95),
        ("frontend", "React", F.when(has("npm", "react", "react-dom"), F.array(F.lit("'react' in package.json"))), 0.95),
        ("frontend", "Vue", first("npm", js, "vue"), 0.95),
        ("frontend", "Svelte", first("npm", js, "svelte"), 0.95),
        ("frontend", "TypeScript", paths(r"\.tsx?$", 3), 0.9),
        ("backend", "FastAPI", F.when(has("python", "fastapi"), F.concat(first("python", py, "fastapi"), paths(r"(main|app)\.py$", 1))), 0.95),
        ("backend", "Django", F.when(has("python", "django"), F.concat(first("python", py, "django"), paths(r"^manage\.py$", 1))), 0.95),
        ("backend", "Flask", first("python", py, "flask"), 0.95),
        ("backend", "Express", first("npm", js, "express"), 0.95),
        ("database", "SQLAlchemy", first("python", py, "sqlalchemy", "sqlmodel"), 0.95),
        ("database", "Prisma", first("npm", js, "prisma"), 0.95),
        ("database", "PostgreSQL", first("python", py, "psycopg2", "asyncpg"), 0.9),
        ("database", "Supabase", F.slice(F.concat(first("npm", js, "supabase"), first("python", py, "supabase")), 1, 1), 0.9),
        ("infra", "Docker", paths(r"(^|/)Dockerfile$", 2), 0.95),
        ("infra", "Docker Compose", paths("docker-compose", 1), 0.95),
        ("infra", "Vercel", F.concat(F.transform(paths(r"vercel\.json", 1), lambda _: F.lit("vercel.json")), first("npm", js, "vercel")), 0.9),
        ("infra", "GitHub Actions", paths(r"\.github/workflows", 2), 0.95),
        ("testing", "JS Testing", first("npm", js, "jest", "vitest", "playwright", "cypress"), 0.9),
        ("testing", "Pytest", first("python", py, "pytest", "unittest"), 0.9),
    ]
    items = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(n).alias("name"), F.coalesce(e, F.array().cast("array<string>")).alias("evidence"), F.lit(p).alias("confidence")) for c, n, e, p in rules])
    return repos.select(key, F.explode(F.filter(items, lambda x: F.size(x["evidence"]) > 0)).alias("s")).select(key, "s.*")


def framework_key(name: Column) -> Column:
    """A framework's key among the route patterns; generic for others."""
    known = {k: v for k, v in fixed.FRAMEWORK_ALIASES.items() if any(p[0] == v for p in fixed.ROUTE_PATTERNS)}
    return C.lookup(F.lower(F.trim(name)), known, "generic")


def routes(files: DataFrame, framework: str, key: str = "path", text: str = "content") -> DataFrame:
    """(file, line, method, route, params) of a framework's patterns, generic ones for an unknown framework.

    A pattern gives the first match of a line, and each method of a list of methods; each (method, route) of a file
    counts once, by the first pattern and line that has it. Routes over 200 characters and empty ones do not count.
    """
    patterns = [p for p in fixed.ROUTE_PATTERNS if p[0] == framework] or [p for p in fixed.ROUTE_PATTERNS if p[0] == "generic"]
    patterns = [p for p in patterns if p[3]]
    any_hit = reduce(lambda a, b: a | b, [F.col("x").rlike(p[1]) for p in patterns]) if patterns else F.lit(False)
    rows = files.select(F.col(key).alias("file"), F.posexplode(parse.text_lines(F.col(text))).alias("pos", "x")).filter(any_hit)

    def of(k, pattern, method, path, several):
        one = F.upper(F.regexp_extract("x", pattern, method)) if method else F.lit("ANY")
        found = F.array(F.when(one == "", "ANY").otherwise(one))
        if several:
            listed = F.transform(F.regexp_extract_all(F.regexp_extract("x", pattern, several), F.lit(r"""['"](\w+)['"]"""), F.lit(1)), lambda m: F.upper(m))
            found = F.when(F.regexp_extract("x", pattern, several) != "", listed).otherwise(found)
        route = F.regexp_extract("x", pattern, path)
        hits = F.transform(found, lambda m: F.struct(F.lit(k).alias("k"), m.alias("method"), route.alias("route")))
        return F.when(F.col("x").rlike(pattern) & F.length(route).between(1, 200), hits)

    none = "array<struct<k:int, method:string, route:string>>"
    hits = [F.coalesce(of(k, *p[1:]), F.array().cast(none)) for k, p in enumerate(patterns)] or [F.array().cast(none)]
    rows = rows.select("file", "pos", F.explode(F.concat(*hits)).alias("h"))
    first = rows.groupBy("file", "h.method", "h.route").agg(F.min(F.struct("h.k", "pos")).alias("f"))
    return first.select("file", (F.col("f.pos") + 1).alias("line"), "method", "route", C.route_params(F.col("route")).alias("params"))


def facts(files: DataFrame, repo: str = "repo_id") -> DataFrame:
    """One row of facts a repository, from files (repo, path, content), for the rules. Tool issues and frameworks are added by joins."""
    base, where, path = C.basename(F.col("path")), F.lower(C.directory(F.col("path"))), F.col("path")
    stem, name = F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""), F.lower(base)
    n_lines = F.size(C.lines(F.col("content")))
    rows = files.filter(~F.arrays_overlap(C.parts(path), C.strings(fixed.SKIP_DIRS)))
    part = lambda *xs: F.arrays_overlap(C.parts(path), C.strings(xs))
    source = F.regexp_extract(base, r".(\.[^.]+)$", 1).isin(".py", ".ts", ".tsx", ".js", ".jsx", ".go", ".rs") & ~part("test", "vendor")
    test = part("test") | stem.rlike(r"^test_|_test$")
    flag = lambda c, n: F.bool_or(c).alias(f"has_{n}")
    tool = lambda *words: (path == "pyproject.toml") & F.col("content").rlike("|".join(words))
    languages = F.array_sort(F.collect_set(F.when(C.extension(path) == ".py", "Python").when(C.extension(path).isin(".ts", ".tsx"), "TypeScript").when(C.extension(path).isin(".js", ".jsx"), "JavaScript")))
    return rows.groupBy(repo).agg(
        flag(base.isin("README.md", "README.rst", "README.txt", "README"), "readme"), flag(base.isin("LICENSE", "LICENSE.md", "LICENSE.txt", "LICENCE"), "license"), flag(path.rlike(r"^\.github/workflows/|^\.circleci/") | base.isin(".gitlab-ci.yml", "Jenkinsfile"), "ci"), flag(path.rlike(r"^\.github/workflows/"), "github_actions"),
        flag(where.rlike("test|spec") | path.rlike("^tests?/"), "tests"), flag(base.isin("requirements.txt", "poetry.lock", "Pipfile.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml"), "lockfile"), flag(base.isin(".env.example", ".env.sample", ".env.template"), "env_example"), flag(base == "Dockerfile", "dockerfile"),
        flag(base.isin(".prettierrc", ".prettierrc.json", "prettier.config.js") | tool("black"), "formatter"), flag(base.isin("ruff.toml", ".ruff.toml", ".eslintrc", ".eslintrc.js", ".eslintrc.json") | tool("ruff"), "linter"),
        flag(base.isin("mypy.ini", ".mypy.ini", "pyrightconfig.json") | tool("mypy", "pyright"), "type_checker"), flag(name.isin("pytest.ini", "conftest.py") | tool(r"\[tool\.pytest"), "pytest_config"), flag(F.col("content").rlike(r"(?m)^\s*(structlog|loguru|python-json-logger)"), "logging_dependency"),
        languages.alias("languages"), F.array_sort(F.collect_set(F.when(name.isin("package.json", "requirements.txt", "pyproject.toml", "pipfile", "go.mod", "cargo.toml"), name))).alias("manifests"),
        F.array_sort(F.collect_list("path")).alias("files"), F.array_sort(F.collect_set(C.directory(path))).alias("directories"), F.array_sort(F.collect_list(F.when(source | test, F.struct("path", n_lines.alias("lines"))))).alias("file_lines"),
        F.count_if(source).alias("sources"), F.count_if(test).alias("tests"), F.count_if(F.lower(stem).rlike("route")).alias("routers"), F.count(F.lit(1)).alias("total"),
        F.max(F.when(name == "dockerfile", F.col("content"))).alias("docker_user"),
    )


def section_confidence(found: Column, failed: Column) -> Column:
    return F.greatest(F.lit(0.0), F.bround(F.least(found * 0.2 + 0.2, F.lit(1.0)) - failed * 0.1, 2))


def risk_level(score: Column, high: int, medium: int) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def setup_risk(missing_env: Column, env_example: Column, start_commands: Column, manifests: Column, signals: Column) -> Column:
    """struct(score, level, confidence): counts of missing variables, start commands, manifests and signals."""
    none = (manifests == 0) & (signals == 0)
    score = F.least(F.lit(100), F.when((missing_env > 0) & ~env_example, 65).otherwise(0) + F.when(start_commands == 0, 20).otherwise(0) + F.when(manifests == 0, 15).otherwise(0))
    sure = F.least(manifests * 0.25, F.lit(1.0))
    sure = F.bround(F.when(signals > 0, F.greatest(sure, F.lit(0.4))).otherwise(sure), 2)
    return F.struct(score.alias("score"), risk_level(score, 60, 30).alias("level"), F.when(none & (score == 0), 0.1).otherwise(sure).alias("confidence"))


def debug_readiness(logging: Column, tests: Column, errors: Column, health: Column, tracing: Column, failed: Column) -> Column:
    """struct(score, level, confidence) of what is present; a higher score is harder to debug."""
    weights = ((logging, 30), (tests, 30), (errors, 20), (health, 15), (tracing, 5))
    score = F.least(F.lit(100), sum((F.when(has, 0).otherwise(w) for has, w in weights), F.lit(0)))
    found = sum((has.cast("int") for has, _ in weights), F.lit(0))
    return F.struct(score.alias("score"), risk_level(score, 55, 25).alias("level"), section_confidence(found, failed).alias("confidence"))


def change_risk(ci: Column, test_gate: Column, tests: Column, untested_migrations: Column, hotspots: Column, found: Column, failed: Column) -> Column:
    score = F.when(~ci, 35).when(~test_gate, 20).otherwise(0) + F.when(~tests, 25).otherwise(0) + F.when(untested_migrations, 15).otherwise(0) + F.least(hotspots * 5, F.lit(20))
    score = F.least(F.lit(100), score)
    return F.struct(score.alias("score"), risk_level(score, 55, 25).alias("level"), section_confidence(found, failed).alias("confidence"))


def merged_dependencies(files: DataFrame, repo: str = "repo_id") -> DataFrame:
    """(repo, npm, python): dependencies of all manifests of a repository by path, each once."""
    text, name = F.col("content"), C.basename(F.col("path"))
    of = lambda test, deps: F.collect_list(F.when(test, F.struct("path", deps.alias("d"))))
    flat = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(c), lambda x: x["d"])))
    manifests = files.filter(name.isin("package.json", "requirements.txt", "pyproject.toml"))
    python = F.when(name == "requirements.txt", requirements(text)).otherwise(pyproject_dependencies(text))
    rows = manifests.groupBy(repo).agg(of(name == "package.json", package_json_dependencies(text)).alias("npm"), of(name != "package.json", python).alias("python"))
    return rows.select(repo, flat(F.col("npm")).alias("npm"), flat(F.col("python")).alias("python"))


def stack_languages(names: Column) -> Column:
    """Languages of a stack's names, in order and each once; python for none."""
    found = F.array_distinct(F.array_compact(F.transform(names, lambda n: C.lookup(n, fixed.STACK_LANGUAGE))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("python")))


def chosen_framework(backend: Column, frontend: Column) -> Column:
    """struct(framework, confidence): the first name of the backend, else of the frontend, that has route patterns."""
    keys = ("fastapi", "flask", "django", "express")
    first = lambda names: F.try_element_at(F.array_compact(F.transform(names, lambda n: F.when(F.lower(n).isin(*keys), F.lower(n)).when(F.lower(n) == "next.js", "nextjs"))), F.lit(1))
    key = F.coalesce(first(backend), first(frontend))
    return F.struct(F.coalesce(key, F.lit("unknown")).alias("framework"), F.when(key.isNotNull(), "high").otherwise("speculative").alias("confidence"))


def start_commands(files: DataFrame, repo: str = "repo_id") -> DataFrame:
    """(repo, commands): what most likely starts the application, of the manifests at a repository's root, each once.

    Scripts start, dev and serve; the first recipe line of a Makefile's run, start, dev, serve and up; a uvicorn call in
    pyproject.toml; and, unless there is one, uvicorn where the requirements name it.
    """
    text, path = F.col("content"), F.col("path")
    scripts = package_json_scripts(text)
    npm = F.transform(F.filter(C.strings(("start", "dev", "serve")), lambda k: F.array_contains(scripts, k)), lambda k: F.concat(F.lit("npm run "), k))
    target = r"(?m)^(run|start|dev|serve|up)[ \t]*:[^\n]*(?:\n(?: [^\n]*\S[^\n]*\n)*\t([^\n]*))?"
    make = F.zip_with(parse.groups(text, target, 1), parse.groups(text, target, 2), lambda t, r: F.when(F.trim(r) != "", F.trim(r)).otherwise(F.concat(F.lit("make "), t)))
    call = F.regexp_extract(text, r"uvicorn\s+[\w.]+:\w+", 0)
    project = F.when(call != "", F.array(call))
    hint = F.when(F.contains(F.lower(text), F.lit("uvicorn")), F.array(F.lit("uvicorn main:app --reload")))
    ranked = [("package.json", npm), ("Makefile", make), ("pyproject.toml", project), ("requirements.txt", hint)]
    rows = files.filter(path.isin(*[p for p, _ in ranked]))
    found = F.coalesce(*[F.when(path == p, F.struct(F.lit(k).alias("k"), F.coalesce(c, F.array().cast("array<string>")).alias("c"))) for k, (p, c) in enumerate(ranked)])
    lists = F.array_sort(F.collect_list(found))
    early = F.flatten(F.transform(F.filter(lists, lambda x: x["k"] < 3), lambda x: x["c"]))
    late = F.flatten(F.transform(F.filter(lists, lambda x: x["k"] == 3), lambda x: x["c"]))
    return rows.groupBy(repo).agg(early.alias("early"), late.alias("late")).select(repo, F.array_distinct(F.when(F.exists("early", lambda c: F.contains(c, F.lit("uvicorn"))), F.col("early")).otherwise(F.concat("early", "late"))).alias("commands"))
