"""Detectors of the risk sections: what a repository's files show of logging, tests, gates, migrations, configuration, hotspots.

Each takes files (repo, path, content) and gives one row a repository, or one row a file found, by partial aggregates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions import columns as C, parse, syntax
from . import repos

SCRIPTS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")


def _suffix() -> Column:
    return F.regexp_extract(C.basename(F.col("path")), r".(\.[^.]+)$", 1)


def walked() -> Column:
    """Whether a file is looked at: no hidden, installed or cached folder above it."""
    return ~F.exists(F.split(C.directory(F.col("path")), "/"), lambda p: F.startswith(p, F.lit(".")) | p.isin("node_modules", "__pycache__", ".venv", "venv"))


def _first(table, text: Column) -> Column:
    """The place in a table of patterns of the first that a text matches."""
    return F.coalesce(*[F.when(text.rlike(row[-1]), F.lit(k)) for k, row in enumerate(table)])


def _named(place: Column, names) -> Column:
    return C.lookup(place, dict(enumerate(names)))


def _packages() -> Column:
    """Dependencies and development dependencies of a root manifest."""
    keys = lambda f: F.coalesce(F.json_object_keys(F.get_json_object("content", f"$.{f}")), F.array().cast("array<string>"))
    return F.when(F.col("path") == "package.json", F.concat(keys("dependencies"), keys("devDependencies")))


def _test_names() -> Column:
    return C.basename(F.col("path")).rlike(r"^test_.*\.py$|_test\.py$")


def _migration_folders() -> Column:
    """Folders of migrations above a file."""
    parts = F.split(C.directory(F.col("path")), "/")
    ends = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda k: F.lower(F.element_at(parts, k)).isin(*fixed.MIGRATION_DIRS))
    return F.transform(ends, lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def signals(files: DataFrame, repo: str = "repo_id") -> DataFrame:
    """What each file says to the detectors, a row a file, in one pass over the texts.

    log_place, handler_place: places in the tables of logging frameworks and of error handlers; printed, sentry, otel;
    routes of health checks; harness, gates: test frameworks by all marks and by those that gate changes; coverage;
    platform, test_gate, lint_gate of a CI file's commands; migrations, migration_test; hot and config.
    """
    path, text = F.col("path"), F.col("content")
    python, script = walked() & (_suffix() == ".py"), walked() & _suffix().isin(*SCRIPTS)
    actions, other = path.rlike(r"^\.github/workflows/[^/]+\.yml$"), path.isin(".gitlab-ci.yml", ".gitlab-ci.yaml")
    # only such files reach the reader of YAML
    runs = syntax.workflow_commands(F.when(actions, text)) if syntax.HAS_YAML else repos.workflow_runs(text)
    jobs = syntax.script_commands(F.when(other, text)) if syntax.HAS_YAML else parse.groups(text, r"(?m)^\s+-\s+([^\n]+)$")
    rows = files.select(repo, "path", "content", F.when(actions, runs).alias("_runs"), F.when(other, jobs).alias("_jobs"))

    matches = lambda commands, pattern: F.coalesce(F.exists(commands, lambda c: c.rlike(pattern)), F.lit(False))
    none = F.array().cast("array<string>")
    packages = lambda names: F.coalesce(F.transform(F.filter(_packages(), lambda d: d.isin(*names)), lambda d: F.regexp_replace(d, "@playwright/test", "playwright")), none)
    by_name = path.isin(*fixed.PYTEST_FILES) | _test_names()
    marks = F.array(
        F.when(by_name | (python & text.rlike(fixed.TEST_IMPORTS["pytest"])), "pytest"), F.when(python & text.rlike(fixed.TEST_IMPORTS["unittest"]), "unittest"), F.when(script & text.rlike(r"""from\s+['"]vitest['"]"""), "vitest")
    )
    traced = {name: (python & text.rlike(py)) | (script & text.rlike(js)) for name, (py, js) in fixed.TRACING.items()}
    return rows.select(
        repo, "path",
        F.when(python, _first(fixed.PYTHON_LOGGING, text)).when(script, _first(fixed.SCRIPT_LOGGING, text) + len(fixed.PYTHON_LOGGING)).alias("log_place"), (python & text.rlike(r"\bprint\s*\(")).alias("printed"),
        F.when(python, _first(fixed.ERROR_HANDLERS, text)).alias("handler_place"), F.when(python | script, F.array_distinct(F.concat(*[parse.groups(text, p) for p in fixed.HEALTH_ROUTES]))).alias("routes"),
        *(hit.alias(name) for name, hit in traced.items()), F.array_compact(F.concat(marks, packages(fixed.SCRIPT_TEST_PACKAGES))).alias("harness"),
        F.array_compact(F.concat(F.array(F.when(by_name, "pytest")), packages(fixed.SCRIPT_TEST_PACKAGES[:5]))).alias("gates"), path.isin(*fixed.COVERAGE_FILES).alias("coverage"),
        F.when(actions, "github_actions").when(other, "gitlab_ci").alias("platform"), (matches(F.col("_runs"), fixed.TEST_COMMANDS) | matches(F.col("_jobs"), fixed.TEST_COMMANDS)).alias("test_gate"), matches(F.col("_runs"), fixed.LINT_COMMANDS).alias("lint_gate"),
        _migration_folders().alias("migrations"), (_test_names() & text.rlike(fixed.MIGRATION_WORDS)).alias("migration_test"), _hot_category().isNotNull().alias("hot"), _config_rule().isNotNull().alias("config"),
    )


def _config_rule() -> Column:
    """The rule that says that a file holds configuration: by name, else by a settings class or loading of the environment; null for none."""
    named = C.basename(F.col("path")).rlike(fixed.CONFIG_NAME)
    coded = (_suffix() == ".py") & (F.col("content").rlike(fixed.SETTINGS_CLASS) | F.col("content").rlike(fixed.ENV_LOAD))
    rule = F.when(named, "config_filename_pattern").when(coded, "settings_class_or_env_load")
    return F.when(walked() & _suffix().isin(".py", ".ts", ".js", ".toml", ".yaml", ".yml", ".json"), rule)


def config_files(files: DataFrame) -> DataFrame:
    """Files that hold configuration, with the rule that says so."""
    return files.withColumn("rule", _config_rule()).filter("rule is not null")


def _hot_category() -> Column:
    """What makes much depend on a file: code of authentication, else a hub of two routers or more; null for neither."""
    text = F.col("content")
    auth = C.basename(F.col("path")).rlike(fixed.AUTH_NAME) | text.rlike(fixed.AUTH_CODE)
    hub = (parse.count(text, fixed.ROUTE_HUB) >= 2) & ~F.contains(F.lower("path"), F.lit("test"))
    category = F.when(auth, "auth").when(hub, "route_hub")
    return F.when(walked() & _suffix().isin(".py", ".ts", ".js"), category)


def hotspots(files: DataFrame) -> DataFrame:
    """Files that much depends on, with their category."""
    return files.withColumn("category", _hot_category()).filter("category is not null")


def merged_evidence(evidence: DataFrame, group: list[str], lists: list[str], flags: list[str]) -> DataFrame:
    """Evidence rows of a group as one: sorted sets of what the lists hold, and whether any row has each flag."""
    sets = []
    for c in lists:
        one = evidence.select(*group, F.explode_outer(c).alias(c)).groupBy(*group).agg(F.array_sort(F.collect_set(c)).alias(c))
        sets.append(one)
    return reduce(lambda a, b: a.join(b, group), sets, evidence.groupBy(*group).agg(*(F.bool_or(f).alias(f) for f in flags)))


def summary(files: DataFrame, repo: str = "repo_id") -> DataFrame:
    """One row a repository with what the debug and change sections ask of it: one pass over the files and one exchange."""
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    rows = signals(files, repo).groupBy(repo).agg(
        F.min("log_place").alias("_log"), some("printed").alias("_printed"), F.min("handler_place").alias("_handler"), every("routes").alias("routes"), *(some(name).alias(name) for name in fixed.TRACING), every("harness").alias("frameworks"), some("coverage").alias("has_coverage"),
        F.array_sort(F.collect_set("platform")).alias("platforms"), some("test_gate").alias("has_test_gate"), some("lint_gate").alias("has_lint_gate"), every("migrations").alias("migration_paths"), some("migration_test").alias("has_migration_tests"), F.count_if("hot").alias("hotspots"), F.count_if("config").alias("config_files"),
        every("gates").alias("gate_frameworks"),
    )
    names = [x[0] for x in (*fixed.PYTHON_LOGGING, *fixed.SCRIPT_LOGGING)]
    handler = lambda k: _named(F.col("_handler"), [x[k] for x in fixed.ERROR_HANDLERS])
    return rows.select("*", _named(F.col("_log"), names).alias("framework"), (F.col("_log").isNull() & F.col("_printed")).alias("print_only"), handler(0).alias("handler_framework"), handler(1).alias("handler_type")).drop("_log", "_printed", "_handler")
