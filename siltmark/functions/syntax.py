"""What only a parser can read off a file: Python by its syntax tree, YAML by its structure. Both run on Arrow batches, a file a call."""

from __future__ import annotations

import ast
import re
from importlib.util import find_spec

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .. import fixed

REFERENCES = T.ArrayType(T.StructType([T.StructField("rule", T.StringType()), T.StructField("name", T.StringType())]))
SERVICES = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("image", T.StringType())]))
#: What nests in a line's beginning.
INDENT = re.compile("(?:^|[\r\n\x85\u2028\u2029])[ ?-]*")
#: Without a YAML library no file has structure; callers fall back to patterns.
HAS_YAML = find_spec("yaml") is not None


def getenv_names(source: str) -> list[str]:
    """First arguments of os.getenv calls that are written as texts; none where the source is not Python."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    calls = (n for n in ast.walk(tree) if isinstance(n, ast.Call) and n.args and isinstance(n.func, ast.Attribute) and n.func.attr == "getenv")
    first = [c.args[0] for c in calls if isinstance(c.func.value, ast.Name) and c.func.value.id == "os"]
    return [a.value for a in first if isinstance(a, ast.Constant) and isinstance(a.value, str)]


@F.pandas_udf(REFERENCES)
def python_env_references(text: pd.Series) -> pd.Series:
    """(rule, name) of a Python source's references to the environment: calls by the syntax tree, subscripts by pattern."""
    bracket = re.compile(fixed.ENVIRON_BRACKET)

    def read(source):
        source = source or ""
        return [{"rule": "python_os_getenv", "name": n} for n in getenv_names(source)] + [{"rule": "python_os_environ_bracket", "name": n} for n in bracket.findall(source)]

    return text.map(read)


def script_env_references(text: Column) -> Column:
    """(rule, name) of a script's references to the environment, by pattern."""
    names = F.regexp_extract_all(text, F.lit(fixed.PROCESS_ENV), F.lit(0))
    name = lambda x: F.regexp_replace(x, r"^process\.env(\.|\[.)|[^A-Z0-9_]+$", "")
    return F.transform(names, lambda x: F.struct(F.lit("ts_process_env").alias("rule"), name(x).alias("name")))


def env_references(extension: Column, text: Column) -> Column:
    """References of a file to the environment, by its extension; none for other files."""
    scripts = F.when(extension.isin(*fixed.SCRIPT_EXTENSIONS), script_env_references(text))
    return F.coalesce(F.when(extension == ".py", python_env_references(F.when(extension == ".py", text))), scripts, F.array().cast("array<struct<rule:string,name:string>>"))


def _shallow(text: str) -> bool:
    """Whether no part of a YAML text can lie deep. A deep one ends the parser in C, and with it the worker; the one in Python only raises."""
    return 2 * max(map(len, INDENT.findall(text))) + text.count("[") + text.count("{") <= 150


def _document(text: str | None):
    import yaml

    try:
        return yaml.load(text or "", getattr(yaml, "CSafeLoader", yaml.SafeLoader) if _shallow(text or "") else yaml.SafeLoader)
    except (yaml.YAMLError, ValueError, RecursionError):
        return None


def _each(texts: pd.Series, read) -> pd.Series:
    """What is read of each text's structure; equal texts of a batch are read once."""
    known: dict = {}

    def of(x):
        if x not in known:
            known[x] = read(_document(x))
        return known[x]

    return texts.map(of)


def _steps(data) -> list[str]:
    jobs = data.get("jobs") if isinstance(data, dict) else None
    out = []
    for job in (jobs.values() if isinstance(jobs, dict) else ()):
        for step in (job.get("steps") or () if isinstance(job, dict) else ()):
            if isinstance(step, dict) and isinstance(step.get("run", ""), str) and "run" in step:
                out.append(step["run"])
    return out


def _scripts(data) -> list[str]:
    jobs = data.values() if isinstance(data, dict) else ()
    return [c for job in jobs if isinstance(job, dict) for c in (job.get("script") or ()) if isinstance(c, str)]


def _services(data) -> list[dict]:
    block = data.get("services", {}) if isinstance(data, dict) else {}
    image = lambda c: c.get("image", "") if isinstance(c, dict) else ""
    return [{"name": str(n), "image": str(image(c) or "")} for n, c in block.items()] if isinstance(block, dict) else []


@F.pandas_udf(T.ArrayType(T.StringType()))
def workflow_commands(text: pd.Series) -> pd.Series:
    """Commands of all steps of a workflow's jobs, in order; a malformed text has none."""
    return _each(text, _steps)


@F.pandas_udf(T.ArrayType(T.StringType()))
def script_commands(text: pd.Series) -> pd.Series:
    """Commands of all jobs of the other platform's file: entries of each script list, or the characters of a script that is one text."""
    return _each(text, _scripts)


@F.pandas_udf(SERVICES)
def compose_services(text: pd.Series) -> pd.Series:
    """(name, image) of a compose file's services, in order; a malformed text has none."""
    return _each(text, _services)
