"""Sources and sinks: repository trees, file contents, tool output, stored results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed
from ..functions import columns as C, parse

#: JSON that each tool prints, by its schema.
TOOL_SCHEMAS = {
    "ruff": "array<struct<code:string, message:string, filename:string, location:struct<row:int>>>",
    "bandit": "struct<results:array<struct<test_id:string, issue_text:string, filename:string, line_number:int, issue_severity:string, issue_confidence:string>>>",
    "gitleaks": "array<struct<RuleID:string, Description:string, File:string, StartLine:int>>",
    "eslint": "array<struct<filePath:string, messages:array<struct<ruleId:string, message:string, line:int, severity:int>>>>",
    "hadolint": "array<struct<code:string, message:string, file:string, line:int, level:string>>",
    "npm-audit": "struct<vulnerabilities:map<string, struct<severity:string>>>",
    "pip-audit": "struct<dependencies:array<struct<name:string, version:string, vulns:array<struct<id:string, description:string>>>>>",
}


def checkout(spark: SparkSession, path: str) -> DataFrame:
    """Files of a checkout (path, size, content, lines), without pruned directories."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + re.escape(path.rstrip("/")) + "/", "")
    rows = raw.select(rel.alias("path"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("content"))
    return rows.filter(~C.should_skip(F.col("path"))).withColumn("lines", F.size(parse.text_lines(F.col("content"))))


def decoded(content: Column) -> Column:
    """A file's text from base64 with line breaks."""
    return F.decode(F.unbase64(F.regexp_replace(content, r"\s", "")), "UTF-8")


def with_fetch_errors(tree: DataFrame, contents: DataFrame, on: list[str]) -> DataFrame:
    """Every file of a tree; those without content have an error and confidence 0."""
    rows = tree.join(contents, on, "left")
    lost = F.col("content").isNull()
    return rows.withColumn("fetch_error", lost).withColumn("confidence", F.when(lost, 0.0).otherwise(1.0))


def priority_files(files: DataFrame, names: list[str], depth: int = 2) -> DataFrame:
    return files.filter(C.basename(F.col("path")).isin(*names) & (F.size(C.parts(F.col("path"))) - 1 <= depth))


def candidates(github: DataFrame, gitlab: DataFrame) -> DataFrame:
    """Both platforms' search results as one table."""
    return github.withColumn("platform", F.lit("github")).unionByName(gitlab.select(F.col("path_with_namespace").alias("full_name"), F.col("star_count").alias("stars"), F.col("forks_count").alias("forks"), F.col("last_activity_at").alias("updated_at"), F.col("readme_url").isNotNull().alias("readme_verified"), "description", "topics").withColumn("platform", F.lit("gitlab")), allowMissingColumns=True)


def _severity(tool: str) -> Column:
    """An issue's severity by its tool's fixed tables, from code, message and what the tool says (said)."""
    code, said = F.col("code"), F.col("said")
    return {
        "ruff": C.lookup(code, fixed.RUFF_SEVERITY, "low"),
        "bandit": C.lookup(F.upper(said), fixed.BANDIT_SEVERITY, "medium"),
        "eslint": F.coalesce(C.lookup(code, fixed.ESLINT_RULES), C.lookup(said.cast("int"), fixed.ESLINT_LEVELS, "medium")),
        "gitleaks": F.when(code.isin(*fixed.GITLEAKS_HIGH), "high").otherwise("critical"),
        "hadolint": C.lookup(F.lower(said), fixed.HADOLINT_SEVERITY, "medium"),
        "pip-audit": F.when(F.lower("message").rlike("|".join(fixed.CVE_HIGH)), "high").otherwise("medium"),
        "npm-audit": F.lower(said),
    }[tool]


#: By tool: the path of its issues in its JSON j, and expressions for code, message, file, line and what an issue i says of severity.
TOOL_FIELDS = {
    "ruff": ("j", "i.code", "i.message", "i.filename", "i.location.row", "cast(null as string)"),
    "bandit": ("j.results", "i.test_id", "i.issue_text", "i.filename", "i.line_number", "concat_ws('/', i.issue_severity, i.issue_confidence)"),
    "eslint": ("flatten(transform(j, f -> transform(f.messages, m -> struct(m.ruleId, m.message, f.filePath, m.line, m.severity))))", "i.ruleId", "i.message", "i.filePath", "i.line", "cast(i.severity as string)"),
    "gitleaks": ("j", "i.RuleID", "i.Description", "i.File", "i.StartLine", "cast(null as string)"),
    "hadolint": ("j", "i.code", "i.message", "i.file", "i.line", "i.level"),
    "pip-audit": ("flatten(transform(j.dependencies, d -> transform(d.vulns, v -> struct(v.id, v.description, d.name))))", "i.id", "i.description", "i.name", "null", "cast(null as string)"),
    "npm-audit": ("transform(map_entries(j.vulnerabilities), e -> struct(e.key as name, e.value.severity as severity))", "i.name", "i.name", "'package.json'", "null", "i.severity"),
}


def _issues_of(tool: str, j: str) -> Column:
    """Issues in a tool's parsed JSON, a column named j, as structs that are alike for all tools."""
    path, code, message, file, line, said = TOOL_FIELDS[tool]
    return F.expr(f"transform({re.sub(r'\bj\b', j, path)}, i -> named_struct('code', {code}, 'message', {message}, 'file', {file}, 'line', cast({line} as int), 'said', {said}))")


def all_issues(raw: DataFrame, key: str = "repo_id", text: str = "raw_json", tool: str = "tool") -> DataFrame:
    """(key, tool, code, message, file, line, severity) of rows (key, tool, text), each read by its tool's adapter in one pass; malformed JSON and unknown tools have none."""
    parsed = [F.when(F.col(tool) == name, F.from_json(text, TOOL_SCHEMAS[name])).alias(f"j{k}") for k, name in enumerate(TOOL_FIELDS)]
    issues = raw.select(key, F.col(tool).alias("tool"), *parsed).select(key, "tool", F.explode(F.coalesce(*(_issues_of(name, f"j{k}") for k, name in enumerate(TOOL_FIELDS)))).alias("i")).select(key, "tool", "i.*")
    severity = F.coalesce(*(F.when(F.col("tool") == name, _severity(name)) for name in TOOL_FIELDS))
    return issues.select(key, "tool", "code", "message", "file", "line", severity.alias("severity"))


def tool_issues(raw: DataFrame, tool: str, key: str = "repo_id", text: str = "raw_json") -> DataFrame:
    """The same of rows that are all of one tool."""
    return all_issues(raw.withColumn("tool", F.lit(tool)), key, text)


def adapters_for(languages: Column) -> Column:
    """Tools that apply to a repository's languages, in the order of the registry."""
    of = (("ruff", "python"), ("bandit", "python"), ("pip-audit", "python"), ("eslint", "typescript javascript"), ("npm-audit", "typescript javascript"), ("hadolint", "docker"))
    low = F.transform(languages, lambda x: F.lower(x))
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(low, C.strings(ls.split())), F.lit(t)) for t, ls in of], F.lit("gitleaks")))


def ruff_tags(code: Column) -> Column:
    """Tags by a code's prefix of letters, at most three, then by its first letter, each once."""
    table = {k: F.array(*map(F.lit, v)) for k, v in fixed.RUFF_TAGS.items()}
    of = lambda k: F.coalesce(*[F.when(k == name, tags) for name, tags in table.items()], F.array().cast("array<string>"))
    return F.array_distinct(F.concat(of(F.regexp_replace(F.left(code, F.lit(3)), r"[0-9]+$", "")), of(F.left(code, F.lit(1)))))


def save(tables: dict[str, DataFrame], root: str, key: str) -> None:
    """Writes a scan's tables, each partitioned by its result."""
    for name, df in tables.items():
        df.write.mode("append").partitionBy(key).parquet(f"{root}/{name}")


def load(spark: SparkSession, root: str, name: str, key: str, value) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}").filter(F.col(key) == value)


def encrypted(payload: Column, secret: Column) -> Column:
    return F.base64(F.aes_encrypt(F.to_json(payload), secret))


def decrypted(text: Column, secret: Column) -> Column:
    return F.decode(F.aes_decrypt(F.unbase64(text), secret), "UTF-8")


def report_markdown(reports: DataFrame, key: str) -> DataFrame:
    """(key, markdown): each review as a document: head, scorecard, findings by severity with evidence, priority actions.

    reports: (key, url, commit, ruleset, a column of each category, findings: array of (id, severity, title, summary,
    why, fix, evidence: array of texts), actions: array of texts).
    """
    head = F.concat(F.lit("# Codebase Review: "), F.col("url"), F.lit("\n> Commit: `"), F.col("commit"), F.lit("` · Ruleset: `"), F.col("ruleset"), F.lit("`\n\n## Scorecard\n| Category | Score |\n|---|---|"))
    scores = F.array(*(F.concat(F.lit(f"| {label} | "), F.col(c).cast("string"), F.lit(" |")) for label, c in fixed.REPORT_CATEGORIES))
    proof = lambda f: F.when(F.size(f["evidence"]) > 0, F.concat(F.lit("\n**Evidence:**"), F.array_join(F.transform(f["evidence"], lambda e: F.concat(F.lit("\n- `"), e, F.lit("`"))), ""))).otherwise("")
    one = lambda f: F.concat(F.lit("\n**"), f["title"], F.lit("** `"), f["id"], F.lit("`\n_"), f["summary"], F.lit("_\n**Why it matters:** "), f["why"], F.lit("\n**Fix:** "), f["fix"], proof(f))

    def group(severity: str) -> Column:
        rows = F.filter("findings", lambda f: f["severity"] == severity)
        return F.when(F.size(rows) > 0, F.concat(F.lit(f"\n### {severity.capitalize()}\n"), F.array_join(F.transform(rows, one), "\n")))

    groups = F.array_compact(F.array(*(group(s) for s in ("critical", "high", "medium", "low"))))
    actions = F.transform("actions", lambda a, i: F.concat((i + 1).cast("string"), F.lit(". "), a))
    parts = F.concat(F.array(head), scores, F.array(F.lit(""), F.lit("## Findings")), groups, F.array(F.lit(""), F.lit("## Priority Actions"), F.lit("")), actions)
    return reports.select(key, F.array_join(parts, "\n").alias("markdown"))


def report_json(reports: DataFrame, key: str) -> DataFrame:
    """(key, json): each review as an indented JSON text of all its columns, nulls written."""
    return reports.select(key, F.to_json(F.struct(*reports.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


def fresh_cache(cache: DataFrame, now: Column, days: int = 7) -> DataFrame:
    return cache.filter(F.col("written_at") > now - F.expr(f"INTERVAL {days} DAYS"))


def expired_cache(cache: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Entries that pruning deletes."""
    return cache.filter(F.col("written_at") <= now - F.expr(f"INTERVAL {days} DAYS"))
