"""Access to stored scans: filters, flags, gates, reading paths, policies and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed
from ..functions import columns as C, parse
from . import prefix
from .cut import cut


def scannable(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files to scan, one row of counts): blobs that are neither skipped nor generated."""
    path = F.col("path")
    skipped, made = C.should_skip(path), C.is_generated(path)
    counts = files.filter("kind = 'blob'").agg(F.count_if(skipped).alias("skipped"), F.count_if(~skipped & made).alias("generated"), F.count_if(~skipped & ~made).alias("scannable"))
    return files.filter((F.col("kind") == "blob") & ~skipped & ~made), counts


def first_to_scan(files: DataFrame, n: int = 800, repo: list[str] | None = None) -> DataFrame:
    """The first n files of each repository in scan order: by rank of the role, then size, then path.

    Tasks leave out what is not among a repository's first n before anything is exchanged. Without repo, all rows are
    one repository's.
    """
    order = C.scan_priority(F.col("path"), F.col("kind"), F.col("size"))
    rows = files.withColumn("_o", order)
    if not repo:
        return rows.orderBy("_o.rank", "_o.step", "path").limit(n).drop("_o")
    place = F.row_number().over(Window.partitionBy(*repo).orderBy("_o.rank", "_o.step", "path"))
    return rows.withColumn("_n", place).filter(F.col("_n") <= n).drop("_o", "_n")


def within_budget(files: DataFrame, repo: list[str], order: list[str], size: str, budget: int, batch: int = 30) -> DataFrame:
    """files of the batches that are read before a repository's budget is spent, with their batch (from 0).

    Files are taken ``batch`` at a time in order, which has to tell a repository's files apart; reading stops after the
    batch whose bytes take the total above the budget. Two running sums, of files and then of batches, neither of which
    needs a repository in one task.
    """
    placed = prefix.before(files, repo, order, F.lit(1), "_at").withColumn("batch", F.floor(F.col("_at") / batch).cast("long")).drop("_at")
    placed = cut(placed)
    spent = placed.groupBy(*repo, "batch").agg(F.sum(F.coalesce(F.col(size), F.lit(0))).alias("_bytes"))
    spent = prefix.before(spent, repo, ["batch"], F.col("_bytes"), "_spent").filter(F.col("_spent") <= budget)
    return placed.join(spent.select(*repo, "batch"), [*repo, "batch"], "left_semi")


def with_flags(files: DataFrame) -> DataFrame:
    """files (path, content, framework_signals) with role, is_entrypoint, is_executable, is_test."""
    path = F.col("path")
    rows = files.withColumn("role", C.role(path, F.col("framework_signals")))
    return rows.withColumns({"is_entrypoint": parse.is_entrypoint(F.col("role"), path, F.col("framework_signals")), "is_executable": parse.is_executable(path, F.coalesce("content", F.lit(""))), "is_test": F.col("role") == "test"})


def unsuppressed(findings: DataFrame) -> DataFrame:
    return findings.filter(~F.coalesce("is_suppressed", F.lit(False)))


def by_role(files: DataFrame, role: str) -> DataFrame:
    return files.filter(F.col("role") == role)


def entrypoints(files: DataFrame) -> DataFrame:
    return files.filter("is_entrypoint")


def high_risk(files: DataFrame) -> DataFrame:
    return files.filter(F.size("sensitive_ops") > 0)


def critical(files: DataFrame, contexts: DataFrame, on: list[str]) -> DataFrame:
    return files.join(contexts.filter("is_on_critical_path"), on, "left_semi")


def needs_review(on_critical_path: Column, role: Column, loc: Column, n_sensitive: Column, complexity: Column, callers: Column) -> Column:
    """Whether a file is worth a closer review; the first test that applies decides."""
    risky = ((loc >= 50) & (n_sensitive > 0)) | (complexity >= 15) | (callers >= 3)
    return F.when(F.coalesce(on_critical_path, F.lit(False)), True).when(role.isin("test", "config", "migration", "infra"), False).otherwise(F.coalesce(risky, F.lit(False)))


def pick_paths(files: DataFrame, needles: list[str], path: str = "path") -> DataFrame:
    """Paths that hold any needle, whatever its case of the path, in order."""
    return files.filter(F.exists(C.strings(needles), lambda n: F.contains(F.lower(path), n))).orderBy(path)


def reading_path(entries: DataFrame, folders: DataFrame, allowed: DataFrame, group: list[str], n: int = 8) -> DataFrame:
    """(group, path, confidence, rank): entry points, then the folder map, then readmes and tests by path; each path once, first n.

    entries: (group, path, ordinal); folders: (group, path, ordinal); allowed: (group, path). Tests are taken only
    while fewer than n are before them, which the cut to n says too.
    """
    on = [*group, "path"]
    low = F.lower("path")
    rest = allowed.withColumn("confidence", F.when(F.endswith(low, F.lit("readme.md")), 0.7).when(F.contains(low, F.lit("test")), 0.64)).filter("confidence is not null")
    parts = [
        entries.join(allowed, on, "left_semi").select(*on, F.lit(0.92).alias("confidence"), F.lit(0).alias("s"), F.col("ordinal").cast("long").alias("o")),
        folders.join(allowed, on, "left_semi").select(*on, F.lit(0.78).alias("confidence"), F.lit(1).alias("s"), F.col("ordinal").cast("long").alias("o")),
        rest.select(*on, "confidence", F.lit(2).alias("s"), F.lit(0).cast("long").alias("o")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    once = rows.groupBy(*on).agg(F.min(F.struct("s", "o", "confidence")).alias("f"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("f.s", "f.o", "path"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= n).select(*on, F.col("f.confidence").alias("confidence"), "rank")


def claim_allowed(claim: Column, tier: Column) -> Column:
    """Whether an analysis of a tier may make a claim: some are open to all, some to verified ones, some to none; unknown ones to none."""
    return F.coalesce(claim.isin(*fixed.STATIC_CLAIMS) | ((tier == "verified") & claim.isin(*fixed.VERIFIED_CLAIMS)), F.lit(False))


def scope_for_plan(plan: Column, asked: Column) -> Column:
    """struct(scope, error): the scope that a plan gives a request, with the reason where it is not the one asked for."""
    may = lambda what: F.coalesce(C.lookup(F.lower(plan), {p: limits[what] for p, limits in fixed.PLAN_LIMITS.items()}), F.lit(False))
    error = F.when((asked == "private") & ~may("private"), "private_repos_not_allowed_on_free_plan").when((asked == "verified") & ~may("verified"), "verified_checks_not_allowed_on_plan")
    return F.struct(F.when(error.isNotNull(), "public").otherwise(asked).alias("scope"), error.alias("error"))


def daily_limit(plan: Column, kind: str) -> Column:
    """Analyses of a kind (public, private or checks) that a plan gives a day; -1 is no limit."""
    return C.lookup(F.lower(plan), {p: limits[f"daily_{kind}"] for p, limits in fixed.PLAN_LIMITS.items()}, 0)


def size_guard(files: DataFrame, repo: list[str], most_files: int = 50_000, most_bytes: int = 500 << 20) -> DataFrame:
    """(repo, problem) of repositories that are too large to review; version control's own folder does not count."""
    rows = files.filter(~F.array_contains(C.parts(F.col("path")), ".git"))
    held = rows.groupBy(*repo).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    many = F.lit(f"Repository has more than {most_files:,} files — too large to review")
    heavy = F.lit(f"Repository exceeds {most_bytes >> 20}MB size limit")
    return held.select(*repo, F.when(F.col("n") > most_files, many).when(F.col("bytes") > most_bytes, heavy).alias("problem")).filter("problem is not null")


def below(rows: DataFrame, prefix_: str | None, path: str = "path") -> DataFrame:
    """rows whose path begins so; all without a beginning."""
    return rows.filter(F.startswith(F.col(path), F.lit(prefix_))) if prefix_ else rows


def files_in_order(files: DataFrame) -> DataFrame:
    """Entry points, then files on a critical path, then the rest; each by callers, most first, then path."""
    group = F.when(F.col("is_entrypoint"), 0).when(F.col("is_on_critical_path"), 1).otherwise(2)
    return files.orderBy(group, F.desc("caller_count"), "path")


def of_org(rows: DataFrame, org) -> DataFrame:
    """Rows of one organisation; every accessor of a shared table begins with this, as Spark has no row policies."""
    return rows.filter(F.col("org_id") == F.lit(org))


def responses(rows: DataFrame, *fields: str) -> DataFrame:
    """Rows as one JSON text each."""
    return rows.select(F.to_json(F.struct(*fields)).alias("response"))


def stripped_json(text: Column, schema: str) -> Column:
    """A reply's JSON without code fences around it, null where it is none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.from_json(bare, schema, {"mode": "PERMISSIVE"})


def ungrounded(risk: Column, categories: Column, titles: Column) -> Column:
    """Whether a risk of over 20 characters shares no word with the categories' parts or the titles' words of over 4 letters."""
    words = F.split(F.lower(risk), r"\s+")
    parts = F.flatten(F.transform(categories, lambda c: F.split(c, "-")))
    long_ = F.filter(F.flatten(F.transform(titles, lambda t: F.split(F.lower(t), r"\s+"))), lambda w: F.length(w) > 4)
    return (F.length(risk) > 20) & ~F.arrays_overlap(words, F.concat(parts, long_))


def phase(status: Column) -> Column:
    return C.lookup(status, {"queued": "queue", "running": "analysis", "completed": "complete", "failed": "failed"}, "unknown")


def status_kind(status: Column, seconds: Column) -> Column:
    """What a job's status line says: waiting, collecting, slow, done with or without its seconds, failed, unavailable."""
    return F.when(status == "queued", "waiting").when(status == "running", F.when(seconds >= 90, "slow").otherwise("collecting")).when(status == "completed", F.when(seconds > 0, F.concat(F.lit("done in "), seconds.cast("string"))).otherwise("done")).when(status == "failed", "failed").otherwise("unavailable")


def duration(started: Column, ended: Column) -> Column:
    """Whole seconds, never below 0; 0 where either is unknown."""
    return F.coalesce(F.greatest(F.lit(0), F.unix_timestamp(ended) - F.unix_timestamp(started)), F.lit(0))


def get_or_create(known: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Known rows and, of wanted ones, the keys that none of them has, each once."""
    new = wanted.select(key).distinct().join(known, key, "left_anti")
    return known.withColumn("created", F.lit(False)).unionByName(new.withColumn("created", F.lit(True)), allowMissingColumns=True)


def first_of(tables: list[DataFrame], key: str) -> DataFrame:
    """The row of each key in the first table that has it."""
    rows = None
    for k, t in enumerate(tables):
        t = t.withColumn("_t", F.lit(k))
        rows = t if rows is None else rows.unionByName(t)
    best = Window.partitionBy(key).orderBy("_t")
    return rows.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r", "_t")


def repo_summary(files: DataFrame, repo: str = "repo_id", signals: int = 10, entries: int = 5, risky: int = 10) -> DataFrame:
    """(repo, primary_language, framework_signals, entrypoints, high_risk_files, total_files) of each repository.

    files: (repo, path, language, framework_signals, is_entrypoint, sensitive_ops), in order of their paths. The
    language is that of most files, "unknown" left out; signals come by how often they occur; equal counts by who
    appears first. Lists are cut within tasks, so a repository's files never meet in one.
    """
    on = [repo]
    by_count = lambda rows, c: rows.groupBy(repo, c).agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("o"))
    language = by_count(files.filter("language <> 'unknown'").withColumn("o", F.struct("path")), "language").groupBy(repo).agg(F.min_by("language", F.struct(-F.col("n"), F.col("o"))).alias("primary_language"))
    named = files.select(repo, "path", F.posexplode("framework_signals").alias("pos", "item")).withColumn("o", F.struct("path", "pos"))
    tops = {
        "framework_signals": (by_count(named, "item"), [F.desc("n"), F.col("o")], signals),
        "entrypoints": (files.filter("is_entrypoint").select(repo, F.col("path").alias("item")), [F.col("item")], entries),
        "high_risk_files": (files.filter(F.size("sensitive_ops") > 0).select(repo, F.col("path").alias("item")), [F.col("item")], risky),
    }
    out = files.groupBy(repo).agg(F.count(F.lit(1)).alias("total_files")).join(language, on, "left")
    out = out.withColumn("primary_language", F.coalesce("primary_language", F.lit("unknown")))
    for name, (rows, order, n) in tops.items():
        first = rows.withColumn("r", F.row_number().over(Window.partitionBy(repo).orderBy(*order))).filter(F.col("r") <= n)
        lists = first.groupBy(repo).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "item"))), lambda x: x["item"]).alias(name))
        out = out.join(lists, on, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def unfenced(text: Column) -> Column:
    """A reply without the fence that it begins with: its first line goes, and its last if that is a bare fence."""
    clean = F.regexp_replace(text, r"^\s+|\s+$", "")
    lines = F.split(clean, "\n")
    ends = F.trim(F.element_at(lines, -1)) == "```"
    inner = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - F.when(ends & (F.size(lines) > 1), 2).otherwise(1), F.lit(0)))
    return F.when(F.startswith(clean, F.lit("```")), F.array_join(inner, "\n")).otherwise(clean)


#: A model's finding as its JSON says it: numbers may be given as texts of digits.
_SAID = "struct<category:string, severity:string, line_start:string, line_end:string, evidence_snippet:string, title:string, explanation:string, remediation:string>"


def model_findings(replies: DataFrame, text: str, file: str) -> DataFrame:
    """The valid findings of replies, with replies' other columns, pos, and the finding's fields.

    A reply has to be a JSON array once its fence is gone; what is not an object, or lacks a field, has an unknown
    category or severity, lines out of order or below 1, or blank evidence, goes. The file is the one that was asked
    about; points are looked up, -2 where the table has none; confidence is 0.75 and the source llm_assisted. A number
    where a text belongs is read as its digits.
    """
    c = F.col
    bare = unfenced(c(text))
    rows = replies.withColumn("_said", F.when(F.startswith(F.trim(bare), F.lit("[")), F.transform(F.from_json(bare, "array<string>"), lambda x: F.from_json(x, _SAID))))
    # outer: else a filter on the whole parse is pushed down to the scan, and the parse is done there too
    rows = rows.select(*replies.columns, F.posexplode_outer("_said").alias("pos", "_f")).filter("_f is not null")
    line = lambda n: F.when(c(f"_f.{n}").rlike(r"^\s*\+?[0-9]+(\.0+)?\s*$"), F.trim(c(f"_f.{n}")).cast("double").cast("int"))
    known = c("_f.category").isin(*fixed.POINTS) & c("_f.severity").isin("low", "medium", "high", "critical")
    whole = c("_f.title").isNotNull() & c("_f.explanation").isNotNull() & (F.length(F.trim(c("_f.evidence_snippet"))) > 0)
    valid = known & whole & (line("line_start") >= 1) & (line("line_end") >= line("line_start"))
    points = F.coalesce(*(F.when(c("_f.category") == k, C.lookup(c("_f.severity"), by)) for k, by in fixed.POINTS.items()), F.lit(-2))
    return rows.filter(F.coalesce(valid, F.lit(False))).select(
        *(x for x in replies.columns if x != text), "pos", c(file).alias("file_path"), c("_f.category").alias("category"), c("_f.severity").alias("severity"), line("line_start").alias("line_start"), line("line_end").alias("line_end"),
        c("_f.evidence_snippet").alias("evidence_snippet"), c("_f.title").alias("title"), c("_f.explanation").alias("explanation"), c("_f.remediation").alias("remediation"), points.alias("score_impact"), F.lit(0.75).alias("confidence"), F.lit("llm_assisted").alias("source"),
    )
