"""Static review: penalties with decay and caps, depth caps, bands, dedupe of findings, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed
from ..functions import columns as C


def dedupe_findings(findings: DataFrame, group: list[str], key: Column, order: str) -> DataFrame:
    """The best row of each key: lowest severity rank, then surest, then first."""
    w = Window.partitionBy(*group, "_key").orderBy(C.lookup(F.col("severity"), fixed.SEVERITY_RANK, 9), C.lookup(F.col("confidence"), fixed.CONFIDENCE_RANK, 9), order)
    return findings.withColumn("_key", key).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_key")


def finding_key() -> Column:
    """rule_id, or for tool findings with a file rule, file and the start of the evidence."""
    return F.when((F.col("layer") == "adapter") & (F.col("file") != ""), F.concat_ws("::", "rule_id", "file", F.left(F.coalesce("evidence", F.lit("")), F.lit(30)))).otherwise(F.col("rule_id"))


def domain_penalties(impacts: DataFrame, group: list[str]) -> DataFrame:
    """impacts (group, domain, rule_id, severity, impact <= 0) to (group, domain, penalty).

    Penalties of a rule count in full, then a half, a quarter and a tenth, at most the cluster cap; a domain at most its
    cap. Only the first three of a rule need an order; the rest weigh the same, so a rule with a third of all rows is
    summed by partial aggregates and its three largest by a top-k, not sorted in one task.
    """
    rows = impacts.filter("impact < 0").withColumn("p", F.abs("impact") * C.lookup(F.col("severity"), fixed.SEVERITY_WEIGHT, 0.7))
    keys = [*group, "domain", "rule_id"]
    by_value = rows.groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("p"))
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # how many of n equal penalties fall on each of the places 1, 2, 3 and later
    spans = [(0, 1, fixed.DECAY[0]), (1, 2, fixed.DECAY[1]), (2, 3, fixed.DECAY[2])]
    weight = sum((F.when((F.col("b") < hi) & (F.col("b") + F.col("n") > lo), F.lit(d)).otherwise(0.0) for lo, hi, d in spans), F.lit(0.0))
    late = F.greatest(F.lit(0), F.col("b") + F.col("n") - F.greatest(F.col("b"), F.lit(3))) * fixed.DECAY[3]
    clusters = by_value.withColumn("b", before).groupBy(*keys).agg(F.least(F.sum(F.col("p") * (weight + late)), F.lit(float(fixed.CLUSTER_CAP))).alias("c"))
    return clusters.groupBy(*group, "domain").agg(F.least(F.sum("c"), F.lit(float(fixed.DOMAIN_CAP))).alias("penalty"))


def domain_scores(items: DataFrame, penalties: DataFrame, counts: DataFrame, group: list[str], depth: str = "structural_only") -> DataFrame:
    """One row an item: each domain's score, capped by depth where it has no finding, the overall score and its band.

    counts: (group, domain, n) findings by domain.
    """
    domains = list(fixed.REVIEW_WEIGHTS)
    p = penalties.groupBy(*group).agg(*(F.max(F.when(F.col("domain") == d, F.col("penalty"))).alias(f"_p_{d}") for d in domains))
    n = counts.groupBy(*group).agg(*(F.max(F.when(F.col("domain") == d, F.col("n"))).alias(f"_n_{d}") for d in domains))
    rows = items.select(*group).join(p, group, "left").join(n, group, "left")
    caps = fixed.DEPTH_CAPS[depth]
    for d in domains:
        raw = F.greatest(F.lit(0), 100 - F.floor(F.bround(F.coalesce(F.col(f"_p_{d}"), F.lit(0.0)), 9)).cast("int"))
        rows = rows.withColumn(d, F.when(F.coalesce(F.col(f"_n_{d}"), F.lit(0)) > 0, raw).otherwise(F.least(raw, F.lit(caps.get(d, 100)))))
    overall = F.floor(sum((F.col(d) * w for d, w in fixed.REVIEW_WEIGHTS.items()), F.lit(0)) / 100).cast("int")
    rows = rows.withColumn("overall", overall)
    return rows.select(*group, *domains, "overall", C.band(F.col("overall"), fixed.REVIEW_BANDS).alias("recommendation"))


def band_join(scores: DataFrame, bands: DataFrame, score: str) -> DataFrame:
    """Range join to a small table of bands (lo, hi, label)."""
    return scores.join(F.broadcast(bands), F.col(score).between(F.col("lo"), F.col("hi")), "left").drop("lo", "hi")


def production_suitable() -> Column:
    return F.col("recommendation").isin("strong", "solid") & (F.col("security") >= 65) & (F.col("testing") >= 50)


def confidence_badge(sources: Column, files: Column, languages: Column, tools: Column, framework: Column) -> Column:
    """How sure a review is of itself, of a repository's facts.

    languages: those detected; tools: (name, status) of each tool; framework: confidence of its detection. A quarter
    each: the share of files that are sources, of languages that have rules (0.3 if none was detected), of tools that
    ran (0.6 if there is none), and framework. The label goes by the sum before it is rounded.
    """
    low = F.array_distinct(F.transform(F.coalesce(languages, F.array().cast("array<string>")), lambda x: F.lower(x)))
    supported = F.size(F.array_intersect(low, C.strings(fixed.RULE_PACKS)))
    ran = F.filter(tools, lambda t: t["status"] == "success")
    covered = F.least(sources / F.greatest(files, F.lit(1)), F.lit(1.0))
    spoken = F.when(F.size(low) > 0, supported / F.size(low)).otherwise(0.3)
    worked = F.when(F.size(tools) > 0, F.size(ran) / F.greatest(F.size(tools), F.lit(1)) * 0.25).otherwise(0.15)
    score = covered * 0.25 + spoken * 0.25 + worked + framework * 0.25
    label = F.when(score >= 0.75, "High").when(score >= 0.50, "Medium").otherwise("Low")
    return F.struct(
        label.alias("label"), C.rounded(score, 2).alias("score"), (supported + 1).alias("rule_packs_applied"), F.size(ran).alias("tools_succeeded"), (F.size(tools) - F.size(ran)).alias("tools_failed"),
        C.rounded(covered, 2).alias("coverage_pct"), C.rounded(framework, 2).alias("framework_confidence"), F.transform(ran, lambda t: t["tool"]).alias("succeeded_tools"),
    )


def depth_of(tools: Column) -> Column:
    """Analysis depth by the kinds of tools that ran."""
    any_of = lambda *names: F.arrays_overlap(tools, C.strings(names))
    lint, safe, deps = any_of("ruff", "eslint"), any_of("bandit", "semgrep", "gitleaks", "secret_patterns"), any_of("pip_audit", "npm_audit", "pip-audit", "npm-audit")
    return F.when((lint | safe) & deps, "full_toolchain").when(safe, "security_augmented").when(lint, "lint_augmented").otherwise("structural_only")


def _of_status(tools: Column, status: str) -> Column:
    return F.filter(tools, lambda t: t["status"] == status)


def coverage(source: Column, total: Column, languages: Column, dockerfile: Column, actions: Column, tools: Column) -> Column:
    """struct(repo_files_scanned_pct, language_support_pct, tools, limits): what a review could see, and what not.

    tools: array of (tool, status, issues, seconds, error), in their order; errors are cut to 120 characters, empty ones null.
    """
    timed_out, missing = (F.transform(_of_status(tools, status), lambda t: t["tool"]) for status in ("timeout", "tool_not_found"))
    records = F.transform(tools, lambda t: F.struct(t["tool"].alias("tool"), t["status"].alias("status"), t["issues"].alias("issues_found"), t["seconds"].alias("duration_seconds"), F.nullif(F.left(F.coalesce(t["error"], F.lit("")), F.lit(120)), F.lit("")).alias("error_summary")))
    low = F.array_distinct(F.transform(languages, lambda x: F.lower(x)))
    known = C.strings(fixed.RULE_LANGUAGES)
    share = lambda a, b: C.rounded(F.least(a / F.greatest(b, F.lit(1)), F.lit(1.0)), 2)
    others = F.array_sort(F.array_except(low, known))
    named = lambda xs, before, after: F.when(F.size(xs) > 0, F.concat(F.lit(before), F.array_join(xs, ", "), F.lit(after)))
    limits = F.array(
        F.lit("Runtime execution not performed"), F.when(~dockerfile, F.lit("No Dockerfile found — container security checks skipped")), F.when(~actions, F.lit("No GitHub Actions workflows found — CI hygiene checks limited")),
        named(others, "Unsupported language(s) detected: ", " — no rule pack available"), named(timed_out, "Tool(s) timed out: ", " — findings may be incomplete"), named(missing, "Tool(s) not installed: ", " — relevant checks skipped"),
        F.lit("Dependency vulnerabilities reflect available lockfiles only"), F.lit("Generated files and vendor directories excluded from analysis"),
    )
    return F.struct(share(source, total).alias("repo_files_scanned_pct"), share(F.size(F.array_intersect(low, known)), F.size(low)).alias("language_support_pct"), records.alias("tools"), F.array_compact(limits).alias("limits"))


def anti_gaming(findings: DataFrame, group: list[str]) -> DataFrame:
    """(group, gaming, hard, verdict, signals) of findings (group, rule_id, severity): presentation against substance."""
    gaming = F.col("rule_id").isin(*fixed.GAMING_SIGNALS)
    hard = F.col("severity").isin("critical", "high") & ~gaming
    signals = F.array_sort(F.collect_set(C.lookup(F.col("rule_id"), fixed.GAMING_SIGNALS)))
    rows = findings.groupBy(*group).agg(F.count_if(gaming).alias("gaming"), F.count_if(hard).alias("hard"), signals.alias("signals"))
    verdict = F.when((F.col("gaming") == 0) & (F.col("hard") <= 1), "likely_honest").when(F.col("gaming") >= 2, "surface_polish").otherwise("inconclusive")
    return rows.withColumn("verdict", verdict)


def readiness(security: Column, testing: Column, rules: Column, worst_security: Column, critical: Column) -> Column:
    """At most three reasons why a repository is not fit for production.

    rules: ids of its findings; worst_security: title of its worst finding that costs security; critical: titles of
    critical findings, in order.
    """
    safe = F.when(security < 65, F.concat(F.lit("Security score is "), security.cast("string"), F.lit("/100"), F.coalesce(F.concat(F.lit(": "), worst_security), F.lit(""))))
    has = lambda r: F.array_contains(rules, r)
    why = F.when(has("TESTING-001"), F.lit("No test files detected — regressions cannot be validated")).when(has("TEST-CI-001"), F.lit("Tests exist but are not executed in CI — manual-only validation")).otherwise(F.concat(F.lit("Testing score is "), testing.cast("string"), F.lit("/100 — coverage is insufficient")))
    grave = F.transform(F.slice(critical, 1, 2), lambda t: F.concat(F.lit("Critical finding: "), t))
    return F.slice(F.array_distinct(F.array_compact(F.concat(F.array(safe, F.when(testing < 50, why)), grave))), 1, 3)


def flip_actions(findings: DataFrame, scores: DataFrame, group: list[str], order: str) -> DataFrame:
    """(group, actions): at most three fixes that would move a repository toward production.

    findings: (group, rule_id, severity, fix, security_impact: null or points, order); scores: (group, security,
    testing). First the fix of the critical finding whose rule sorts first; where security is below 65, that of the
    high finding that costs it most; where testing is below 50, that of the rule of no tests, else of tests that are
    not run; then high findings' fixes in order, without those named. A repository's high findings are thinned to three
    within tasks.
    """
    c = F.col
    first = lambda when, fix, by: F.min_by(F.when(when, fix), F.when(when, by))
    last = lambda rule: F.max_by(F.when(c("rule_id") == rule, c("fix")), F.when(c("rule_id") == rule, c(order)))
    high = c("severity") == "high"
    named = findings.groupBy(*group).agg(
        first(c("severity") == "critical", c("fix"), F.struct("rule_id", order)).alias("_critical"), first(high & (c("security_impact") < 0), c("fix"), F.struct("security_impact", order)).alias("_security"),
        last("TESTING-001").alias("_none"), last("TEST-CI-001").alias("_unrun"),
    )
    rows = scores.join(named, group, "left")
    chosen = F.array_compact(F.array(c("_critical"), F.when(c("security") < 65, c("_security")), F.when(c("testing") < 50, F.coalesce("_none", "_unrun"))))
    rows = rows.select(*group, chosen.alias("_named"))
    others = findings.filter(high).join(rows, group).filter(~F.array_contains("_named", c("fix")))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(order))
    others = others.select(*group, "fix", place.alias("_n")).filter(c("_n") <= 3).groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "fix"))), lambda x: x["fix"]).alias("_more"))
    more = F.coalesce("_more", F.array().cast("array<string>"))
    return rows.join(others, group, "left").select(*group, F.slice(F.concat("_named", more), 1, 3).alias("actions"))


def top_concern(findings: DataFrame, group: list[str], order: str) -> DataFrame:
    """The first critical, else the first high finding's title."""
    rank = C.lookup(F.col("severity"), fixed.SEVERITY_RANK, 9)
    return findings.filter(rank <= 1).groupBy(*group).agg(F.min_by("title", F.struct(rank.alias("a"), F.col(order).alias("b"))).alias("top_concern"))


def priority_actions(findings: DataFrame, group: list[str], order: str, n: int = 5) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(C.lookup(F.col("severity"), fixed.SEVERITY_RANK, 9), order)
    return findings.filter(F.col("severity").isin("critical", "high")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
