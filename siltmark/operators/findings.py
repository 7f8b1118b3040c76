"""Line findings and the production scorecard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed
from ..functions import columns as C


def line_findings(texts: DataFrame, key: str = "doc_id", text: str = "text", patterns=fixed.LINE_PATTERNS, snippet: int = 300) -> DataFrame:
    """One row for each line that matches a pattern: (key, line, pattern, category, severity, points, snippet).

    Patterns are few and fixed, so each is an expression over a line and no join; texts that match none of them are
    dropped before they are cut into lines.
    """
    rows = texts.filter(reduce(lambda a, b: a | b, [F.col(text).rlike(p[1]) for p in patterns]))
    rows = rows.select(F.col(key), F.posexplode(C.lines(F.col(text))).alias("pos", "snippet"))
    hit = lambda p: F.when(F.col("snippet").rlike(p[1]), F.struct(*[F.lit(v).alias(n) for n, v in zip(("pattern", "category", "severity", "points"), (p[0], *p[2:]), strict=True)]))
    found = rows.withColumn("hits", F.array_compact(F.array(*map(hit, patterns)))).filter(F.size("hits") > 0)
    found = found.select(key, (F.col("pos") + 1).alias("line"), F.explode("hits").alias("h"), F.substring(F.trim("snippet"), 1, snippet).alias("snippet"))
    return found.select(key, "line", "h.pattern", "h.category", "h.severity", "h.points", "snippet")


def points_for(category: Column, severity: Column, pattern: Column | None = None) -> Column:
    """Points by pattern where it has its own, else by category and severity."""
    own = C.lookup(pattern, {p[0]: p[4] for p in fixed.LINE_PATTERNS}) if pattern is not None else F.lit(None).cast("int")
    table = {f"{c}/{s}": v for c, by in fixed.POINTS.items() for s, v in by.items()}
    return F.coalesce(own, C.lookup(F.concat_ws("/", category, severity), table, 0))


def severity_order(severity: Column) -> Column:
    return C.lookup(severity, fixed.SEVERITY_RANK, 9)


def ordered(findings: DataFrame, *ties: str) -> DataFrame:
    return findings.orderBy(severity_order(F.col("severity")), *ties)


def page(findings: DataFrame, order: list, limit: int, offset: int = 0, most: int = 500, **equal) -> DataFrame:
    """A page of rows whose columns have the given values, in order."""
    for name, value in equal.items():
        if value is not None:
            findings = findings.filter(F.col(name) == value)
    return findings.orderBy(*order).offset(offset).limit(min(limit, most))


def dimension_of(category: Column) -> Column:
    """The dimension that a category counts in; null for those that count in none."""
    return F.coalesce(C.lookup(category, fixed.DIMENSION_OF), F.when(category.isin(*fixed.DIMENSION_WEIGHTS), category))


def precise_sum(terms: list[Column]) -> Column:
    """Sum of doubles in their order with what each step loses added at the end, so that it rounds as the true sum does."""

    def step(a: Column, x: Column) -> Column:
        t = a["s"] + x
        lost = F.when(F.abs(a["s"]) >= F.abs(x), (a["s"] - t) + x).otherwise((x - t) + a["s"])
        return F.struct(t.alias("s"), (a["c"] + lost).alias("c"))

    return F.aggregate(F.array(*terms), F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c")), step, lambda a: a["s"] + a["c"])


def shrunk(raw: Column, confidence: Column, neutral: int = 50) -> Column:
    """A score drawn to neutral by what is not known, whole numbers toward zero."""
    return F.when(confidence >= 1.0, raw).otherwise(F.greatest(F.lit(0), (raw * confidence + neutral * (1.0 - confidence)).cast("int")))


def test_score(ratio: Column, sources: Column) -> Column:
    steps = C.tier(ratio, ((0.4, 95), (0.25, 80), (0.1, 60), (1e-12, 40), (-1.0, 10)))
    return F.when(sources == 0, 50).otherwise(steps)


def documentation_score(documented: Column, sources: Column, readme: Column) -> Column:
    share = (F.try_divide(documented, sources) * 80).cast("int")
    return F.when(sources == 0, 50).otherwise(F.least(F.lit(100), share + F.when(readme, 20).otherwise(0)))


def scan_confidence(scanned: Column, total: Column, mean_confidence: Column, tests: Column, entrypoints: Column, config: Column) -> Column:
    coverage = F.least(F.coalesce(F.try_divide(scanned, total), F.lit(0.0)), F.lit(1.0))
    bonus = F.when(tests, 0.04).otherwise(0.0) + F.when(entrypoints, 0.04).otherwise(0.0) + F.when(config, 0.02).otherwise(0.0)
    whole = coverage * 0.45 + F.coalesce(mean_confidence, F.lit(0.0)) * 0.40 + bonus
    return F.when(total == 0, 0.0).otherwise(F.least(F.lit(0.97), C.rounded(whole, 3)))


def scorecard(items: DataFrame, findings: DataFrame, key: str, confidence: Column) -> DataFrame:
    """One row an item, findings or none: dimension scores, shrunk by confidence, their weighted sum and its label.

    items: (key, test_score, documentation_score and what confidence needs); findings: (key, category, severity, points).
    """
    dims = [d for d in fixed.DIMENSION_WEIGHTS if d not in ("test_coverage", "documentation")]
    counted = findings.withColumn("dimension", dimension_of(F.col("category")))
    sums = [F.sum(F.when(F.col("dimension") == d, F.col("points")).otherwise(0)).alias(f"_{d}") for d in dims]
    severities = [F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("critical", "high", "medium", "low")]
    by_item = counted.groupBy(key).agg(*sums, *severities, F.count(F.lit(1)).alias("n_findings"))
    rows = items.join(by_item, key, "left").withColumn("confidence", confidence)
    for d in dims:
        raw = F.greatest(F.lit(0), 100 + F.coalesce(F.col(f"_{d}"), F.lit(0)))
        rows = rows.withColumn(d, shrunk(raw, F.col("confidence")).cast("int"))
    for d in ("test_coverage", "documentation"):
        source = "test_score" if d == "test_coverage" else "documentation_score"
        rows = rows.withColumn(d, shrunk(F.col(source), F.col("confidence")).cast("int"))
    composite = precise_sum([F.col(d) * F.lit(w) for d, w in fixed.DIMENSION_WEIGHTS.items()])
    rows = rows.withColumn("composite", F.bround(composite, 0).cast("int"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_findings", "n_critical", "n_high", "n_medium", "n_low")]
    return rows.select(key, *fixed.DIMENSION_WEIGHTS, "composite", C.band(F.col("composite"), fixed.COMPOSITE_BANDS).alias("label"), "confidence", *counts)


def compare_scores(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Deltas of two scorecards by item, and how many findings went, never below 0."""
    b, a = before.alias("b"), after.alias("a")
    deltas = [(F.col(f"a.{d}") - F.col(f"b.{d}")).alias(f"{d}_delta") for d in (*fixed.DIMENSION_WEIGHTS, "composite")]
    gone = [F.greatest(F.lit(0), F.col(f"b.{n}") - F.col(f"a.{n}")).alias(f"{n}_resolved") for n in ("n_findings", "n_critical", "n_high")]
    return b.join(a, key).select(key, *deltas, *gone)


def blended_confidence(extraction: Column, graph: Column, finding: Column) -> Column:
    """struct(overall, label) of three confidences."""
    overall = F.least(F.lit(0.97), C.rounded(0.40 * extraction + 0.35 * graph + 0.25 * finding, 3))
    return F.struct(overall.alias("overall"), F.when(overall >= 0.85, "High").when(overall >= 0.65, "Moderate").otherwise("Low").alias("label"))


def valid_findings(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined): evidence present, lines in order, points not above 0."""
    end = F.col("line_end") if "line_end" in findings.columns else F.col("line")
    good = (F.length(F.trim("snippet")) > 0) & (F.col("line") >= 1) & (end >= F.col("line")) & (F.col("points") <= 0)
    good = F.coalesce(good, F.lit(False))
    return findings.filter(good), findings.filter(~good)


def drop_known_ranges(new: DataFrame, known: DataFrame, order: str = "ordinal") -> DataFrame:
    """New findings whose exact (file, start, end) is not known yet, the first of each in order."""
    on = ["file", "line", "line_end"]
    fresh = new.join(known.select(*on).distinct(), on, "left_anti")
    return fresh.withColumn("_r", F.row_number().over(Window.partitionBy(*on).orderBy(order))).filter("_r = 1").drop("_r")


def mean_confidences(files: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """(key, extraction, finding): mean confidences of a result's files, 0 without any, and of its findings, 1 without any."""
    f = files.groupBy(key).agg(F.avg("confidence").alias("extraction"))
    g = findings.groupBy(key).agg(F.avg("confidence").alias("finding"))
    return f.join(g, key, "full").select(key, F.coalesce("extraction", F.lit(0.0)).alias("extraction"), F.coalesce("finding", F.lit(1.0)).alias("finding"))
