"""Ranking of candidates: noise flags, quality, dedupe, blend, and its evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed
from ..functions import columns as C
from . import prefix

MIRROR = r"(?i)\b(mirror|clone|copy|backup|archived?)\b"


def age_days(ts: Column, now: Column) -> Column:
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(ts)) / 86400)


def noise_flags(is_fork: Column, is_archived: Column, is_template: Column, description: Column, full_name: Column, stars: Column, forks: Column) -> Column:
    blank = F.trim(F.coalesce(description, F.lit(""))) == ""
    mirror = F.when(~blank & description.rlike(MIRROR), True).when(F.lower(full_name).rlike(MIRROR), True)
    marks = [(is_fork, "fork"), (is_archived, "archived"), (is_template, "template"), (blank, "no description"), (mirror, "possible mirror"), ((F.coalesce(stars, F.lit(0)) < 5) & (F.coalesce(forks, F.lit(0)) < 2), "low traction")]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in marks]))


def excluded(is_archived: Column, flags: Column, stars: Column) -> Column:
    return F.coalesce(is_archived & (stars < 50), F.lit(False)) | (F.array_contains(flags, "fork") & (stars < 20))


def activity_points(updated_days: Column, created_days: Column) -> Column:
    recency = C.tier(-updated_days, ((-14, 10), (-30, 8), (-90, 5), (-365, 2), (-1e9, 0)))
    age = F.coalesce(created_days, F.lit(0))
    sustained = F.when((age > 365) & (updated_days <= 90), 5).when((age > 180) & (updated_days <= 30), 3).otherwise(0)
    return F.coalesce(F.least(recency + sustained, F.lit(15)), F.lit(0))


def quality(stars: Column, activity: Column, license_name: Column, readme_on_gitlab: Column, description: Column, n_topics: Column, forks: Column, open_issues: Column, flags: Column) -> Column:
    """Quality without relevance, at most 70. Penalties stop at 0 after each step."""
    s = C.tier(stars, fixed.STAR_TIERS) + activity
    s = s + F.when(license_name.isNotNull() & (license_name != "") & ~F.upper(license_name).isin("NOASSERTION", "OTHER"), 7).otherwise(0)
    s = s + F.when(readme_on_gitlab, 7).otherwise(0) + F.when(F.length(description) > 40, 3).otherwise(0) + F.when(n_topics >= 3, 3).otherwise(0)
    s = s + F.when(forks >= 500, 5).when(forks >= 50, 2).otherwise(0)
    ratio = open_issues / F.greatest(stars, F.lit(1))
    s = F.when((ratio > 0.5) & (stars >= 50), F.greatest(F.lit(0), s - 2)).when((ratio < 0.05) & (stars >= 100), s + 2).otherwise(s)
    for name, points in (("fork", 15), ("possible mirror", 10), ("no description", 5)):
        s = F.when(F.array_contains(flags, name), F.greatest(F.lit(0), s - points)).otherwise(s)
    return F.least(s, F.lit(70))


def signals(stars: Column, updated_days: Column, created_days: Column, license_name: Column, gitlab: Column, readme_verified: Column, forks: Column, open_issues: Column, flags: Column) -> Column:
    """What speaks for and against a candidate, in order, as (label, type, verified); type is good, warn or bad."""
    sign = lambda label, kind, verified=True: F.struct(label.alias("label"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), F.lit(verified).alias("verified"))
    days, age = updated_days, F.coalesce(created_days, F.lit(0))
    kept_up = ((age > 365) & (days <= 90)) | ((age > 180) & (days <= 30))
    ago = F.concat(days.cast("string"), F.lit("d ago"))
    licensed = license_name.isNotNull() & (license_name != "") & ~F.upper(license_name).isin("NOASSERTION", "OTHER")
    ratio = open_issues / F.greatest(stars, F.lit(1))
    flag = lambda name, label, kind: F.when(F.array_contains(flags, name), sign(F.lit(label), kind))
    return F.array_compact(F.array(
        sign(F.concat(F.lit("★ "), C.short_number(stars), F.lit(" stars")), F.when(stars >= 100, "good").when(stars >= 10, "warn").otherwise("bad")),
        F.when(days.isNull(), None).when(kept_up, sign(F.concat(F.lit("Active "), ago, F.lit(" ("), F.floor(age / 30).cast("string"), F.lit("mo track record)")), "good"))
        .when(days <= 365, sign(F.concat(F.lit("Updated "), ago), F.when(days <= 90, "good").otherwise("warn"))).otherwise(sign(F.concat(F.lit("Stale: ~"), F.floor(days / 365).cast("string"), F.lit("yr ago")), "bad")),
        F.when(licensed, sign(license_name, "good")).otherwise(sign(F.lit("No license"), "warn")),
        F.when(~gitlab, sign(F.lit("README (unverified)"), "warn", False)).when(readme_verified, sign(F.lit("README confirmed"), "good")).otherwise(sign(F.lit("No README found"), "warn")),
        F.when(forks >= 500, sign(F.concat(F.lit("⑂ "), C.short_number(forks), F.lit(" forks")), "good")),
        F.when((ratio > 0.5) & (stars >= 50), sign(F.concat(F.lit("High open issue ratio ("), open_issues.cast("string"), F.lit(" issues / "), stars.cast("string"), F.lit(" stars)")), "warn")).when((ratio < 0.05) & (stars >= 100), sign(F.lit("Low issue backlog"), "good")),
        flag("fork", "Is a fork", "bad"), flag("possible mirror", "Possible mirror/clone", "warn"), flag("no description", "No description", "bad"), flag("template", "Template repo", "warn"),
    ))


def keep_best(rows: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key in an order that has no ties."""
    w = Window.partitionBy("_key").orderBy(*order)
    return rows.withColumn("_key", key).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_key")


def fallback_relevance(quality_: Column, n_topic_matches: Column, n_term_matches: Column) -> Column:
    return F.least(quality_ + 8 * n_topic_matches + 5 * n_term_matches, F.lit(100))


def blend(quality_: Column, relevance: Column, weight: float = 0.4) -> Column:
    return F.least(F.bround(F.bround(weight * quality_ + (1 - weight) * relevance, 6), 0), F.lit(100)).cast("int")


def ranked(scored: DataFrame, query: str, score: str, tie: str) -> DataFrame:
    """scored with each row's rank among its query's, by falling score (a number), then tie; a pool of any size is ranked by ranges."""
    placed = prefix.before(scored.withColumn("_falling", -F.col(score)), [query], ["_falling", tie], F.lit(1), "_before")
    return placed.select(*scored.columns, (F.col("_before") + 1).cast("int").alias("rank"))


def evaluate(ranks: DataFrame, ideal: DataFrame, queries: DataFrame, query: str, item: str, k: int = 3) -> DataFrame:
    """(query, ndcg, precision) at k, by binary gain; a query with no ideal items has 1 of both. Divides by k throughout.

    ranks: (query, item, rank); ideal: (query, item).
    """
    gain = 1.0 / F.log2(F.col("rank") + 1.0)
    hits = ranks.filter(F.col("rank") <= k).join(ideal.select(query, item).distinct(), [query, item], "left_semi")
    got = hits.groupBy(query).agg(F.sum(gain).alias("dcg"), F.count(F.lit(1)).alias("n_hits"))
    n_ideal = ideal.select(query, item).distinct().groupBy(query).agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("n_ideal"))
    best = F.aggregate(F.sequence(F.lit(1), F.col("n_ideal").cast("int")), F.lit(0.0), lambda a, r: a + 1.0 / F.log2(r + 1.0))
    rows = queries.select(query).join(got, query, "left").join(n_ideal, query, "left")
    ndcg = F.when(F.col("n_ideal").isNull(), 1.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / best)
    return rows.select(query, ndcg.alias("ndcg"), F.when(F.col("n_ideal").isNull(), 1.0).otherwise(F.coalesce("n_hits", F.lit(0)) / F.lit(float(k))).alias("precision"))


def noise_failures(ranks: DataFrame, forbidden: DataFrame, query: str, item: str, k: int = 3) -> DataFrame:
    """Queries with a forbidden item among their first k."""
    return ranks.filter(F.col("rank") <= k).join(forbidden, [query, item], "left_semi").select(query).distinct()


def compare_runs(before: DataFrame, after: DataFrame, query: str) -> DataFrame:
    return before.alias("b").join(after.alias("a"), query).select(query, (F.col("a.ndcg") - F.col("b.ndcg")).alias("ndcg_delta"), (F.col("a.precision") - F.col("b.precision")).alias("precision_delta")).orderBy("ndcg_delta", query)


def gate(before: DataFrame, after: DataFrame, query: str, critical: DataFrame, failed_before: DataFrame, failed_after: DataFrame) -> DataFrame:
    """One row: whether the mean held (to 0.001), no critical query fell by over 0.15 and no new query fails the noise gate."""
    means = before.agg(F.avg("ndcg").alias("b")).crossJoin(after.agg(F.avg("ndcg").alias("a")))  # one row each
    falls = compare_runs(before, after, query).join(critical, query, "left_semi").agg(F.count_if(F.col("ndcg_delta") < -0.15).alias("falls"))
    new = failed_after.join(failed_before, query, "left_anti").agg(F.count(F.lit(1)).alias("new_failures"))
    rows = means.crossJoin(falls).crossJoin(new)
    return rows.select((F.col("a") >= F.col("b") - 0.001).alias("mean_held"), (F.col("falls") == 0).alias("critical_held"), (F.col("new_failures") == 0).alias("noise_held"))


def term_relevance(query: Column, description: Column, full_name: Column, topics: Column, stars: Column) -> Column:
    """Share of a query's words of over two letters that a candidate's texts hold, of 90, and up to 10 for stars."""
    words = F.filter(F.array_distinct(F.split(F.lower(F.trim(query)), r"\s+")), lambda w: F.length(w) > 2)
    text = F.lower(F.concat_ws(" ", F.coalesce(description, F.lit("")), F.coalesce(full_name, F.lit("")), F.array_join(topics, " ")))
    hits = F.size(F.filter(words, lambda w: F.contains(text, w)))
    share = (hits / F.greatest(F.size(words), F.lit(1)) * 90).cast("int")
    return F.least(share + F.least(F.lit(10), F.floor(F.coalesce(stars, F.lit(0)) / 5000)), F.lit(100)).cast("int")


def by_terms(rows: DataFrame) -> DataFrame:
    """The plain relevance of a candidate under a query: overlap of terms."""
    return rows.withColumn("relevance", term_relevance(F.col("query_text"), F.col("description"), F.col("full_name"), F.col("topics"), F.col("stars")))


#: What gives candidates under queries (query, query_text and the candidate's columns) their relevance, 0 to 100.
Relevance = Callable[[DataFrame], DataFrame]


def under_queries(candidates: DataFrame, queries: list[tuple[str, str]]) -> DataFrame:
    """Every candidate under every query of a pack (id, text). A pack is a parameter, so each row is repeated for it without a join."""
    pack = F.array(*[F.struct(F.lit(q).alias("query"), F.lit(t).alias("query_text")) for q, t in queries])
    return candidates.select("*", F.explode(pack).alias("_p")).select("*", "_p.query", "_p.query_text").drop("_p")


def score_pool(candidates: DataFrame, queries: list[tuple[str, str]], weight: float = 0.4, relevance: Relevance = by_terms) -> DataFrame:
    """Every candidate under every query, best first; excluded ones score -1 and come last, with no relevance.

    candidates: (id, quality, excluded) and what the relevance hook reads (by_terms: description, full_name, topics, stars).
    """
    rows = relevance(under_queries(candidates, queries))
    score = F.when(F.col("excluded"), -1).otherwise(blend(F.col("quality"), F.col("relevance"), weight))
    return ranked(rows.withColumn("overall", score).withColumn("relevance", F.when(F.col("excluded"), 0).otherwise(F.col("relevance"))), "query", "overall", "id")


def scout(candidates: DataFrame, queries: list[tuple[str, str]], name: Column, relevance: Relevance = by_terms, model: DataFrame | None = None, weight: float = 0.4) -> DataFrame:
    """Candidates of a search from end to end: flagged, excluded, one of each name, scored, and ranked under every query.

    candidates: (id, full_name, description, stars, forks, is_fork, is_archived, is_template, license_name, n_topics,
    open_issues, updated_days, created_days) and what the hook reads. Of equal names the one with most stars stays, then
    the smallest id. model: (query, id, relevance) of a model; where it has none, the hook's relevance counts. Returns
    the rows with query, flags, quality, relevance, verdict, overall and rank.
    """
    c = F.col
    flags = noise_flags(c("is_fork"), c("is_archived"), c("is_template"), c("description"), c("full_name"), c("stars"), c("forks"))
    rows = candidates.withColumn("flags", flags).filter(~excluded(c("is_archived"), c("flags"), c("stars")))
    # by an aggregate, so that a name that many candidates have is thinned within tasks
    best = F.min_by(F.struct(*rows.columns), F.struct(-c("stars"), c("id")))
    rows = rows.groupBy(name.alias("_name")).agg(best.alias("_c")).select("_c.*")
    points = quality(c("stars"), activity_points(c("updated_days"), c("created_days")), c("license_name"), F.lit(False), c("description"), c("n_topics"), c("forks"), c("open_issues"), c("flags"))
    rows = relevance(under_queries(rows.withColumn("quality", points.cast("int")), queries))
    rows = rows.withColumn("verdict", F.lit("worth_checking"))
    if model is not None:
        said = model.select("query", "id", c("relevance").alias("_said"))
        rows = rows.join(said, ["query", "id"], "left").withColumn("relevance", F.coalesce("_said", "relevance")).withColumn("verdict", F.when(c("_said").isNull(), c("verdict")).otherwise("scored")).drop("_said")
    return ranked(rows.withColumn("overall", blend(c("quality"), c("relevance"), weight)), "query", "overall", "id")


def with_model_scores(candidates: DataFrame, scores: DataFrame, fallback: Column) -> DataFrame:
    """Candidates with a model's relevance by id, the fallback where it gave none."""
    return candidates.join(scores.select("id", F.col("relevance").alias("_m")), "id", "left").withColumn("relevance", F.coalesce("_m", fallback)).drop("_m")


def class_means(results: DataFrame) -> DataFrame:
    """(cls, ndcg, precision, n) over queries that have an ideal set, by class and for all (null)."""
    return results.filter("n_ideal > 0").rollup("cls").agg(F.avg("ndcg").alias("ndcg"), F.avg("precision").alias("precision"), F.count(F.lit(1)).alias("n"))
