"""Staged answers of services as tables, and rows as sinks store them."""

from __future__ import annotations

import logging

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import fixed
from ..functions import columns as C

TREE = "struct<sha:string, tree:array<struct<path:string, type:string, size:bigint>>>"
METADATA = "struct<full_name:string, description:string, default_branch:string, language:string, stargazers_count:bigint, forks_count:bigint, topics:array<string>>"


def repo_tree(raw: DataFrame, key: str, text: str = "raw_json") -> DataFrame:
    """(key, sha, path, type, size) of staged tree answers; an answer that is malformed or has no tree has no rows."""
    x = raw.select(key, F.from_json(text, TREE).alias("j"))
    return x.select(key, F.col("j.sha").alias("sha"), F.explode("j.tree").alias("e")).select(key, "sha", "e.*")


def repo_metadata(raw: DataFrame, key: str, text: str = "raw_json") -> DataFrame:
    """Staged metadata answers by field; a malformed answer has nulls."""
    return raw.select(key, F.from_json(text, METADATA).alias("j")).select(key, "j.*")


def review_rows(reports: DataFrame, now: Column) -> DataFrame:
    """Rows of finished reviews (job_id, branch, report): the columns that are searched, and the report's parts as JSON."""
    r = lambda path: F.col(f"report.{path}")
    score = {f"{k}_score": r(f"scorecard.{v}") for k, v in (("security", "security"), ("testing", "testing"), ("maintainability", "maintainability"), ("reliability", "reliability"), ("operations", "operational_readiness"), ("developer_experience", "developer_experience"))}
    plain = {
        "repo_url": r("repo.url"), "commit": r("repo.commit"), "branch": F.coalesce("branch", F.lit("main")), "ruleset_version": r("meta.ruleset_version"), "schema_version": F.coalesce(r("meta.schema_version"), F.lit("1.0")),
        "depth_level": r("depth.level"), "confidence_label": r("meta.confidence_label"), "overall_score": r("meta.overall_score"), **score,
        "verdict_label": r("interpretation.overall_label"), "trust_recommendation": r("interpretation.trust_recommendation"), "production_suitable": F.coalesce(r("interpretation.production_suitable"), F.lit(False)), "anti_gaming_verdict": r("anti_gaming.overall_verdict"),
    }
    parts = {"scorecard": "scorecard", "findings": "findings", "coverage": "coverage", "depth": "depth", "anti_gaming": "anti_gaming", "summary": "review_summary", "meta": "meta"}
    stored = {f"{k}_json": F.to_json(r(v), {"ignoreNullFields": "false"}) for k, v in parts.items()}
    return reports.select("job_id", *(c.alias(n) for n, c in {**plain, **stored}.items()), F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("error_message"), now.alias("completed_at"))


def error_rows(failures: DataFrame, now: Column) -> DataFrame:
    """Rows of failed reviews (job_id, repo_url, commit, branch, error_code, error_message); the other columns come null by a union that allows missing ones."""
    return failures.select("job_id", "repo_url", "commit", F.coalesce("branch", F.lit("main")).alias("branch"), "error_code", "error_message", now.alias("completed_at"))


def embedding_rows(chunks: DataFrame, vectors: DataFrame, on: list[str]) -> DataFrame:
    """Chunks with their vectors, where there are any, as JSON text; an empty vector is none."""
    text = F.concat(F.lit("["), F.array_join(F.transform("vector", lambda x: x.cast("string")), ", "), F.lit("]"))
    return chunks.join(vectors, on, "left").withColumn("embedding", F.when(F.size("vector") > 0, text)).drop("vector")


def stored_vector(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def append_usage(calls: DataFrame, path: str) -> bool:
    """Appends calls below path by stage; a failure is logged and swallowed, as usage is not worth a run."""
    try:
        calls.write.mode("append").partitionBy("stage").parquet(path)
        return True
    except (PySparkException, Py4JError):
        logging.getLogger(__name__).debug("usage not recorded", exc_info=True)
        return False


def stream_usage(calls: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The same append for a stream's micro-batches."""
    return calls.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda rows, _: append_usage(rows, path)).start()


def write_jobs(jobs: DataFrame, path: str) -> None:
    """Jobs laid out as claims and queue metrics read them: folders by status, files in order of creation, so both filters prune."""
    jobs.repartitionByRange(F.col("status"), F.col("created_at")).sortWithinPartitions("status", "created_at").write.mode("overwrite").partitionBy("status").parquet(path)


def _feature(name: str) -> str:
    return fixed.DEV_FEATURE.format(name)


def devcontainer(rows: DataFrame, key: str, prefix: str = "dev-") -> DataFrame:
    """(key, name, image, features, services, post_create, json) of rows (languages, frameworks, services, custom), all arrays; names begin with prefix."""
    langs, n = F.col("languages"), F.size("languages")
    name = F.concat(F.lit(prefix), F.when(n > 0, F.array_join(F.slice("languages", 1, 2), "-")).otherwise("base"))
    image = C.lookup(F.when(n > 0, F.get("languages", F.lit(0))).otherwise("python"), fixed.DEV_IMAGES, fixed.DEV_BASE_IMAGE)
    of = {k: _feature(v) for k, v in fixed.DEV_FRAMEWORK_FEATURE.items()}
    features = F.concat("custom", F.array_compact(F.transform("frameworks", lambda f: C.lookup(F.lower(f), of))))
    for x in map(_feature, fixed.DEV_ALWAYS):
        features = F.when(F.array_contains(features, x), features).otherwise(F.concat(features, F.array(F.lit(x))))
    known = F.array_distinct(F.filter(F.transform("services", lambda s: F.lower(s)), lambda s: s.isin(*fixed.DEV_SERVICES)))
    post = F.array_join(F.flatten(F.array(*[F.when(F.array_contains(langs, k), C.strings(v)).otherwise(F.array().cast("array<string>")) for k, v in fixed.DEV_COMMANDS.items()])), " && ")
    made = rows.select(key, name.alias("name"), image.alias("image"), features.alias("features"), known.alias("services"), post.alias("post_create"))
    images, ports = {k: v[0] for k, v in fixed.DEV_SERVICES.items()}, {k: v[1] for k, v in fixed.DEV_SERVICES.items()}
    service = lambda s: F.struct(C.lookup(s, images).alias("image"), F.create_map(C.lookup(s, ports).cast("string"), C.lookup(s, ports)).alias("ports"))
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    vscode = F.struct(C.strings(fixed.DEV_EXTENSIONS).alias("extensions"), F.parse_json(F.lit(fixed.DEV_SETTINGS)).alias("settings"))
    body = F.struct(
        "name", "image", F.map_from_entries(F.transform(F.array_distinct("features"), lambda f: F.struct(f.alias("k"), empty.alias("v")))).alias("features"),
        F.map_from_entries(F.transform("services", lambda s: F.struct(s.alias("k"), service(s).alias("v")))).alias("services"), F.col("post_create").alias("postCreateCommand"), F.struct(vscode.alias("vscode")).alias("customizations"),
    )
    return made.withColumn("json", F.to_json(body))


def report_lines(results: DataFrame, quality: float, relevance: float, generated: Column, title: str = "Benchmark Report") -> DataFrame:
    """(section, ordinal, line) of a ranking benchmark's markdown, of results (id, query, cls, ndcg, p, has_ideal, top, passed).

    Means are of queries that have an ideal set. Sorted by section and ordinal, the lines are the report.
    """
    pick = F.when(F.col("has_ideal"), F.col("ndcg")), F.when(F.col("has_ideal"), F.col("p"))
    means = [F.coalesce(F.avg(c), F.lit(0.0)) for c in pick]
    total = results.agg(means[0].alias("ndcg"), means[1].alias("p"), F.count_if(~F.col("passed")).alias("failed"))
    head = F.array(
        F.lit(f"# {title}"), F.lit(""), F.concat(F.lit(f"**Weights:** quality={quality}  relevance={relevance} &nbsp;|&nbsp; **Generated:** "), generated), F.lit(""), F.lit("## Overall"), F.lit(""), F.lit("| Metric | Value |"), F.lit("|--------|-------|"),
        F.format_string("| Mean NDCG@3 | %s |", C.share_text(F.col("ndcg"), 3)), F.format_string("| Mean P@3 | %s |", C.share_text(F.col("p"), 3)), F.format_string("| Noise gate failures | %d |", "failed"), F.lit(""), F.lit("## Subset Breakdown"), F.lit(""), F.lit("| Class | NDCG@3 | P@3 |"), F.lit("|-------|--------|-----|"),
    )
    at = lambda n: F.lit(n).alias("section")
    key = F.lpad(F.col("k").cast("string"), 8, "0").alias("ordinal")
    out = total.select(at(0), F.posexplode(head).alias("k", "line")).select("section", key, "line")
    classes = results.groupBy("cls").agg(means[0].alias("ndcg"), means[1].alias("p"), F.count_if("has_ideal").alias("n")).filter("n > 0")
    out = out.unionByName(classes.select(at(1), F.col("cls").alias("ordinal"), F.format_string("| %s | %s | %s |", "cls", C.share_text(F.col("ndcg"), 3), C.share_text(F.col("p"), 3)).alias("line")))
    table = F.array(*map(F.lit, ("", "## Per-Query Results", "", "| ID | Query | Class | NDCG@3 | P@3 | Top Result | Gate |", "|----|-------|-------|--------|-----|-----------|------|")))
    out = out.unionByName(total.select(at(2), F.posexplode(table).alias("k", "line")).select("section", key, "line"))
    shown = lambda c: F.when(F.col("has_ideal"), C.share_text(F.col(c), 2)).otherwise("n/a")
    line = F.concat_ws(" | ", F.concat(F.lit("| "), "id"), F.left("query", F.lit(40)), "cls", shown("ndcg"), shown("p"), F.concat(F.lit("`"), F.left(F.coalesce("top", F.lit("—")), F.lit(35)), F.lit("`")), F.concat(F.when(F.col("passed"), "✓").otherwise("**✗**"), F.lit(" |")))
    out = out.unionByName(results.select(at(3), F.col("id").alias("ordinal"), line.alias("line")))
    some = total.filter("failed > 0").select(at(4), F.posexplode(F.array(*map(F.lit, ("", "## ⚠ Noise Gate Failures", "")))).alias("k", "line")).select("section", key, "line")
    return out.unionByName(some).unionByName(results.filter(~F.col("passed")).select(at(5), F.col("id").alias("ordinal"), F.format_string("- **[%s]** %s", "id", "query").alias("line")))
