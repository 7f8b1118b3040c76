"""Scans as stored: five tables bucketed by result, and the nested scan rebuilt from them without an exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Columns of the stored tables, beside result_id.
TABLES = {
    "files": "path string, language string, role string, is_entrypoint boolean, is_test boolean, loc int, confidence double, sensitive_operations string, framework_signals string, is_on_critical_path boolean, caller_count int",
    "edges": "source_path string, target_path string, raw_import string, confidence string, unresolved_reason string",
    "findings": "id long, file_path string, category string, severity string, line_start int, title string, score_impact int",
    "scores": "composite_score int, composite_label string, confidence_extraction double, confidence_graph double, confidence_finding double, confidence_score double, critical_count int, high_count int, medium_count int, low_count int, total_findings int, repo_url string, repo_owner string, repo_name string",
    "dimensions": "dimension string, raw_score int, adjusted_score int, label string, deductions_text string",
}
ORDER = {"files": "path", "edges": "source_path", "findings": "id", "dimensions": "dimension"}


def save(tables: dict[str, DataFrame], name: str, buckets: int = 16, distinct: tuple[str, ...] = ()) -> None:
    """Writes tables (result_id and some of TABLES' columns; absent ones are null) as name_files and so on, bucketed and sorted by result_id.

    distinct: tables whose equal rows are stored once; they meet in the exchange to the buckets, so that this takes no other.
    """
    for kind, columns in TABLES.items():
        df = tables[kind]
        typed = [(c.split(" ")[0], c.split(" ")[1]) for c in columns.split(", ")]
        rows = df.select(F.col("result_id").cast("long").alias("result_id"), *((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in typed))
        rows = rows.repartition(buckets, "result_id")
        rows = rows.distinct() if kind in distinct else rows
        rows.write.mode("overwrite").bucketBy(buckets, "result_id").sortBy("result_id").saveAsTable(f"{name}_{kind}")


def load(spark: SparkSession, name: str) -> DataFrame:
    """A row for each result that has files: files, contexts, edges, findings, confidence, metadata, and the scorecard (null where none was stored).

    Kept and lost as the stored tables keep and lose it: comma-joined lists are split without their empty parts, lines of
    deductions likewise; counts of skipped and failed files and the default branch are null, languages are empty, the
    files scanned are those stored, the share parsed is their mean confidence, and a dimension's findings are not known.
    Each table is aggregated once in its own buckets, and the buckets are joined as they lie: only scans of one bucket
    meet in a task.
    """
    read = lambda kind: spark.table(f"{name}_{kind}")
    split = lambda c, by: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), by), lambda x: x != "").alias(c)
    nested = lambda order, *cols: F.array_sort(F.collect_list(F.struct(F.col(order), *(c for c in cols))))

    files = read("files").groupBy("result_id").agg(
        nested("path", "language", "role", "is_entrypoint", "is_test", "loc", "confidence", split("sensitive_operations", ","), split("framework_signals", ",")).alias("files"),
        nested("path", "is_on_critical_path", "caller_count").alias("contexts"),
        F.struct(F.count(F.lit(1)).cast("int").alias("total_files"), F.count(F.lit(1)).cast("int").alias("files_scanned"), F.lit(None).cast("int").alias("files_skipped"), F.lit(None).cast("int").alias("files_failed"), F.avg("confidence").alias("parse_success_rate"), F.create_map().cast("map<string,int>").alias("languages_detected")).alias("metadata"),
    )
    edges = read("edges").groupBy("result_id").agg(nested("source_path", "raw_import", "target_path", "confidence", "unresolved_reason").alias("edges"))
    findings = read("findings").groupBy("result_id").agg(nested("id", "file_path", "category", "severity", "line_start", "title", "score_impact").alias("findings"))
    said = F.concat("label", F.lit(" ("), F.col("adjusted_score").cast("string"), F.lit("/100)")).alias("explanation")
    dimensions = read("dimensions").groupBy("result_id").agg(nested("dimension", "raw_score", "adjusted_score", split("deductions_text", "\n"), F.array().cast("array<long>").alias("finding_ids"), said).alias("dimensions"))
    scores = read("scores").select("result_id", F.struct("confidence_extraction", "confidence_graph", "confidence_finding", "confidence_score").alias("confidence"), F.col("repo_url"), F.col("repo_owner"), F.col("repo_name"), F.struct("composite_score", "composite_label", "total_findings", "critical_count", "high_count", "medium_count", "low_count").alias("card"))
    out = files
    for other in (edges, findings, scores, dimensions):
        out = out.join(other.hint("merge"), "result_id", "left")
    none = lambda c: F.coalesce(c, F.array().cast(dict(out.dtypes)[c])).alias(c)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select("result_id", text("repo_url"), text("repo_owner"), text("repo_name"), F.lit(None).cast("string").alias("default_branch"), "files", "contexts", none("edges"), none("findings"), "metadata", "confidence", F.when(F.col("card").isNotNull(), F.struct("card", none("dimensions"))).alias("scorecard"))
