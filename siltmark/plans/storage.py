"""Queries over stored scans, budgets of reading, and claims without a trace."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog import query, table
from ..operators import access, scans, search

_LINES = """(SELECT DISTINCT l_orderkey AS result_id, 'f' || l_linenumber || '_' || l_partkey || '.py' AS path, l_quantity::INT AS loc, 1 - l_discount AS confidence,
  CASE l_linenumber % 3 WHEN 0 THEN 'eval_exec,,shell' WHEN 1 THEN '' END AS sensitive_operations, CASE WHEN l_returnflag <> 'N' THEN 'g' || l_suppkey || '.py' END AS target_path,
  CASE WHEN l_returnflag = 'R' THEN l_partkey * 10 + l_linenumber END AS id FROM lineitem)"""
_DIMS = "(SELECT o_orderkey AS result_id, o_custkey, dimension, (o_custkey % 101)::INT AS adjusted_score, CASE WHEN dimension = 'security' THEN 'a' || chr(10) || chr(10) || 'b' END AS deductions_text FROM orders, (VALUES ('security'), ('testing')) AS t(dimension) WHERE o_custkey % 3 > 0)"


#: Tables that lines are made into.
_SETS = ("files", "edges", "findings")


def _tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Rows of the stored tables; equal ones of _SETS are to be stored once."""
    for t in ("lineitem", "orders"):
        table(spark, sf, t).createOrReplaceTempView(f"_scan_{t}")
    sql = lambda q: spark.sql("SELECT * FROM " + q.replace("::INT", "").replace("SELECT DISTINCT", "SELECT").replace("FROM lineitem", "FROM _scan_lineitem").replace("FROM orders", "FROM _scan_orders"))
    lines, dims = sql(_LINES), sql(_DIMS)
    return {
        "files": lines.select("result_id", "path", "loc", "confidence", "sensitive_operations"),
        "edges": lines.select("result_id", F.col("path").alias("source_path"), "target_path", F.col("path").alias("raw_import")),
        "findings": lines.filter("id is not null").select("result_id", "id", F.col("path").alias("file_path"), F.lit("high").alias("severity")),
        "scores": dims.filter("dimension = 'testing'").select("result_id", F.col("adjusted_score").alias("composite_score"), F.concat(F.lit("u"), "o_custkey").alias("repo_url")),
        "dimensions": dims.select("result_id", "dimension", "adjusted_score", F.lit("Fair").alias("label"), "deductions_text"),
    }


@query(
    f"""WITH l AS (SELECT * FROM {_LINES}), d AS (SELECT * FROM {_DIMS}),
f AS (SELECT result_id, count(*) AS n_files, string_agg(path || ':' || loc || ':' || CASE WHEN sensitive_operations LIKE 'eval%' THEN 'eval_exec+shell' ELSE '' END, ' ' ORDER BY path, loc) AS files, round_even(avg(confidence), 6) AS parse_success_rate
  FROM (SELECT DISTINCT result_id, path, loc, confidence, sensitive_operations FROM l) GROUP BY result_id),
e AS (SELECT result_id, count(*) AS n_edges, count(target_path) AS n_confirmed FROM (SELECT DISTINCT result_id, path, target_path FROM l) GROUP BY result_id),
g AS (SELECT result_id, string_agg(id || '@' || path, ' ' ORDER BY id, path) AS findings FROM (SELECT DISTINCT result_id, id, path FROM l WHERE id IS NOT NULL) GROUP BY result_id),
s AS (SELECT result_id, any_value(adjusted_score) AS composite, string_agg(dimension || '=' || coalesce(replace(deductions_text, chr(10) || chr(10), '+'), '') || ';Fair (' || adjusted_score || '/100)', ' ' ORDER BY dimension) AS dimensions, any_value('u' || o_custkey) AS repo_url FROM d GROUP BY result_id)
SELECT f.result_id, coalesce(repo_url, '') AS repo_url, n_files::INT AS n_files, files, parse_success_rate, coalesce(n_edges, 0)::INT AS n_edges, coalesce(n_confirmed, 0)::INT AS n_confirmed, coalesce(findings, '') AS findings, composite, dimensions
FROM f LEFT JOIN e ON e.result_id = f.result_id LEFT JOIN g ON g.result_id = f.result_id LEFT JOIN s ON s.result_id = f.result_id"""
)
def rebuilt_scans(spark, sf):
    """Stored scans, each rebuilt with its files, edges, findings and scorecard (A13, A14, the eager load of 2.11)."""
    name = f"scan_{uuid.uuid4().hex}"
    scans.save(_tables(spark, sf), name, distinct=_SETS)
    s = scans.load(spark, name)
    each = lambda c, f: F.array_join(F.transform(c, f), " ")
    return s.select(
        "result_id", "repo_url", F.size("files").alias("n_files"), each("files", lambda x: F.concat(x.path, F.lit(":"), x["loc"], F.lit(":"), F.array_join(x.sensitive_operations, "+"))).alias("files"),
        F.bround("metadata.parse_success_rate", 6).alias("parse_success_rate"), F.size("edges").alias("n_edges"), F.size(F.filter("edges", lambda x: x.target_path.isNotNull())).alias("n_confirmed"),
        each("findings", lambda x: F.concat(x.id, F.lit("@"), x.file_path)).alias("findings"), F.col("scorecard.card.composite_score").alias("composite"),
        each("scorecard.dimensions", lambda x: F.concat(x.dimension, F.lit("="), F.array_join(x.deductions_text, "+"), F.lit(";"), x.explanation)).alias("dimensions"),
    )


_SIZED = "(SELECT c_custkey % 3 AS repo_id, c_custkey AS place, (c_custkey * 37 % 211)::BIGINT AS size FROM customer)"


@query(
    f"""WITH f AS (SELECT *, (row_number() OVER (PARTITION BY repo_id ORDER BY place) - 1) // 30 AS batch FROM {_SIZED}),
b AS (SELECT repo_id, batch, coalesce(sum(sum(size)) OVER (PARTITION BY repo_id ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM f GROUP BY repo_id, batch)
SELECT f.repo_id, place, size, f.batch FROM f JOIN b ON b.repo_id = f.repo_id AND b.batch = f.batch WHERE spent <= 3000"""
)
def batched_budget(spark, sf):
    """Files in batches of 30 until a repository's bytes are spent (2.12)."""
    files = table(spark, sf, "customer").select((F.col("c_custkey") % 3).alias("repo_id"), F.col("c_custkey").alias("place"), (F.col("c_custkey") * 37 % 211).alias("size"))
    return access.within_budget(files, ["repo_id"], ["place"], "size", 3000).select("repo_id", "place", "size", "batch")


@query(
    r"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentence FROM documents),
t AS (SELECT doc_id, regexp_replace(sentence, '^\s+|\s+$', '', 'g') AS sentence FROM s),
f AS (SELECT DISTINCT trim(lower(left(sentence, 40)), ' ') AS f FROM t WHERE sentence <> ''),
b AS (SELECT DISTINCT lower(text) AS b FROM benchmark),
held AS (SELECT f FROM f WHERE EXISTS (SELECT 1 FROM b WHERE contains(b, f)))
SELECT doc_id, sentence, count(*) AS n FROM t WHERE sentence <> '' AND trim(lower(left(sentence, 40)), ' ') NOT IN (SELECT f FROM held) GROUP BY doc_id, sentence"""
)
def untraced_sentences(spark, sf):
    """Sentences of documents whose beginning stands in no benchmark text (C32, S4, the theta anti join of 2.11)."""
    claims = search.sentences(table(spark, sf, "documents"), "doc_id", "text")
    return search.untraced(claims, table(spark, sf, "benchmark"), "sentence", "text").groupBy("doc_id", "sentence").agg(F.count(F.lit(1)).alias("n"))
