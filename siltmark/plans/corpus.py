"""Queries over documents, pages and conversations, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import fixed
from ..catalog import query, table
from ..functions import columns as C
from ..operators import findings as fnd, graph, ranking, search

PATTERNS = (*fixed.LINE_PATTERNS, *fixed.PROSE_PATTERNS)


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


PATTERN_ROWS = ", ".join(f"({_quoted(n)}, {_quoted(p)}, '{c}', '{s}', {v})" for n, p, c, s, v in PATTERNS)
LINES_SQL = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, len(string_split(text, chr(10))) AS n FROM documents"
FINDINGS_SQL = f"""p(pattern, re, category, severity, points) AS (VALUES {PATTERN_ROWS}),
l AS ({LINES_SQL}),
f AS (SELECT l.doc_id, l.line_no, p.pattern, p.category, p.severity, p.points, substring(trim(l.line), 1, 300) AS snippet FROM l JOIN p ON regexp_matches(l.line, p.re) WHERE NOT (l.line = '' AND l.line_no = l.n))"""


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    return fnd.line_findings(table(spark, sf, "documents"), patterns=PATTERNS)


@query(f"WITH {FINDINGS_SQL} SELECT doc_id, line_no::INT AS line, pattern, category, severity, points::INT AS points, snippet FROM f")
def line_findings(spark, sf):
    """Every line of every document that a pattern matches (C7, C17, S-A33)."""
    return _findings(spark, sf).withColumn("line", F.col("line").cast("int"))


_RAW = {d: f"greatest(0, 100 + coalesce(sum(points) FILTER (category = '{d}'), 0))" for d in ("security", "performance", "reliability", "maintainability")}
_SHRINK = lambda x: f"trunc({x} * c + 50 * (1.0 - c))::INT"
_LOST = "CASE WHEN abs(a.s) >= abs(b.s) THEN (a.s - (a.s + b.s)) + b.s ELSE (b.s - (a.s + b.s)) + a.s END"
_PRECISE = lambda terms: f"list_transform([list_reduce([{', '.join(f'{{{chr(39)}s{chr(39)}: {t}, {chr(39)}c{chr(39)}: 0.0::DOUBLE}}' for t in terms)}], lambda a, b: {{'s': a.s + b.s, 'c': a.c + {_LOST}}})], lambda a: a.s + a.c)[1]"
_BAND = lambda x, bands: "CASE " + " ".join(f"WHEN {x} BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in bands) + " END"


@query(
    f"""WITH {FINDINGS_SQL},
base AS (SELECT d.doc_id, CASE WHEN any_value(d.n_chars) > 2000 THEN 0.75 ELSE 0.9 END::DOUBLE AS c, any_value(d.n_chars) AS n_chars,
  {", ".join(f"{x} AS r_{d}" for d, x in _RAW.items())},
  count(f.pattern) AS n_findings, count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'high') AS n_high
  FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id),
s AS (SELECT doc_id, c, n_findings, n_critical, n_high, {", ".join(f"{_SHRINK(f'r_{d}')} AS {d}" for d in _RAW)}, {_SHRINK("50")} AS test_coverage, {_SHRINK("(CASE WHEN n_chars > 500 THEN 100 ELSE 80 END)")} AS documentation FROM base),
t AS (SELECT *, round_even({_PRECISE([f"{d} * {w}::DOUBLE" for d, w in fixed.DIMENSION_WEIGHTS.items()])}, 0)::INT AS composite FROM s)
SELECT doc_id, security, performance, reliability, maintainability, test_coverage, documentation, composite, {_BAND("composite", fixed.COMPOSITE_BANDS)} AS label, n_findings, n_critical, n_high FROM t"""
)
def findings_scorecard(spark, sf):
    """Scorecard of every document, findings or none (S-A1 to S-A9): the flagship query."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars").withColumn("test_score", F.lit(50)).withColumn("documentation_score", F.when(F.col("n_chars") > 500, 100).otherwise(80))
    card = fnd.scorecard(docs, _findings(spark, sf), "doc_id", F.when(F.col("n_chars") > 2000, 0.75).otherwise(0.9))
    return card.select("doc_id", *fixed.DIMENSION_WEIGHTS, "composite", "label", "n_findings", "n_critical", "n_high")


@query(
    f"""WITH {FINDINGS_SQL} SELECT doc_id, line_no::INT AS line, pattern, severity FROM f WHERE category = 'privacy'
ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, doc_id, line_no, pattern LIMIT 50 OFFSET 5"""
)
def findings_page(spark, sf):
    """A page of one category's findings in severity order (B8, 2.12)."""
    rows = _findings(spark, sf).withColumn("line", F.col("line").cast("int"))
    return fnd.page(rows, [fnd.severity_order(F.col("severity")), "doc_id", "line", "pattern"], 50, 5, category="privacy").select("doc_id", "line", "pattern", "severity")


@query(f"WITH {FINDINGS_SQL} SELECT category, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM f GROUP BY category")
def severity_counts(spark, sf):
    """Severities by category, zero-filled (S-A9)."""
    return _findings(spark, sf).groupBy("category").pivot("severity", ["critical", "high", "medium", "low"]).count().fillna(0)


@query("SELECT doc_id, length(text) > 5000 AS truncated, length(substring(text, 1, 5000))::INT AS kept, length(CASE WHEN length(text) <= 2000 THEN text ELSE concat(left(text, 1000), chr(10) || '... [truncated] ...' || chr(10), right(text, 1000)) END)::INT AS elided FROM documents")
def truncation(spark, sf):
    """Cut texts with their flag, and elided ones."""
    x = C.truncated(F.col("text"), 5000)
    return table(spark, sf, "documents").select("doc_id", x["truncated"].alias("truncated"), F.length(x["text"]).alias("kept"), F.length(C.elided(F.col("text"), 1000)).alias("elided"))


@query(
    """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang HAVING count(*) >= 2), s AS (SELECT lang, n, n / sum(n) OVER () AS share FROM c)
SELECT lang, n, round_even(share, 6) AS share FROM s WHERE share >= 0.10"""
)
def language_share(spark, sf):
    """Languages of at least a tenth of the documents (S-A15)."""
    c = table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    whole = c.agg(F.sum("n").alias("whole"))  # one row
    return c.crossJoin(F.broadcast(whole)).withColumn("share", F.col("n") / F.col("whole")).filter("share >= 0.10").select("lang", "n", F.bround("share", 6).alias("share"))


@query("SELECT source, any_value(lang) AS primary_language, max(n) AS n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY source, lang) WHERE r = 1 GROUP BY source")
def primary_language(spark, sf):
    """Each source's most frequent language, ties to the first by name (S-A13, S-A14)."""
    c = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    best = c.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("m"), "lang")).alias("b"))
    return best.select("source", F.col("b.lang").alias("primary_language"), (-F.col("b.m")).alias("n"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies, sha256(text) AS digest FROM documents GROUP BY text")
def keep_best_by_text(spark, sf):
    """One document of each text, the smallest id, by its hash."""
    return table(spark, sf, "documents").groupBy(F.sha2(F.encode("text", "UTF-8"), 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query(
    """WITH o AS (SELECT doc_id, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS pos, lang FROM documents),
p AS (SELECT a.doc_id, b.doc_id AS related, row_number() OVER (PARTITION BY a.doc_id ORDER BY b.doc_id) AS rank FROM o a JOIN o b ON a.lang = b.lang AND a.source = b.source AND a.doc_id <> b.doc_id AND b.pos <= 6)
SELECT doc_id, related, rank::INT AS rank FROM p WHERE rank <= 5"""
)
def related_documents(spark, sf):
    """The first five others of a document's language and source."""
    return graph.related(table(spark, sf, "documents"), ["lang", "source"], "doc_id")


@query(
    """WITH own AS (SELECT doc_id, source, 1.0::DOUBLE AS score, 0 AS s FROM documents WHERE source = 'src0' AND contains(lower(text), 'the ')),
pub AS (SELECT doc_id, source, 1.0::DOUBLE AS score, 1 AS s FROM documents WHERE source IN ('src1', 'src0') AND contains(lower(text), 'the ')),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS r FROM (SELECT * FROM own UNION ALL SELECT * FROM pub))
SELECT doc_id, source, score FROM u WHERE r = 1 ORDER BY score DESC, doc_id LIMIT 20"""
)
def two_scope_search(spark, sf):
    """Substring search over two scopes, merged."""
    d = table(spark, sf, "documents").select("doc_id", "source", "text")
    hits = lambda *s: search.contains(d.filter(F.col("source").isin(*s)), "text", "the ").select("doc_id", "source", "score")
    return search.two_scopes(hits("src0"), hits("src1", "src0"), ["doc_id"], "doc_id", 20)


@query("SELECT doc_id, len(list_filter(['library', 'toxic', 'the', 'und'], lambda t: contains(lower(text), t)))::INT AS n_matches FROM documents")
def term_matches(spark, sf):
    """How many of a query's terms each document holds."""
    return table(spark, sf, "documents").select("doc_id", F.size(C.term_matches(F.lit("a library of: toxic, the und"), F.col("text"))).alias("n_matches"))


@query("SELECT doc_id, 'architecture' AS chunk_type, left(text, 800) AS chunk_text FROM documents WHERE text <> '' UNION ALL SELECT doc_id, 'stack', source || ' uses ' || lang FROM documents")
def search_chunks(spark, sf):
    """Search chunks of every document."""
    none = F.array().cast("array<string>")
    rows = table(spark, sf, "documents").select("doc_id", F.col("source").alias("label"), F.col("text").alias("summary"), F.array("lang").alias("frameworks"), none.alias("npm"), none.alias("python"))
    return search.chunks(rows, "doc_id")


@query(
    r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, array_to_string(list_slice(string_split(regexp_replace(url, '/+$', ''), '/'), -2, -1), '/') AS label,
  len(regexp_extract_all(html, 'href="([^"]+)"', 1))::INT AS n_links, len(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1)))::INT AS n_distinct FROM pages"""
)
def page_links(spark, sf):
    """Host, label and links of every page."""
    links = F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), C.url_label(F.col("url")).alias("label"), F.size(links).alias("n_links"), F.size(F.array_distinct(links)).alias("n_distinct"))


@query(r"SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS pages, sum(length(html))::BIGINT AS chars FROM pages GROUP BY 1")
def pages_by_host(spark, sf):
    """Pages and characters by host."""
    return table(spark, sf, "pages").groupBy(F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("html")).alias("chars"))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT conv_id, turn AS source, turn + 1 AS target FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn + 1)),
r(conv_id, path, depth) AS (SELECT DISTINCT conv_id, turn, 0 FROM conversations WHERE role = 'user' UNION SELECT r.conv_id, e.target, depth + 1 FROM r JOIN e ON r.conv_id = e.conv_id AND r.path = e.source WHERE depth < 2)
SELECT conv_id, path, min(depth)::INT AS depth FROM r GROUP BY conv_id, path"""
)
def reply_reach(spark, sf):
    """Turns within two replies of a user's turn (G12), by unrolled joins."""
    c = table(spark, sf, "conversations")
    later = c.select("conv_id", (F.col("turn") - 1).alias("turn")).distinct()
    e = c.join(later, ["conv_id", "turn"], "left_semi").select("conv_id", F.col("turn").alias("source"), (F.col("turn") + 1).alias("target"))
    return graph.reach(e, c.filter("role = 'user'").select("conv_id", F.col("turn").alias("path")), ["conv_id"])


@query("SELECT conv_id, arg_max(role, turn) AS last_role, max(turn) AS last_turn, count(*) AS turns, round_even(count(*) FILTER (role = 'user') / count(*), 6) AS user_share FROM conversations GROUP BY conv_id")
def latest_turn(spark, sf):
    """Each conversation's last turn and shares."""
    g = table(spark, sf, "conversations").groupBy("conv_id")
    return g.agg(F.max_by("role", "turn").alias("last_role"), F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("turns"), F.bround(F.count_if(F.col("role") == "user") / F.count(F.lit(1)), 6).alias("user_share"))


@query(
    """WITH q AS (SELECT DISTINCT lang AS query FROM documents), c AS (SELECT d.doc_id, d.lang AS query, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n_chars DESC, doc_id) AS rank FROM c),
i AS (SELECT query, least(count(*), 3) AS n_ideal FROM c WHERE quality = 1 AND toxic = 0 GROUP BY query),
h AS (SELECT query, sum(1.0 / log2(rank + 1.0)) AS dcg, count(*) AS n_hits FROM r WHERE rank <= 3 AND quality = 1 AND toxic = 0 GROUP BY query)
SELECT q.query, CASE WHEN n_ideal IS NULL THEN 1.0 ELSE round_even(coalesce(dcg, 0) / list_sum(list_transform(range(1, n_ideal + 1), lambda x: 1.0 / log2(x + 1.0))), 6) END::DOUBLE AS ndcg, CASE WHEN n_ideal IS NULL THEN 1.0 ELSE round_even(coalesce(n_hits, 0) / 3.0::DOUBLE, 6) END::DOUBLE AS precision,
  EXISTS (SELECT 1 FROM r WHERE r.query = q.query AND rank <= 3 AND toxic = 1) AS noise_failure
FROM q LEFT JOIN i ON q.query = i.query LEFT JOIN h ON q.query = h.query"""
)
def ranking_evaluation(spark, sf):
    """NDCG@3, P@3 and the noise gate of a length ranking by language."""
    d, lab = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("query"), "n_chars"), table(spark, sf, "labels")
    c = d.join(lab, "doc_id")
    r = c.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n_chars"), "doc_id"))).filter("rank <= 3")
    q = d.select("query").distinct()
    e = ranking.evaluate(r, c.filter("quality = 1 and toxic = 0"), q, "query", "doc_id")
    bad = ranking.noise_failures(r, c.filter("toxic = 1").select("query", "doc_id"), "query", "doc_id").withColumn("noise_failure", F.lit(True))
    return e.join(bad, "query", "left").select("query", F.bround("ndcg", 6).alias("ndcg"), F.bround("precision", 6).alias("precision"), F.coalesce("noise_failure", F.lit(False)).alias("noise_failure"))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\\b(?:library|package|module|sdk|client|wrapper)\\b') THEN 'library' WHEN regexp_matches(lower(text), '\\b(?:tutorial|example|demo|starter|boilerplate|template|learn)\\b') THEN 'example' WHEN regexp_matches(lower(text), '\\b(?:cli|tool|utility|script|automation)\\b') THEN 'tool' WHEN regexp_matches(lower(text), '\\b(?:framework|stack|platform|engine)\\b') THEN 'framework' WHEN regexp_matches(lower(text), '\\b(?:model|dataset|weights|checkpoint)\\b') THEN 'model' ELSE 'general' END AS intent FROM documents".replace("\\\\", "\\"))
def intents(spark, sf):
    """Intent of every text by its first matching word set."""
    return table(spark, sf, "documents").select("doc_id", C.intent(F.col("text")).alias("intent"))


_FAIL = ", ".join(f"CASE WHEN regexp_matches(text, {_quoted(p)}) THEN {{'c': {c}::DOUBLE, 'o': {-k}, 'n': '{n}'}} END" for k, (p, n, c) in enumerate(fixed.FAILURE_RULES))


@query(f"WITH t AS (SELECT doc_id, list_max(list_filter([{_FAIL}], lambda x: x IS NOT NULL)) AS b FROM documents) SELECT doc_id, coalesce(b.n, 'unknown') AS class, coalesce(b.c, 0.0)::DOUBLE AS confidence FROM t")
def failure_triage(spark, sf):
    """Failure class of every text taken as a message."""
    return table(spark, sf, "documents").select("doc_id", C.failure_class(F.col("text")).alias("f")).select("doc_id", "f.class", "f.confidence")


@query("SELECT a.vec_id, b.vec_id AS other, round_even(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_neighbours(spark, sf):
    """Cosine of each vector and the next."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("b"))
    return e.join(nxt, "vec_id").select("vec_id", "other", F.bround(search.cosine(F.col("embedding"), F.col("b")), 6).alias("cosine"))
