"""Queries that write an index first and then read it: full text, vectors by list, and the choice of files to read."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed
from ..catalog import query, table
from ..operators import candidates, fulltext, vectors
from ..operators.cut import shared_folder

SEARCHES = ("was ouen", '"of the" nd', '"is and" or estion or ndon', "re th -the", '"in the" -"of the" -an', "-the -le", "zzz")


def _unit_sql(words: tuple[str, ...]) -> str:
    """Places (from 0) where a word or phrase starts."""
    return f"list_filter(range(0, len(ws)), lambda i: ws[i + 1:i + {len(words)}] = [{', '.join(repr(w) for w in words)}])"


def _search_sql(text: str) -> str:
    groups = fulltext.websearch(text)
    units = [u for g in groups for u in g if not u.without]
    match = " OR ".join("(" + " AND ".join(f"{'NOT ' * u.without}len({_unit_sql(u.words)}) > 0" for u in g) + ")" for g in groups)
    one = lambda u: f"coalesce((SELECT CASE WHEN len(p) > 0 THEN 0.1::DOUBLE * list_sum(list_transform(range(1, len(p) + 1), lambda j: 1.0::DOUBLE / (j * j))) / 1.6449340668482264::DOUBLE * (1 + 1.0::DOUBLE / (1 + p[1])) / 2 END FROM (SELECT {_unit_sql(u.words)} AS p)), 0)"
    score = f"({' + '.join(map(one, units)) or '0'}) / {max(1, len(units))}"
    return f"SELECT '{text}' AS query, doc_id, round_even({score}, 9)::DOUBLE AS score FROM w WHERE {match}"


@query(rf"WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{fulltext.WORD}') AS ws FROM documents) " + " UNION ALL ".join(map(_search_sql, SEARCHES)))
def full_text_search(spark, sf):
    """Documents that websearch queries match, with their scores, from a positional inverted index."""
    path = shared_folder(spark)
    fulltext.build(table(spark, sf, "documents"), "doc_id", "text", path)
    out = None
    for text in SEARCHES:
        hits = fulltext.search(spark, path, text).select(F.lit(text).alias("query"), F.col("key").alias("doc_id"), "score")
        out = hits if out is None else out.unionByName(hits)
    return out


def _neighbours(spark, sf, probes: int | None) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    index = vectors.build(rows, "vec_id", "embedding", shared_folder(spark), lists=16)
    asked = rows.filter(vectors.usable(F.col("embedding")) & (F.col("vec_id") % 100 == 0)).select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    found = vectors.nearest(spark, index, asked, 10, probes)
    return found.select("query", "rank", F.col("key").alias("vec_id"), F.bround("score", 6).alias("score"))


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query, v.vec_id, list_cosine_similarity(q.e, v.e) AS c FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, vec_id) AS rank FROM s)
SELECT query, rank::INT AS rank, vec_id, round_even(c, 6) AS score FROM r WHERE rank <= 10"""
)
def exact_list_neighbours(spark, sf):
    """The 10 nearest rows by cosine of each id divisible by 100, every list opened."""
    return _neighbours(spark, sf, 16)


@query()
def list_neighbours(spark, sf):
    """The same from as many lists as the sample says (S6); approximate, so its recall is tested."""
    return _neighbours(spark, sf, None)


#: Listings whose repositories end in every tier: the first full, the first short, only broad folders, only the top, always-read files, nothing.
_TREE = """(SELECT l_suppkey AS repo_id, l_orderkey * 10 + l_linenumber AS place, CASE WHEN l_linenumber = 7 THEN 'tree' ELSE 'blob' END AS type,
  CASE l_suppkey % 7 WHEN 0 THEN 'app/r' || {id} || '.py' WHEN 1 THEN CASE WHEN l_orderkey % 40 = 1 THEN 'app/r' || {id} || '.py' WHEN l_orderkey % 9 = 0 THEN 'lib/' || {id} || '/main.py' ELSE 'lib/x' || {id} || '.py' END
  WHEN 2 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'docs/e' || {id} || '.py' ELSE 'lib/x' || {id} || '.py' END WHEN 3 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'run' || {id} || '.py' ELSE 'lib/x' || {id} || '.py' END
  WHEN 4 THEN CASE WHEN l_orderkey % 3 = 0 THEN 'm' || {id} || '/urls.py' ELSE 'core/x' || {id} || '.py' END WHEN 5 THEN 'x' || {id} || '.md' ELSE CASE WHEN l_orderkey % 97 = 0 THEN 'app/r' || {id} || '.py' ELSE 'docs/e' || {id} || '.py' END END AS path
  FROM lineitem)""".replace("{id}", "(l_orderkey * 10 + l_linenumber)")


def _candidates_sql(framework: str) -> str:
    known = fixed.ROUTE_SOURCES[framework]
    among = lambda x, xs: f"{x} IN ({', '.join(map(repr, xs))})" if xs else "false"
    below = lambda xs: f"len(list_filter(dirs, lambda d: {among('d', xs)})) > 0"
    return f"""SELECT '{framework}' AS framework, repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY step, front DESC, CASE WHEN front THEN -place ELSE place END)::INT AS rank, path FROM (
  SELECT *, CASE WHEN first THEN 0 WHEN named AND n_first < 8 THEN 1 WHEN n_first = 0 AND n_named = 0 AND broad THEN 2 WHEN n_first = 0 AND n_named = 0 AND n_broad = 0 AND at_top THEN 3 END AS step FROM (
    SELECT *, count(*) FILTER (first) OVER (PARTITION BY repo_id) AS n_first, count(*) FILTER (named) OVER (PARTITION BY repo_id) AS n_named, count(*) FILTER (broad) OVER (PARTITION BY repo_id) AS n_broad FROM (
      SELECT repo_id, place, path, {among("name", known["always"])} AS front, {among("name", known["names"])} AS named, fits AND {below(fixed.BROAD_DIRS)} AS broad, fits AND len(dirs) = 0 AS at_top,
        {among("name", known["always"])} OR (len(dirs) = 0 AND {among("name", known["names"])}) OR ({below(known["dirs"])} AND fits) AS first
      FROM (SELECT *, regexp_matches(name, '{known["files"]}') AS fits FROM (SELECT *, string_split(path, '/')[-1] AS name, string_split(path, '/')[:-2] AS dirs FROM {_TREE} WHERE type = 'blob')))))
  WHERE step IS NOT NULL QUALIFY rank <= 30"""


@query(" UNION ALL ".join(map(_candidates_sql, ("fastapi", "django"))))
def route_candidates(spark, sf):
    """Files that each repository is read for routes, in order, by four tiers (2.12)."""
    table(spark, sf, "lineitem").createOrReplaceTempView("_tree_lines")
    tree = spark.sql(_TREE.strip().removeprefix("(").removesuffix(")").replace("FROM lineitem", "FROM _tree_lines"))
    each = [candidates.route_files(tree, f).select(F.lit(f).alias("framework"), "repo_id", "rank", "path") for f in ("fastapi", "django")]
    return each[0].unionByName(each[1])
