"""Chunks and their search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .cut import cut


def chunks(results: DataFrame, key: str) -> DataFrame:
    """(key, chunk_type, chunk_text) of results (key, label, summary, frameworks, npm, python): texts cut at 800, lists at 30."""
    joined = lambda head, c: F.concat(F.lit(head), F.array_join(F.slice(c, 1, 30), ", "))
    items = F.array(
        F.when(F.coalesce(F.col("summary"), F.lit("")) != "", F.struct(F.lit("architecture").alias("t"), F.left("summary", F.lit(800)).alias("x"))),
        F.when(F.size("frameworks") > 0, F.struct(F.lit("stack").alias("t"), F.concat("label", F.lit(" uses "), F.array_join("frameworks", ", ")).alias("x"))),
        F.when(F.size("npm") > 0, F.struct(F.lit("dependency").alias("t"), joined("npm: ", "npm").alias("x"))),
        F.when(F.size("python") > 0, F.struct(F.lit("dependency").alias("t"), joined("python: ", "python").alias("x"))),
    )
    return results.select(key, F.explode(F.array_compact(items)).alias("c")).select(key, F.col("c.t").alias("chunk_type"), F.col("c.x").alias("chunk_text"))


def contains(rows: DataFrame, text: str, query: str) -> DataFrame:
    """Case-blind substring search, score 1."""
    return rows.filter(F.contains(F.lower(text), F.lit(query.lower()))).withColumn("score", F.lit(1.0))


def two_scopes(own: DataFrame, shared: DataFrame, key: list[str], tie: str, n: int) -> DataFrame:
    """Hits of both scopes, one of each key, the own scope's first, best n."""
    both = own.withColumn("_s", F.lit(0)).unionByName(shared.withColumn("_s", F.lit(1)))
    w = Window.partitionBy(*key).orderBy("_s", F.desc("score"), tie)
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_s").orderBy(F.desc("score"), tie).limit(n)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def sentences(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos from 0, sentence) of every text: cut at blanks after a full stop, exclamation or question mark; empty ones go."""
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return rows.select(key, F.posexplode(F.filter(trimmed, lambda x: x != "")).alias("pos", "sentence"))


#: Lengths of the strings that tie a fragment to the traces that may hold it.
ANCHORS = (1, 2, 4, 8)


def _anchors(text: Column, size: Column | int) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substr(text, i, size)))


def untraced(claims: DataFrame, traces: DataFrame, claim: str, trace: str, head: int = 40) -> DataFrame:
    """Claims whose beginning (``head`` characters, in lower case) stands in no trace.

    A fragment is tied to the traces by one string of it: of its strings of 8 characters (4, 2 or 1 if it is shorter)
    the one that the fewest traces hold. Only traces that hold that are compared. Equal fragments and equal traces are
    compared once; nothing is broadcast or crossed.
    """
    rows = claims.withColumn("_f", F.trim(F.lower(F.left(F.col(claim), F.lit(head)))))
    held = cut(traces.select(F.lower(F.col(trace)).alias("_t")).filter("_t is not null").distinct()).withColumn("_id", F.monotonically_increasing_id())
    asked = rows.select("_f").filter("_f is not null").distinct()
    posting = held.select("_id", F.explode(F.array_distinct(F.flatten(F.array(*(_anchors(F.col("_t"), n) for n in ANCHORS))))).alias("_a"))
    common = posting.groupBy("_a").agg(F.count(F.lit(1)).alias("_n"))
    size = F.greatest(*(F.when(F.length("_f") >= n, F.lit(n)).otherwise(0) for n in ANCHORS))
    # most fragments go by one of their strings, so that only the rest are looked up by all
    whole = asked.filter("_f <> ''").withColumn("_a", F.right("_f", size))
    likely = whole.join(common, "_a", "left_semi").select("_f")
    rarest = likely.select("_f", F.explode(_anchors(F.col("_f"), size)).alias("_a")).join(common, "_a", "left")
    # a string that no trace holds settles it
    rarest = rarest.groupBy("_f").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_a").alias("a"))).alias("_r")).filter("_r.n > 0").select("_f", F.col("_r.a").alias("_a"))
    found = rarest.join(posting, "_a").join(held, "_id").filter(F.contains(F.col("_t"), F.col("_f"))).select("_f").distinct()
    return rows.join(found, "_f", "left_anti").drop("_f")
