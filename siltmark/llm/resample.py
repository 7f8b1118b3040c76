"""Importance resampling of documents toward a target distribution of n-grams.

A position table holds every word of every document with its place; a window's lead() per document gives the words that
follow, and concatenating them gives the n-grams of each order. N-grams are hashed to buckets, buckets are counted over
the corpus and over the target, and each document weighs the sum of its buckets' gains (the logarithm of how much more
common a bucket is in the target). Adding Gumbel noise drawn from the document's id and taking the highest sums draws
without replacement in proportion to the weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import _shared as S

#: Words are runs of ASCII digits, lower-case ASCII letters and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Gains and noise are thousandths, rounded down, so that sums are whole and the same in any order.
SCALE = 1000
#: Bytes of the scored table that one range of ranks should hold.
RANGE_BYTES = 64 << 20


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def positions(rows: DataFrame, text: str = "text") -> DataFrame:
    """The position table: every column of rows but the text, with (pos, word) of each word; one row of nulls where there is none."""
    rest = [c for c in rows.columns if c != text]
    return rows.select(*rest, F.posexplode_outer(words(F.col(text))).alias("pos", "word"))


def ngrams(rows: DataFrame, orders: int, row: str, text: str = "text") -> DataFrame:
    """rows' other columns with (pos, gram) of every run of 1 to ``orders`` words, joined by one space; a null gram where a text has no word.

    Order 1 needs no window. Longer ones take one window per document, which holds no more than its own text.
    """
    table = positions(rows, text)
    rest = [c for c in table.columns if c not in ("pos", "word")]
    if orders == 1:
        return table.select(*rest, "pos", F.col("word").alias("gram"))
    w = Window.partitionBy(row).orderBy("pos")
    grams = [F.col("word")]
    for n in range(1, orders):
        grams.append(F.concat(grams[-1], F.lit(" "), F.lead("word", n).over(w)))
    # a run that would pass the end is null and goes; the first of a text without words stays
    table = table.withColumn("gram", F.array_compact(F.array(*grams)))
    return table.select(*rest, "pos", F.explode_outer("gram").alias("gram"))


def bucket_of(gram: Column, buckets: int) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes, modulo ``buckets``."""
    return (F.crc32(gram.cast("binary")) % buckets).cast("int")


def bucket_counts(rows: DataFrame, orders: int, buckets: int, row: str, text: str = "text") -> DataFrame:
    """(bucket, n) of all n-grams of rows: counted within tasks first, so the exchange has at most ``buckets`` rows a task."""
    grams = ngrams(rows.select(row, text), orders, row, text).filter("gram is not null")
    return grams.select(bucket_of(F.col("gram"), buckets).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket that the corpus has: log of target share over corpus share, one added to each count."""
    total = lambda d, name: d.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias(name))
    both = corpus.select("bucket", F.col("n").alias("s")).join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
    both = both.crossJoin(F.broadcast(total(corpus, "all_s").crossJoin(total(target, "all_t"))))  # one row of totals
    ratio = (F.coalesce("t", F.lit(0)).cast("double") + 1) * (F.col("all_s") + buckets) / ((F.col("s").cast("double") + 1) * (F.col("all_t") + buckets))
    return both.select("bucket", F.floor(SCALE * F.log(ratio)).cast("long").alias("gain"))


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the key's SHA-256 under a seed; a null key counts as the word null."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-SCALE * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order: list[Column], root: str, name: str = "rank") -> DataFrame:
    """rows with their place, from 1, in a total order, without one task that sees all of them.

    Rows are dealt to ranges and sorted in each; a range's first place is the number of rows in the ranges before it,
    of which the driver reads one number each.
    """
    spark = rows.sparkSession
    known = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(known, 1 << 50) // RANGE_BYTES))
    at = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = at.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at"))
    at = S.materialised(at, f"{root}/ranges")
    sizes = dict(at.groupBy("_part").count().collect())
    before, so_far = [], 0
    for p in sorted(sizes):
        before.append((p, so_far))
        so_far += sizes[p]
    first = spark.createDataFrame(before, "_part int, _first long")
    return at.join(F.broadcast(first), "_part").select(*rows.columns, (F.col("_first") + F.col("_at") + 1).alias(name))


def weights(docs: DataFrame, target: DataFrame, root: str, orders: int = 2, buckets: int = 10_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_features, weight), a row for each row of docs: the sum of gains over its n-grams, repeats counted.

    Passes over the texts twice, for the counts (written to root) and for the sums, and shuffles no text: a document's n-grams are made in
    one task and are summed there. The gains have at most ``buckets`` rows, a parameter, and are broadcast. A null
    text, or one without words, has 0 of each; rows of equal keys are rows of their own; other columns are ignored;
    an empty target makes all gains those of absent buckets; an empty table gives none.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    aim = target.select(F.monotonically_increasing_id().alias("_row"), F.col(text).cast("string").alias("_text"))
    counts = [S.materialised(bucket_counts(d, orders, buckets, "_row", "_text"), f"{root}/counts{k}") for k, d in enumerate((rows, aim))]
    gain = gains(*counts, buckets)
    grams = ngrams(rows, orders, "_row", "_text").withColumn("bucket", bucket_of(F.col("gram"), buckets))
    found = grams.join(F.broadcast(gain), "bucket", "left").groupBy("_row", "_key")
    single = F.when(F.col("gram").isNotNull() & ~F.col("gram").contains(" "), 1)  # words hold no blanks
    return found.agg(F.count(single).alias("n_words"), F.count("gram").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight")).select(F.col("_key").alias(key), "n_words", "n_features", "weight", "_row")


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), orders: int = 2, buckets: int = 10_000, least_words: int = 20, seed: int = 2024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Draws share[0] of share[1] of the documents with at least ``least_words`` words, without replacement, by weight.

    Returns (key, n_words, n_features, weight, score, rank) of every row; rank counts from 1 by falling score, ties to
    the smaller key (null first), then to the row that comes first, and is null for rows that are not drawn. Nulls,
    repeated keys and empty tables: see weights().
    """
    root = S.shared_root(docs.sparkSession)
    scored = weights(docs, target, root, orders, buckets, key, text)
    scored = scored.withColumn("score", F.col("weight") + noise(F.col(key), seed)).withColumn("_fit", F.col("n_words") >= least_words)
    scored = S.materialised(scored, f"{root}/scored")
    draw = scored.filter("_fit").count() * share[0] // share[1]
    order = [F.desc("_fit"), F.desc("score"), F.asc(key), F.asc("_row")]
    places = ranked(scored, order, root, "_place")
    return places.select(key, "n_words", "n_features", "weight", "score", F.when(F.col("_place") <= draw, F.col("_place")).alias("rank"))
