"""Cosine search by inverted lists: rows stored by their nearest centroid, of which a query opens the nearest few.

Centroids come from k-means on a bounded sample; every row is stored. How many lists a query opens is measured on the
sample, so that the share of true neighbours found there reaches a target. Lists of any length are compared in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Rows of the sample for each list, rows of a block of a list, and queries that meet a block at once.
SAMPLE_PER_LIST, BLOCK_ROWS, BLOCK_QUERIES = 64, 16_384, 4_096
#: Sampled rows that are tried as queries.
TRIED = 256


@dataclass(frozen=True)
class Lists:
    """An index: where it is stored, its centroids, and the lists to open for the target."""

    path: str
    centroids: np.ndarray
    probes: int


def usable(v: Column) -> Column:
    """Whether a vector has a direction: not null, all components finite, one not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def unit(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow list column of one length as rows of unit length."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    x = np.asarray(col.flatten()).astype(np.float64).reshape(len(col), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def build(rows: DataFrame, key: str, vector: str, path: str, lists: int = 100, k: int = 10, target: float = 0.95, spread: int = 4, seed: int = 1) -> Lists:
    """Stores rows' usable vectors below path by list and returns the index; equal keys and other lengths than the first are not allowed.

    The sample has at most ``lists * SAMPLE_PER_LIST`` rows, those of smallest hash of their key; every row is stored.
    """
    spark = rows.sparkSession
    rows = rows.filter(usable(F.col(vector))).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    some = rows.orderBy(F.xxhash64("key"), "key").limit(lists * SAMPLE_PER_LIST).select(F.transform("v", lambda x: x / norm).alias("v")).toPandas()
    if not len(some):
        return Lists(path, np.zeros((0, 0)), 0)
    x = np.array(some.v.tolist())
    fitted = KMeans(k=min(lists, len(x)), seed=seed, maxIter=10, featuresCol="f").fit(spark.createDataFrame(some).select(array_to_vector("v").alias("f")).coalesce(1))
    centers = np.array(fitted.clusterCenters())
    centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)

    def place(it):
        for rb in it:
            at = np.argmax(unit(rb.column("v")) @ centers.T, axis=1).astype(np.int32) if rb.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([rb.column("key"), rb.column("v"), pa.array(at)], names=["key", "v", "list"])

    placed = rows.mapInArrow(place, f"key {dict(rows.dtypes)['key']}, v array<double>, list int")
    dealt = placed.repartition(max(lists // 4, 1) * spread, "list", F.pmod(F.xxhash64("key"), F.lit(spread)))
    dealt.write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
    return Lists(path, centers, lists_to_open(x, centers, k, target))


def lists_to_open(x: np.ndarray, centers: np.ndarray, k: int, target: float) -> int:
    """The fewest lists whose opening finds ``target`` of the true k neighbours of sampled rows among the sample."""
    q = x[:: max(1, len(x) // TRIED)]
    near = q @ x.T
    near[np.arange(len(q)), np.arange(0, len(x), max(1, len(x) // TRIED))[: len(q)]] = -np.inf
    true = np.argsort(-near, axis=1)[:, : min(k, max(1, len(x) - 1))]
    rank = np.argsort(np.argsort(-(q @ centers.T), axis=1), axis=1)
    opened = np.take_along_axis(rank, np.argmax(x @ centers.T, axis=1)[true], axis=1)
    share = np.searchsorted(np.sort(opened.ravel()), np.arange(1, len(centers) + 1)) / opened.size
    return int(np.argmax(share >= target)) + 1


def nearest(spark: SparkSession, index: Lists, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
    """(query, rank, key, score): each query's k stored rows of greatest cosine found, ties to the smaller key, its own key left out.

    queries: (query, v), usable vectors. With all lists opened the result is exact. A list's rows meet its queries in
    blocks, each in one task; a block sends k rows for each query.
    """
    probes = min(probes or index.probes, len(index.centroids))
    centers = index.centroids
    kind = dict(queries.dtypes)["query"]
    out = f"query {kind}, key {kind}, score double"
    if not len(centers):
        return spark.createDataFrame([], f"query {kind}, rank int, key {kind}, score double")
    stored = spark.read.parquet(f"{index.path}/rows")
    sizes = F.broadcast(stored.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")))  # a row a list
    asked_blocks = max(1, -(-queries.count() * probes // len(centers) // BLOCK_QUERIES))

    def open_lists(it):
        for rb in it:
            near = np.argsort(-(unit(rb.column("v")) @ centers.T), axis=1, kind="stable")[:, :probes].astype(np.int32) if rb.num_rows else np.zeros((0, probes), np.int32)
            row = pa.array(np.repeat(np.arange(rb.num_rows), probes))
            yield pa.RecordBatch.from_arrays([rb.column("query").take(row), rb.column("v").take(row), pa.array(near.ravel())], names=["query", "v", "list"])

    asked = queries.select("query", F.col("v").cast("array<double>").alias("v")).mapInArrow(open_lists, f"query {kind}, v array<double>, list int")
    asked = asked.join(sizes, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("ask", F.pmod(F.xxhash64("query"), F.lit(asked_blocks)).cast("int")).drop("blocks")
    held = stored.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int")).withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(asked_blocks - 1)))).drop("blocks")

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query": a.column("query").slice(0, 0), "key": b.column("key").slice(0, 0), "score": pa.array([], pa.float64())})
        b = b.sort_by("key")  # equal scores: the smaller key comes first
        y, keys, asks = unit(b.column("v")), b.column("key").combine_chunks(), a.column("query").combine_chunks()
        own = pa.compute.index_in(asks, keys)
        rows, cols, scores = [], [], []
        for s in range(0, a.num_rows, 512):
            near = unit(a.column("v").slice(s, 512)) @ y.T
            at = np.asarray(own.slice(s, 512).fill_null(-1))
            near[np.flatnonzero(at >= 0), at[at >= 0]] = -np.inf
            top = np.argsort(-near, axis=1, kind="stable")[:, :k]
            got = np.take_along_axis(near, top, 1)
            r, c = np.nonzero(np.isfinite(got))
            rows.append(r + s)
            cols.append(top[r, c])
            scores.append(got[r, c])
        return pa.table({"query": asks.take(pa.array(np.concatenate(rows))), "key": keys.take(pa.array(np.concatenate(cols))), "score": pa.array(np.concatenate(scores))})

    by = ["list", "block", "ask"]
    found = asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(best, out)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "rank", "key", "score")
