"""Registry of the engine's queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """df dealt evenly, or by keys, to the session's shuffle partitions, and ``least`` at least: a small file is one task, whatever is then made of each of its rows."""
    return df.repartition(max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def load() -> None:
    """Imports the modules that register queries."""
    from .plans import access, corpus, facts, imports, indexes, lookups, records, reviews, sinks, sources, storage, stores, syntax  # noqa: F401

load()
