"""Cutting the lineage of iterated plans, in the folder that executors and the driver share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder and read from there, so that a lost executor costs only its tasks.

    The folder is the session's spark.checkpoint.dir. Where that is unset, a session on one machine takes a folder of
    its warehouse; any other has to name one.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        sc.setCheckpointDir(top)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A new folder's address below the session's checkpoint folder, for tables that several plans read."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return f"{top.rstrip('/')}/siltmark-{uuid.uuid4().hex}"
