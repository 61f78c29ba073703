"""Stages: tables that are written once and read by several branches of a plan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the warehouse where that is unset."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    return known or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/stages"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: its rows are computed once, and survive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
