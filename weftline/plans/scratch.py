"""Intermediate tables of iterative operators: Parquet in the cluster's shared checkpoint folder, so lineage ends and executors can be lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:  # only where the session names none, as in tests
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_root(spark)}/weftline-{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    at = folder(spark, "t")
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
