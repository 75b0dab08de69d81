"""The folder for intermediate tables: spark.checkpoint.dir, which all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The configured folder; in local mode without one, a temporary folder; on a cluster it must be set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if getattr(context, "_quillon_dir", None) is None:
        context._quillon_dir = "file://" + tempfile.mkdtemp(prefix="quillon-")
    return context._quillon_dir


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, so that what made it isn't run again."""
    path = f"{scratch_dir(df.sparkSession)}/cut/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
