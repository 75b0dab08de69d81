"""Shared-folder scratch tables: lineage is cut by writing Parquet where every executor can read it."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from quillon.sources.scratch import scratch_dir
from quillon.sources.store import Files

_collector: ContextVar[list[str] | None] = ContextVar("collector", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns the table read back; survives lost executors. It goes when the application ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    if (held := _collector.get()) is not None:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores added until none of them is among ``columns`` (case doesn't count)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


@contextmanager
def collecting(into: list[str]) -> Iterator[None]:
    """Notes the tables written inside, so that their maker can delete them when nothing reads them any more."""
    token = _collector.set(into)
    try:
        yield
    finally:
        _collector.reset(token)


def delete(spark: SparkSession, paths: list[str]) -> None:
    files = Files(spark)
    while paths:
        files.delete(paths.pop())
