"""Makes the package importable in Python workers that don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package's source to the executors, once for a context; the driver's file server carries it."""
    context = spark.sparkContext
    if getattr(context, "_quillon_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quillon-src-"), "quillon_src.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("quillon", os.path.relpath(full, here)))
    context.addPyFile(path)
    context._quillon_shipped = True
