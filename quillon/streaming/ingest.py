"""Structured Streaming into a collection: each micro-batch is one upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillon.sources.store import Collection


def stream_upserts(source: DataFrame, collection: Collection, checkpoint: str, order_col: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that upserts (id, vector[, metadata, document]) rows; of one id in a micro-batch the row last
    by ``order_col`` counts. A batch that is replayed after a failure upserts the same rows again, with the same outcome."""

    def apply(batch: DataFrame, _: int) -> None:
        if order_col is not None:
            batch = batch.withColumn("pos", batch[order_col])
        collection.refresh().write(batch, "upsert")

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
