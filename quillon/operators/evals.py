"""Retrieval quality from ranked results (query_id, id, rank) and the truth (query_id, id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gold_metrics(ranked: DataFrame, gold: DataFrame, k: int, query_id: str = "query_id", id_col: str = "id", digits: int = 6) -> DataFrame:
    """One row (queries, r1, rk, mrr, ndcg) for one gold id a query."""
    hit = gold.select(query_id, id_col).join(ranked.select(query_id, id_col, "rank").where(F.col("rank") <= k), [query_id, id_col], "left")
    found = F.col("rank").isNotNull()
    mean = lambda x: F.round(F.avg(x), digits)
    return hit.agg(
        F.count("*").alias("queries"),
        mean(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)).alias("r1"),
        mean(F.when(found, 1.0).otherwise(0.0)).alias("rk"),
        mean(F.when(found, 1 / F.col("rank")).otherwise(0.0)).alias("mrr"),
        mean(F.when(found, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("ndcg"),
    )


def recall(found: DataFrame, truth: DataFrame, query_id: str = "query_id", id_col: str = "id", digits: int = 6) -> DataFrame:
    """One row (recall): the share of the true pairs that were found."""
    t = truth.select(query_id, id_col).distinct()
    hit = t.join(found.select(query_id, id_col).distinct().withColumn("hit", F.lit(1.0)), [query_id, id_col], "left")
    return hit.agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), digits).alias("recall"))


def latency_percentiles(times: DataFrame, col: str = "ms") -> DataFrame:
    return times.agg(*[F.percentile(col, p / 100).alias(f"p{p}") for p in (50, 95, 99)])
