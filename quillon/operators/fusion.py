"""Reciprocal rank fusion of ranked lists, and hybrid dense plus keyword search."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.topk import rank_by


def rrf(lists: list[tuple[DataFrame, float]], k: float = 60, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keys, score): the sum over lists of weight / (k + rank), ranks from 1; lists of weight 0 are left out."""
    if not lists:
        raise ValueError("at least one list is needed")
    used = [(df, w) for df, w in lists if w != 0] or [(lists[0][0].where("false"), 0.0)]
    parts = [df.select(*keys, (F.lit(float(w)) / (F.lit(float(k)) + F.col("rank"))).alias("part")) for df, w in used]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum("part").alias("score"))


@dataclass(frozen=True)
class Hybrid:
    text: str | None
    weight: float = 0.5
    rrf_k: float = 60
    oversample: int = 4

    @staticmethod
    def parse(options: dict) -> Hybrid:
        unknown = set(options) - {"text", "weight", "rrf_k", "oversample"}
        if unknown:
            raise ValueError(f"unknown hybrid options {sorted(unknown)}")
        if "text" not in options:
            raise ValueError("hybrid needs text")
        h = Hybrid(**options)
        if not 0 <= h.weight <= 1:
            raise ValueError("weight must be in [0, 1]")
        if h.rrf_k < 1 or h.oversample < 1:
            raise ValueError("rrf_k and oversample must be at least 1")
        return h


def fuse(dense: DataFrame, sparse: DataFrame, k: int, weight: float = 0.5, rrf_k: float = 60, keys: tuple[str, ...] = ("id",), digits: int | None = None) -> DataFrame:
    """(keys, score, rank) of the k best by the fusion of two ranked lists; ``weight`` is the keyword list's."""
    out = rrf([(dense, 1 - weight), (sparse, weight)], rrf_k, keys)
    if digits is not None:
        out = out.withColumn("score", F.round("score", digits))
    return rank_by(out, F.col("score"), False, keys[-1], keys[:-1]).where(F.col("rank") <= k)
