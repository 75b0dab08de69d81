"""Vector arithmetic as Column expressions (arrays of double), and the three metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("ip", "cosine", "l2")


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Similarity, 0 where either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def score(metric: str, a: Column | str, b: Column | str) -> Column:
    """What users see: similarity for ip and cosine, distance for l2."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {METRICS}")
    return {"ip": dot, "cosine": cosine, "l2": euclidean}[metric](a, b)


def ascending(metric: str) -> bool:
    """Whether the best score is the smallest."""
    return metric == "l2"


def normalized(a: Column | str) -> Column:
    size = norm(a)
    return F.when(size > 1e-10, F.transform(a, lambda x: x / size)).otherwise(F.col(a) if isinstance(a, str) else a)


def is_finite(a: Column | str) -> Column:
    return ~F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def relevance(metric: str, value: Column) -> Column:
    """A score rescaled to [0, 1]."""
    if metric == "l2":
        return 1 / (1 + value)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value + 1) / 2))
