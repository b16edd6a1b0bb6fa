"""Arithmetic on vectors (arrays of numbers), in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """cosine, l2 (1 / (1 + squared distance)) or cosine_distance (1 - distance, which is the cosine again)."""
    if metric == "l2":
        return 1 / (1 + squared_distance(a, b))
    if metric in ("cosine", "cosine_distance"):
        return dot(a, b) / (norm(a) * norm(b))
    raise ValueError(metric)


def aesthetic_score(v: Column, positive: Column, negative: Column, scale: float = 1.0) -> Column:
    """Share of the first of two prompts: softmax of two scaled cosines, kept in 0 to 1."""
    p = 1 / (1 + F.exp(scale * (similarity(v, negative) - similarity(v, positive))))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
