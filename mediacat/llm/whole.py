"""Vectors of whole numbers of any size: floor(scale * x), their exact inner products, and those as something Spark can sort.

Such numbers are exact as doubles. A product of two rows whose components stay under narrow() is exact in doubles too; only the other
rows need Python's integers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Stands for a null vec_id: after all others.
NAMELESS = MOST


def scaled(vector: Column, scale: int) -> Column:
    """array<double> of floor(scale * x); null for vectors that are null or hold a null or non-finite component, also after scaling."""
    x = F.transform(vector, lambda c: c.cast("double") * scale)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    down = lambda c: c - c % 1.0 - F.when(c % 1.0 < 0, 1.0).otherwise(0.0) + 0.0  # noqa: E731  floor() gives a long; no minus zero
    return F.when(fine, F.transform(x, down))


def narrow(dim: Column) -> Column:
    """The largest component, either way, with which products of this many components add up without rounding."""
    return F.sqrt(F.lit(float(1 << 52)) / F.greatest(dim, F.lit(1)))


def is_narrow(v: Column) -> Column:
    most = F.aggregate(v, F.lit(0.0), lambda a, c: F.greatest(a, F.abs(c)))
    return most < narrow(F.size(v))


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all rows of b as Python integers."""
    left = [[int(c) for c in row] for row in a]
    right = [[int(c) for c in row] for row in b]
    out = np.empty((len(left), len(right)), object)
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            out[i, j] = sum(p * q for p, q in zip(x, y, strict=True))
    return out


def sort_key(n: int) -> tuple[int, bytes | None, int]:
    """(beyond, key, score): score the nearest long; beyond 1 or -1 if n is no long, and then key sorts as n does."""
    if LEAST <= n <= MOST:
        return 0, None, n
    size = (abs(n).bit_length() + 7) // 8
    key = size.to_bytes(4, "big") + abs(n).to_bytes(size, "big")
    return (1, key, MOST) if n > 0 else (-1, bytes(255 - x for x in key), LEAST)


def best_first() -> list[Column]:
    """How scores are sorted, those beyond a long by their keys; then smaller ids."""
    return [F.desc("beyond"), F.desc("key"), F.desc("score"), F.asc("vec_id")]


def from_key(beyond: int, key: bytes | None, score: int) -> int:
    """The number that sort_key() was given."""
    if not beyond:
        return score
    key = key if beyond > 0 else bytes(255 - x for x in key)
    return beyond * int.from_bytes(key[4:], "big")


def taking_part(vectors: DataFrame, scale: int, *columns: Column) -> DataFrame:
    """(vec_id, v array<double>, the columns) of the rows whose vectors take part; null ids become NAMELESS."""
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NAMELESS)).alias("vec_id"), scaled(F.col("embedding"), scale).alias("v"), *columns)
    return rows.where("v is not null")
