"""Column functions over ARRAY<FLOAT> vectors; sums are taken in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Null where the sizes differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), _sum(products))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.sqrt(_sum(squares)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is zero, null where the sizes differ."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.when(F.size(a) == F.size(b), 0.0))


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    return {"cosine": cosine, "dot": dot, "euclidean": lambda x, y: 1 / (1 + l2(x, y))}[metric](a, b)


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays as it is.  Select the norm first for wide vectors."""
    scaled = F.zip_with(a, F.array_repeat(norm(a), F.size(a)), lambda x, n: x / n)
    return F.when(norm(a) == 0, a.cast("array<double>")).otherwise(scaled)


def vector_stats(a: Column) -> Column:
    n, d = F.size(a), a.cast("array<double>")
    mean = _sum(d) / n
    square = _sum(F.transform(d, lambda x: x * x)) / n
    return F.struct(n.alias("dims"), mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("stddev"), F.array_min(d).alias("min"), F.array_max(d).alias("max"), norm(a).alias("norm"))


def valid(a: Column, dims: int) -> Column:
    return (F.size(a) == dims) & ~F.exists(a, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))


def prune_weights(a: Column, threshold: float) -> Column:
    return F.transform(a, lambda x: F.when(F.abs(x) < threshold, 0.0).otherwise(x))


def quantize(a: Column, bits: int) -> Column:
    """Cut (not rounded) to multiples of 2**-bits."""
    scaled = lambda x: x.cast("double") * 2**bits
    return F.transform(a, lambda x: F.when(x >= 0, F.floor(scaled(x))).otherwise(F.ceil(scaled(x))) / 2**bits)
