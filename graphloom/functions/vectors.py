"""Vector functions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a side is null, of another length or zero."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


def fit(a: Column, dim: int) -> Column:
    """A vector of ``dim`` components: the same if it has them, else cut or padded with zeros and scaled to length 1."""
    padded = F.slice(F.concat(F.transform(a, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), dim)), 1, dim)
    size = norm(padded)
    return F.when(F.size(a) == dim, F.transform(a, lambda x: x.cast("double"))).otherwise(
        F.when(size > 0, F.transform(padded, lambda x: x / size)).otherwise(padded)
    )


def of_dim(a: Column, dim: int) -> Column:
    """Null where the vector has another number of components."""
    return F.when(F.size(a) == dim, a)
