"""Vector arithmetic on arrays, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Scalar product; null if either is null, and where the lengths differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a vector is all zero."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).when(scale.isNotNull(), 0.0)


def mean_vector(vector: str, dim: int) -> Column:
    """Aggregate: componentwise mean, as one aggregate per component so that it is combined map-side."""
    return F.array(*(F.avg(F.col(vector)[i].cast("double")) for i in range(dim)))


def usable(vector: str, dim: int) -> Column:
    """Not null, of ``dim`` components and not all zero."""
    return (F.size(vector) == dim) & F.exists(vector, lambda x: x != 0)
