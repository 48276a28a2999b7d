"""Vector expressions over array<float> columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity clamped to [0, 1]; 0 for a missing or zero vector."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (norms > 0)
    return F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), _dot(a, b) / norms))).otherwise(F.lit(0.0))
