"""Vector arithmetic as expressions, in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, clamped to [-1, 1]; NULL if one is zero or NULL."""
    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(value.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


def vector_status(v: Column, dimensions: int, tolerance: float = 1e-4) -> Column:
    """ready, or what is wrong: missing, wrong_dimensions, not_finite, zero, not_unit."""
    square = F.sqrt(dot(v, v))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        F.when(v.isNull(), "missing")
        .when(F.size(v) != dimensions, "wrong_dimensions")
        .when(~F.coalesce(finite, F.lit(False)), "not_finite")
        .when(square == 0, "zero")
        .when(F.abs(square - 1) > tolerance, "not_unit")
        .otherwise("ready")
    )
