"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null when either vector has zero length."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale)


def cosine_prenormed(a: Column, a_norm: Column, b: Column, b_norm: Column) -> Column:
    """Cosine for pair scoring, where each norm was computed once per vector."""
    scale = a_norm * b_norm
    return F.when(scale > 0, dot(a, b) / scale)
