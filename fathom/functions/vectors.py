"""Vector arithmetic on array columns, in doubles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Sequence[Column], b: Sequence[float]) -> Column:
    """Euclidean distance between scalar columns and a point."""
    total = F.lit(0.0)
    for x, y in zip(a, b, strict=True):
        total = total + (x - F.lit(float(y))) * (x - F.lit(float(y)))
    return F.sqrt(total)
