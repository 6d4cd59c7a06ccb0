"""Boxes, points and nearest points over scalar coordinate columns.

Coordinates as columns of their own let min/max statistics of Parquet skip files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import distance


def within(df: DataFrame, axes: Sequence[str], low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """Rows in the closed box, ordered by point."""
    for a, x, y in zip(axes, low, high, strict=True):
        df = df.filter(F.col(a).between(F.lit(float(x)), F.lit(float(y))))
    return df.orderBy(*axes)


def at_point(df: DataFrame, axes: Sequence[str], point: Sequence[float]) -> DataFrame:
    for a, x in zip(axes, point, strict=True):
        df = df.filter(F.col(a) == F.lit(float(x)))
    return df


def nearest_points(df: DataFrame, axes: Sequence[str], point: Sequence[float], k: int, order: tuple[str, ...] = ()) -> DataFrame:
    """The k rows nearest to point by Euclidean distance, with the distance."""
    return df.withColumn("distance", distance([F.col(a).cast("double") for a in axes], point)).filter("distance is not null").orderBy("distance", *order).limit(k)
