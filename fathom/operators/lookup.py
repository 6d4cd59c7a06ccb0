"""Equality and range look-up with key-ordered results."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Range:
    """Bounds of a range; None is open-ended.  Nulls are in no range."""

    low: Any = None
    high: Any = None
    include_low: bool = True
    include_high: bool = True

    def column(self, c: Column) -> Column:
        out = c.isNotNull()
        if self.low is not None:
            out = out & (c >= F.lit(self.low) if self.include_low else c > F.lit(self.low))
        if self.high is not None:
            out = out & (c <= F.lit(self.high) if self.include_high else c < F.lit(self.high))
        return out


def equal(df: DataFrame, column: str, value: Any) -> DataFrame:
    """Rows whose column is value, which is cast to the column's type."""
    return df.filter(F.col(column) == F.lit(value).cast(df.schema[column].dataType))


def ranged(df: DataFrame, column: str, bounds: Range, order: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """Rows in the range, by key, then by the columns of order; the first `limit` of them."""
    out = df.filter(bounds.column(F.col(column))).orderBy(column, *order)
    return out if limit is None else out.limit(limit)


#: Ranges that stand for a list of numbers where files' statistics are asked.
RANGES = 24


def one_of(column: str, numbers: Iterable[int]) -> Column:
    """Whether a column is one of some whole numbers, in a form that skips files and row groups.

    A long list says no more to their statistics than its least and greatest; so it goes
    with the ranges that its largest gaps leave.
    """
    numbers = sorted(set(numbers))
    if not numbers:
        return F.lit(False)
    gaps = sorted(range(1, len(numbers)), key=lambda i: numbers[i - 1] - numbers[i])[: RANGES - 1]
    cuts = [0, *sorted(gaps), len(numbers)]
    ranges = " OR ".join(f"{column} BETWEEN {numbers[a]}L AND {numbers[b - 1]}L" for a, b in zip(cuts, cuts[1:], strict=False))
    # As one text: a Column a number would be as many calls to the driver's JVM.
    return F.expr(f"({ranges}) AND {column} IN ({', '.join(f'{n}L' for n in numbers)})")
