"""Computing an expensive expression once.

Catalyst copies a projected expression into every place that uses it, filters pushed
below the projection included.  A chain of regular expressions would then run many times
per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once: the variable of a one-element transform."""
    return F.element_at(F.transform(F.array(value), body), 1)


def packed(outer: Column, inner: Column) -> Column:
    """Two array positions as one number in the order of both; a position is below 2 ** 31, so nothing can collide."""
    return F.shiftleft(outer.cast("long"), 32) + inner.cast("long")


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    They come out of a one-row generator, through which neither projections are merged
    nor filters pushed.
    """
    row = F.struct(*[expression.alias(name) for name, expression in columns.items()])
    return df.select("*", F.inline(F.array(row)))
