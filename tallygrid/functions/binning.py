"""Bin arithmetic as SQL text over a numeric expression.

``width_bucket`` is not used: it rounds differently from ``floor((v - lo) / width)``
for some ranges, and the width here is one literal double shared with every consumer.
"""

from __future__ import annotations

from pyspark.sql import Column

from tallygrid.functions.readings import double
from tallygrid.specs import Axis


def in_range(value: str, axis: Axis) -> str:
    """``lo <= v < hi``. NaN sorts above every number in Spark, so the upper test drops it."""
    return f"({value} >= {double(axis.lo)} AND {value} < {double(axis.hi)})"


def bin_index(value: str, axis: Axis) -> str:
    """Bin of a value already known to be in range.

    Just below ``hi`` the division can round up to ``bins``; callers decide whether
    that index counts (2D) or not (1D).
    """
    return f"floor(({value} - {double(axis.lo)}) / {double(axis.width)})"


def bin_start(index: Column, lo: Column, width: Column) -> Column:
    return lo + index.cast("double") * width
