"""Derived columns and row selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions.readings import as_double, number, selected
from tallygrid.specs import SENTINEL, Selection, require_columns


def mean_of_two(df: DataFrame, right: str, left: str, alias: str, true_mean: bool = False) -> Column:
    """``right + left / 2``, the form the detector catalogue uses.

    It is not the arithmetic mean; ``true_mean`` gives ``(right + left) / 2``.
    """
    r, el = number(df, right), number(df, left)
    return F.expr(f"({r} + {el}) / 2D" if true_mean else f"{r} + {el} / 2D").alias(alias)


def difference(df: DataFrame, minuend: str, subtrahend: str, alias: str | None = None) -> Column:
    """``minuend - subtrahend``, by default named ``{minuend}_{subtrahend}``.

    Two missing readings subtract to 0.0, which is an ordinary value.
    """
    value = F.expr(f"{number(df, minuend)} - {number(df, subtrahend)}")
    return value.alias(alias or f"{minuend}_{subtrahend}")


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns as doubles, in order."""
    require_columns(df.columns, columns)
    return df.select(*[as_double(df, c).alias(c) for c in columns])


def keep(df: DataFrame, selection: Selection, sentinel: float = SENTINEL) -> DataFrame:
    """Rows of a selection; the comparisons reach the Parquet reader."""
    require_columns(df.columns, selection.columns)
    condition = selected(df, selection, sentinel)
    return df if condition is None else df.where(condition)


def both_valid(df: DataFrame, a: str, b: str, sentinel: float = SENTINEL) -> DataFrame:
    return keep(df, Selection(valid=(a, b)), sentinel)


def only_first_valid(df: DataFrame, a: str, b: str, sentinel: float = SENTINEL) -> DataFrame:
    return keep(df, Selection(valid=(a,), missing=(b,)), sentinel)
