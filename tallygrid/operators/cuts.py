"""Selecting events with polygon cuts: one narrow pass, no shuffle, no Python.

Nearly every row is settled in generated code, which leaves a code beside it: outside, inside, or
undecided. Only undecided rows, next to an edge, then go through the exact test, whose
loops Spark interprets.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions.polygon import (
    INSIDE,
    OUTSIDE,
    UNDECIDED,
    exact_inside,
    has_area,
    near_polygon,
    settled,
    slot_edges,
)
from tallygrid.functions.readings import compared, number, valid
from tallygrid.specs import SENTINEL, Cut, require_columns, unique_cuts


def usable_cuts(df: DataFrame, cuts: Iterable[Cut]) -> list[Cut]:
    """The cuts that name both columns; those columns must be in the table."""
    usable = [cut for cut in unique_cuts(cuts) if cut.usable]
    require_columns(df.columns, [c for cut in usable for c in (cut.x_column, cut.y_column)])
    return usable


def tag_cuts(df: DataFrame, cuts: Iterable[Cut]) -> DataFrame:
    """The table with one boolean column per usable cut, named by the cut id."""
    usable = usable_cuts(df, cuts)
    taken = sorted({cut.cut_id for cut in usable} & set(df.columns))
    if taken:
        raise ValueError(f"cut ids that are columns of the table already: {taken}")
    if not usable:
        return df
    codes = _code_names(df, usable)
    coded = _with_codes(df, df, codes, usable)
    tags = {cut.cut_id: F.coalesce(_decided(df, cut, code), F.lit(False)) for code, cut in zip(codes, usable, strict=True)}
    return coded.withColumns(tags).drop(*codes)


def apply_cuts(
    df: DataFrame, cuts: Iterable[Cut], combine: str = "or", drop_sentinel: bool = False
) -> DataFrame:
    """Rows inside any cut (``combine="and"``: inside every cut), with all their columns.

    A sentinel reading is an ordinary coordinate here: a polygon that reaches to it
    selects it, unless ``drop_sentinel`` is set. Without a usable cut there is nothing
    to select by, and the call fails.
    """
    if combine not in ("or", "and"):
        raise ValueError(f"combine must be 'or' or 'and', not {combine!r}")
    usable = usable_cuts(df, cuts)
    if not usable:
        raise ValueError("no cut has both columns chosen")
    merge = functools.partial(functools.reduce, operator.or_ if combine == "or" else operator.and_)
    codes = _code_names(df, usable)
    boxes, near, possible, inside = [], [], [], []
    for code, cut in zip(codes, usable, strict=True):
        x, y = _readings(df, cut)
        present = [F.expr(valid(df, c, SENTINEL)) for c in (cut.x_column, cut.y_column)] if drop_sentinel else []
        boxes.append(_box(df, cut))
        near.append(functools.reduce(operator.and_, present, F.expr(near_polygon(x, y, cut.vertices))))
        possible.append(functools.reduce(operator.and_, present, F.col(code) != F.lit(OUTSIDE)))
        inside.append(functools.reduce(operator.and_, present, _decided(df, cut, code)))
    # The boxes alone are plain comparisons, which the Parquet reader can use to skip
    # row groups; inside a disjunction with other tests they could not get there.
    rows = df.where(merge(boxes)).where(merge(near))
    rows = _with_codes(df, rows, codes, usable).where(merge(possible))
    return rows.where(merge(inside)).drop(*codes)


def _with_codes(df: DataFrame, rows: DataFrame, codes: list[str], cuts: list[Cut]) -> DataFrame:
    """A code column for each cut, made from columns with the edges near the row.

    The codes are not deterministic to the optimizer, which therefore keeps them as columns and does not put all of
    their arithmetic into later filters once for each time they are named.
    """
    bound, coded = {}, {}
    for code, cut in zip(codes, cuts, strict=True):
        x, y = _readings(df, cut)
        near = {f"{code}_{at}": F.expr(edge) for at, edge in enumerate(slot_edges(y, cut.vertices))}
        bound |= near
        coded[code] = F.expr(f"{settled(x, y, cut.vertices, list(near))} + spark_partition_id() * 0")
    return (rows.withColumns(bound) if bound else rows).withColumns(coded).drop(*bound)


def _code_names(df: DataFrame, cuts: list[Cut]) -> list[str]:
    """Names that no column has, one for each cut."""
    taken, stem = {name.lower() for name in df.columns} | {cut.cut_id.lower() for cut in cuts}, "code"
    while any(name.startswith(stem) for name in taken):
        stem += "_"
    return [f"{stem}{at}" for at in range(len(cuts))]


def _readings(df: DataFrame, cut: Cut) -> tuple[str, str]:
    return number(df, cut.x_column), number(df, cut.y_column)


def _decided(df: DataFrame, cut: Cut, code: str) -> Column:
    # Kept apart from the filter before it, which stays in generated code, by what the optimizer may not move.
    exact = F.expr(f"{exact_inside(*_readings(df, cut), cut.vertices)} AND spark_partition_id() >= 0")
    return F.when(F.col(code) == F.lit(UNDECIDED), exact).otherwise(F.col(code) == F.lit(INSIDE))


def _box(df: DataFrame, cut: Cut) -> Column:
    if not has_area(cut.vertices):
        return F.lit(False)
    sides = [("<", max), (">", min)]
    columns = ((cut.x_column, 0), (cut.y_column, 1))
    return F.expr(
        " AND ".join(compared(df, name, sign, float(end(v[at] for v in cut.vertices))) for name, at in columns for sign, end in sides)
    )
