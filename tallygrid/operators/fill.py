"""Filling histograms: distributed counts per bin.

Every result is a *count table* ``(hist, x_bin, y_bin, count)`` with one row per
non-empty bin; ``y_bin`` is NULL for a one-dimensional histogram. It is small next
to the events, and everything in ``stats`` and ``render`` works on it alone.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.functions.binning import bin_index, in_range
from tallygrid.functions.readings import between, number, selected, valid
from tallygrid.operators.derive import keep
from tallygrid.specs import (
    SENTINEL,
    Axis,
    Hist1D,
    Hist2D,
    HistSpec,
    Selection,
    require_columns,
    unique_specs,
)

ALL_ROWS: Mapping[str, Selection] = {"all": Selection()}

COUNT_COLUMNS = ("hist", "x_bin", "y_bin", "count")

# Entries that share one pass over the events. Each adds some 280 bytes to the generated
# method of its pass, and the JVM never compiles methods above 8,000 bytes to machine
# code; fewer entries per pass would only read the table more often.
ENTRIES_PER_PASS = 20

_KEY_BITS = 63


def hist1d(
    df: DataFrame,
    spec: Hist1D,
    bases: Mapping[str, Selection] = ALL_ROWS,
    sentinel: float = SENTINEL,
) -> DataFrame:
    """Count table of one 1D histogram. There is no sentinel filter, only the range."""
    require_columns(df.columns, [spec.x.column])
    rows = keep(df, bases[spec.base], sentinel)
    value = number(rows, spec.x.column)
    counted_rows = rows.where(between(rows, spec.x.column, spec.x.lo, spec.x.hi))
    bins = counted_rows.selectExpr(f"{bin_index(value, spec.x)} AS x_bin")
    counted = bins.where(F.col("x_bin") < F.lit(spec.x.bins)).groupBy("x_bin").count()
    return counted.select(
        F.lit(spec.name).alias("hist"), "x_bin", F.lit(None).cast("bigint").alias("y_bin"), "count"
    )


def hist2d(
    df: DataFrame,
    spec: Hist2D,
    bases: Mapping[str, Selection] = ALL_ROWS,
    sentinel: float | None = SENTINEL,
) -> DataFrame:
    """Count table of one 2D histogram over rows with both readings (``sentinel=None``: any row)."""
    require_columns(df.columns, [spec.x.column, spec.y.column])
    rows = keep(df, bases[spec.base], SENTINEL if sentinel is None else sentinel)
    if sentinel is not None:
        rows = rows.where(valid(rows, spec.x.column, sentinel))
        rows = rows.where(valid(rows, spec.y.column, sentinel))
    x, y = number(rows, spec.x.column), number(rows, spec.y.column)
    ranges = [between(rows, axis.column, axis.lo, axis.hi) for axis in (spec.x, spec.y)]
    bins = rows.where(" AND ".join(ranges)).selectExpr(
        f"{bin_index(x, spec.x)} AS x_bin", f"{bin_index(y, spec.y)} AS y_bin"
    )
    counted = bins.groupBy("x_bin", "y_bin").count()
    return counted.select(F.lit(spec.name).alias("hist"), "x_bin", "y_bin", "count")


def fill_catalogue(
    df: DataFrame,
    specs: Iterable[HistSpec],
    bases: Mapping[str, Selection] = ALL_ROWS,
    sentinel: float | None = SENTINEL,
    on_missing: str = "raise",
    entries_per_pass: int = ENTRIES_PER_PASS,
) -> DataFrame:
    """Count table of a whole catalogue in a few passes and one action.

    Entries are taken in groups that share columns. A pass computes each distinct bin
    number of its group once per row, turns every entry into one 64-bit key (entry,
    x bin, y bin) and counts keys. Counting starts in the map tasks, within the same
    generated code as the scan, so what is shuffled is at most one row per task and
    non-empty bin, however many events fall into the bin. Passes have no key in common,
    so their counts need no further merging. Entries whose columns are absent fail the
    call, or, with ``on_missing="skip"``, stay empty.
    """
    entries = unique_specs(specs)
    if on_missing not in ("raise", "skip"):
        raise ValueError(f"on_missing must be 'raise' or 'skip', not {on_missing!r}")
    if entries_per_pass < 1:
        raise ValueError("entries_per_pass must be at least 1")
    unknown = sorted({s.base for s in entries} - set(bases))
    if unknown:
        raise ValueError(f"specs name unknown bases {unknown}; known are {sorted(bases)}")
    if on_missing == "raise":
        require_columns(df.columns, [c for s in entries for c in _columns_of(s, bases)])
    present = [s for s in entries if set(_columns_of(s, bases)) <= set(df.columns)]
    if not present:
        empty = "hist string, x_bin bigint, y_bin bigint, count bigint"
        return df.sparkSession.createDataFrame([], empty)

    layout = _KeyLayout.of(present)
    ids = {spec.name: position for position, spec in enumerate(present)}
    ordered = sorted(present, key=lambda s: (s.base, s.axes[-1].column, s.x.column))
    passes = [
        _keys(df, ordered[i : i + entries_per_pass], ids, layout, bases, sentinel)
        for i in range(0, len(ordered), entries_per_pass)
    ]
    counted = [keys.groupBy(*layout.columns).count() for keys in passes]
    return layout.decode(functools.reduce(DataFrame.unionAll, counted), present)


def _columns_of(spec: HistSpec, bases: Mapping[str, Selection]) -> list[str]:
    return [axis.column for axis in spec.axes] + list(bases[spec.base].columns)


def _keys(
    df: DataFrame,
    group: Sequence[HistSpec],
    ids: Mapping[str, int],
    layout: _KeyLayout,
    bases: Mapping[str, Selection],
    sentinel: float | None,
) -> DataFrame:
    """One row per event and entry of the group that counts the event."""
    axes: dict[Axis, str] = {}
    tests: dict[str, str] = {}
    marker = SENTINEL if sentinel is None else sentinel
    keys = []
    for spec in group:
        bins = [axes.setdefault(axis, f"axis_{len(axes)}") for axis in spec.axes]
        conditions = []
        base = selected(df, bases[spec.base], marker)
        if base is not None:
            conditions.append(tests.setdefault(base, f"test_{len(tests)}"))
        if isinstance(spec, Hist1D):
            conditions.append(f"{bins[0]} < {spec.x.bins}")
        else:
            # where the range itself keeps the sentinel out, there is nothing to test
            for axis in spec.axes:
                if sentinel is not None and axis.lo <= sentinel < axis.hi:
                    reading = valid(df, axis.column, sentinel)
                    conditions.append(tests.setdefault(reading, f"test_{len(tests)}"))
        key = layout.encode(ids[spec.name], *bins)
        keys.append(f"if({' AND '.join(conditions)}, {key}, NULL)" if conditions else key)
    per_row = df.selectExpr(
        *[f"{_bin_or_null(df, axis)} AS {name}" for axis, name in axes.items()],
        *[f"{test} AS {name}" for test, name in tests.items()],
    )
    return layout.rows(per_row.selectExpr(f"explode(array({', '.join(keys)})) AS key"))


def _bin_or_null(df: DataFrame, axis: Axis) -> str:
    value = number(df, axis.column)
    return f"if({in_range(value, axis)}, {bin_index(value, axis)}, NULL)"


@dataclass(frozen=True)
class _KeyLayout:
    """How (entry, x bin, y bin) is grouped on: one packed bigint, or a struct when too wide."""

    x_bits: int
    y_bits: int
    packed: bool

    @classmethod
    def of(cls, specs: Sequence[HistSpec]) -> _KeyLayout:
        # an index can reach ``bins`` itself, see bin_index
        x_bits = max(s.x.bins.bit_length() for s in specs)
        y_bits = max((s.y.bins.bit_length() for s in specs if isinstance(s, Hist2D)), default=0)
        id_bits = (len(specs) - 1).bit_length()
        return cls(x_bits, y_bits, id_bits + x_bits + y_bits <= _KEY_BITS)

    @property
    def columns(self) -> tuple[str, ...]:
        return ("key",) if self.packed else ("entry", "x_bin", "y_bin")

    def encode(self, entry: int, x: str, y: str | None = None) -> str:
        """Key of one entry; NULL when a bin is NULL. Bit operations, so no overflow tests."""
        if not self.packed:
            struct = f"struct({entry} AS entry, {x} AS x_bin, {y or '0L'} AS y_bin)"
            known = f"{x} IS NOT NULL" + (f" AND {y} IS NOT NULL" if y else "")
            return f"if({known}, {struct}, NULL)"
        key = f"shiftleft({x}, {self.y_bits}) | {entry << (self.x_bits + self.y_bits)}L"
        return f"({key} | {y})" if y else f"({key})"

    def rows(self, exploded: DataFrame) -> DataFrame:
        kept = exploded.where(F.col("key").isNotNull())
        return kept if self.packed else kept.select("key.entry", "key.x_bin", "key.y_bin")

    def decode(self, counted: DataFrame, specs: Sequence[HistSpec]) -> DataFrame:
        if self.packed:
            key = F.col("key")
            entry = F.shiftright(key, self.x_bits + self.y_bits).cast("int")
            x_mask, y_mask = (F.lit((1 << b) - 1).cast("bigint") for b in (self.x_bits, self.y_bits))
            x_bin = F.shiftright(key, self.y_bits).bitwiseAND(x_mask)
            y_bin = key.bitwiseAND(y_mask)
        else:
            entry, x_bin, y_bin = F.col("entry"), F.col("x_bin"), F.col("y_bin")
        names = F.array(*[F.lit(s.name) for s in specs])
        flat = F.array(*[F.lit(s.kind == "1d") for s in specs])
        return counted.select(
            F.get(names, entry).alias("hist"),
            x_bin.alias("x_bin"),
            F.when(~F.get(flat, entry), y_bin).alias("y_bin"),
            "count",
        )
