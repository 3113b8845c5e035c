"""Histogram specs inside a plan: as rows, as a lookup by name, and as empty count rows.

Each form is one JSON constant that the optimizer folds away, so a catalogue of any
length costs one call and no join.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.specs import Hist2D, HistSpec, unique_specs

_GEOMETRY = (
    "hist: string, kind: string, x_bins: bigint, x_lo: double, x_width: double, "
    "y_bins: bigint, y_lo: double, y_width: double"
)


def _described(spec: HistSpec) -> dict:
    found = {"hist": spec.name, "kind": spec.kind}
    for letter, axis in zip("xy", spec.axes):
        found[f"{letter}_bins"] = axis.bins
        found[f"{letter}_lo"] = float(axis.lo)
        found[f"{letter}_width"] = axis.width
    return found


def _constant(value: object, schema: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), schema, {"mode": "FAILFAST"})


def spec_table(spark: SparkSession, specs: Iterable[HistSpec]) -> DataFrame:
    """One row per histogram with its kind and geometry, as many rows as there are specs."""
    rows = [_described(s) for s in unique_specs(specs)]
    if not rows:
        raise ValueError("at least one histogram is needed")
    table = _constant(rows, f"array<struct<{_GEOMETRY}>>")
    return spark.range(1, numPartitions=1).select(F.inline(table))


def geometry(specs: Sequence[HistSpec], hist: Column) -> Column:
    """The spec of a named histogram as a struct; NULL for other names."""
    table = {s.name: _described(s) for s in specs}
    return F.element_at(_constant(table, f"map<string, struct<{_GEOMETRY}>>"), hist)


def with_empty(counts: DataFrame, specs: Sequence[HistSpec]) -> DataFrame:
    """Counts of these histograms with one row of count 0 for each.

    Grouped by name, a histogram without events then has a group too, and adds nothing
    to any sum. This takes the place of an outer join with the list of names.
    """
    table = spec_table(counts.sparkSession, specs)
    zero = F.lit(0).cast("bigint")
    empty = table.select("hist", zero.alias("x_bin"), zero.alias("y_bin"), zero.alias("count"))
    kept = counts.where(F.col("hist").isin([s.name for s in specs]))
    return kept.select("hist", "x_bin", "y_bin", "count").unionAll(empty)


def two_dimensional(specs: Iterable[HistSpec]) -> list[Hist2D]:
    """The specs, after checking that all are 2D."""
    chosen = unique_specs(specs)
    wrong = [s.name for s in chosen if not isinstance(s, Hist2D)]
    if wrong:
        raise ValueError(f"not two-dimensional: {wrong}")
    return chosen


def one_dimensional(specs: Iterable[HistSpec]) -> list[HistSpec]:
    """The specs, after checking that all are 1D."""
    chosen = unique_specs(specs)
    wrong = [s.name for s in chosen if isinstance(s, Hist2D)]
    if wrong:
        raise ValueError(f"not one-dimensional: {wrong}")
    return chosen
