"""Statistics of a count table inside a value window.

Bin centres are ``lo + (i + 0.5) * width``, so mean and variance follow from three
sums of whole numbers per histogram: N = sum(c), S1 = sum(c * i), S2 = sum(c * i * i).
They are added up exactly, in any order, in one aggregation; moving the origin to the
mean bin before going to doubles avoids the cancellation that E[x^2] - E[x]^2 has.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as FrameWindow
from pyspark.sql import functions as F

from tallygrid.functions.text import two_decimals
from tallygrid.operators.geometry import geometry, one_dimensional, spec_table, two_dimensional, with_empty
from tallygrid.specs import Axis, Hist1D, Hist2D, HistSpec

Window = tuple[float, float]

EMPTY_MIN_COUNT = 4294967295
"""Minimum count of a 2D histogram nothing has been counted in."""


def bin_window(axis: Axis, window: Window | None, strict: bool = False) -> tuple[int, int | None]:
    """First and last bin (None: no upper limit) of a value window.

    A bound with no bin falls back to that end of the histogram, even when both lie on
    the same side of it. ``strict`` makes such a window empty instead.
    """
    if window is None:
        return 0, None
    start, end = window
    if strict and (end < axis.lo or start > axis.hi):
        return 1, 0
    first, last = axis.bin_of(start), axis.bin_of(end)
    return (0 if first is None else first), last


def _within(column: str, bounds: tuple[int, int | None]) -> Column:
    first, last = bounds
    test = F.col(column) >= F.lit(first)
    return test if last is None else test & (F.col(column) <= F.lit(last))


def _in_window(
    specs: Sequence[HistSpec], x: Window | None, y: Window | None, strict: bool
) -> Column:
    """The window as one test on bin numbers; specs of equal geometry share a term."""
    groups: dict[tuple, list[str]] = {}
    for s in specs:
        bounds = (bin_window(s.x, x, strict),)
        if isinstance(s, Hist2D):
            bounds += (bin_window(s.y, y, strict),)
        groups.setdefault(bounds, []).append(s.name)
    keep = F.lit(False)
    for bounds, names in groups.items():
        test = _within("x_bin", bounds[0])
        if len(bounds) == 2:
            test = test & _within("y_bin", bounds[1])
        keep = keep | (F.col("hist").isin(names) & test)
    return keep


def _sums(axis: str) -> list[Column]:
    # decimals: c * i * i passes 2**63 at some 10**11 events on a fine axis
    return [
        F.expr(f"sum({power}) AS {axis}_s{p}")
        for p, power in (
            (1, f"cast(count AS decimal(20,0)) * cast({axis}_bin AS decimal(18,0))"),
            (2, f"cast(count AS decimal(20,0)) * cast({axis}_bin * {axis}_bin AS decimal(18,0))"),
        )
    ]


def _mean_and_deviation(axis: str) -> list[Column]:
    """``mean`` and ``stdev`` of one axis from its sums, zero when nothing was counted."""
    s1, s2 = f"{axis}_s1", f"{axis}_s2"
    middle = f"cast(round(cast({s1} AS double) / n) AS decimal(18,0))"
    first = f"cast({s1} - {middle} * cast(n AS decimal(20,0)) AS double) / n"
    second = (
        f"cast({s2} - 2 * {middle} * {s1} + {middle} * {middle} * cast(n AS decimal(20,0)) "
        "AS double) / n"
    )
    mean = f"spec.{axis}_lo + ({middle} + {first} + 0.5D) * spec.{axis}_width"
    stdev = f"sqrt(greatest({second} - ({first}) * ({first}), 0D)) * spec.{axis}_width"
    return [F.expr(f"if(n = 0, 0D, {value})") for value in (mean, stdev)]


def _per_histogram(
    counts: DataFrame,
    specs: Sequence[HistSpec],
    x: Window | None,
    y: Window | None,
    strict: bool,
    axes: str,
) -> DataFrame:
    inside = counts.where(_in_window(specs, x, y, strict))
    sums = [column for axis in axes for column in _sums(axis)]
    grouped = with_empty(inside, specs).groupBy("hist").agg(F.sum("count").alias("n"), *sums)
    return grouped.withColumn("spec", geometry(specs, F.col("hist")))


def stats1d(
    counts: DataFrame,
    specs: Iterable[Hist1D],
    x: Window | None = None,
    strict_window: bool = False,
) -> DataFrame:
    """``(hist, count, mean, stdev)`` for every 1D spec; zeros where nothing is counted.

    The window snaps to whole bins, and its end bin counts. Mean and deviation are
    those of the bin centres, in the population form.
    """
    sums = _per_histogram(counts, one_dimensional(specs), x, None, strict_window, "x")
    mean, stdev = _mean_and_deviation("x")
    return sums.select(
        "hist", F.col("n").alias("count"), mean.alias("mean"), stdev.alias("stdev")
    )


def running_sums1d(counts: DataFrame, specs: Iterable[Hist1D]) -> DataFrame:
    """``(hist, x_bin, n, x_s1, x_s2)``: the three sums over all bins up to each bin, from -1 on.

    As many rows as the histograms have bins. Persist or write it: any number of windows is then looked up in
    ``stats1d_windows`` without going over the counts again.
    """
    chosen = one_dimensional(specs)
    # Bins below the number of bins only; an index that rounded up to it was not counted.
    bins = spec_table(counts.sparkSession, chosen).select("hist", F.explode(F.sequence(F.lit(-1), F.col("x_bins") - 1)).alias("x_bin"))
    dense = bins.join(counts.select("hist", "x_bin", "count"), ["hist", "x_bin"], "left").na.fill(0, ["count"])
    summed = dense.groupBy("hist", "x_bin").agg(F.sum("count").alias("n"), *_sums("x"))
    upward = FrameWindow.partitionBy("hist").orderBy("x_bin")
    return summed.select("hist", "x_bin", *(F.sum(c).over(upward).alias(c) for c in ("n", "x_s1", "x_s2")))


def stats1d_windows(
    running: DataFrame, specs: Iterable[Hist1D], windows: DataFrame, strict_window: bool = False
) -> DataFrame:
    """``(window_id, hist, count, mean, stdev)`` of every 1D spec in every window, as ``stats1d``.

    ``windows`` has window_id, start and end; a null bound is no bound. Each window and histogram costs two lookups in
    ``running_sums1d``, however wide the window is.
    """
    chosen = one_dimensional(specs)
    spec = geometry(chosen, F.col("hist"))
    names = F.array(*(F.lit(s.name) for s in chosen))
    asked = windows.select("window_id", "start", "end", F.explode(names).alias("hist")).withColumn("spec", spec)
    hi = {s.name: float(s.x.hi) for s in chosen}
    asked = asked.withColumn("x_hi", F.element_at(F.create_map(*(F.lit(v) for pair in hi.items() for v in pair)), F.col("hist")))

    def bin_of(bound: str) -> str:
        place = f"CAST(floor(({bound} - spec.x_lo) / spec.x_width) AS BIGINT)"
        return f"CASE WHEN isnan({bound}) THEN 0 WHEN {bound} < spec.x_lo OR {bound} > x_hi THEN NULL ELSE {place} END"

    first, last = f"coalesce({bin_of('start')}, 0)", f"least(coalesce({bin_of('end')}, spec.x_bins - 1), spec.x_bins - 1)"
    outside = "coalesce((end < spec.x_lo AND NOT isnan(end)) OR (start > x_hi AND NOT isnan(start)), false)" if strict_window else "false"
    asked = asked.selectExpr("window_id", "hist", "spec", f"if({outside}, 1, {first}) AS first", f"if({outside}, 0, {last}) AS last")
    asked = asked.withColumn("below", F.col("first") - 1)
    upper = running.select("hist", F.col("x_bin").alias("last"), *(F.col(c).alias(f"u_{c}") for c in ("n", "x_s1", "x_s2")))
    lower = running.select("hist", F.col("x_bin").alias("below"), *(F.col(c).alias(f"l_{c}") for c in ("n", "x_s1", "x_s2")))
    found = asked.join(upper, ["hist", "last"]).join(lower, ["hist", "below"])
    some = F.col("first") <= F.col("last")
    differences = [F.when(some, F.col(f"u_{c}") - F.col(f"l_{c}")).otherwise(F.lit(0)).alias(c) for c in ("n", "x_s1", "x_s2")]
    found = found.select("window_id", "hist", "spec", *differences)
    mean, stdev = _mean_and_deviation("x")
    return found.select("window_id", "hist", F.col("n").cast("bigint").alias("count"), mean.alias("mean"), stdev.alias("stdev"))


def stats2d(
    counts: DataFrame,
    specs: Iterable[Hist2D],
    x: Window | None = None,
    y: Window | None = None,
    strict_window: bool = False,
) -> DataFrame:
    """``(hist, count, mean_x, stdev_x, mean_y, stdev_y)`` for every 2D spec, as ``stats1d``."""
    sums = _per_histogram(counts, two_dimensional(specs), x, y, strict_window, "xy")
    mean_x, stdev_x = _mean_and_deviation("x")
    mean_y, stdev_y = _mean_and_deviation("y")
    return sums.select(
        "hist",
        F.col("n").alias("count"),
        mean_x.alias("mean_x"),
        stdev_x.alias("stdev_x"),
        mean_y.alias("mean_y"),
        stdev_y.alias("stdev_y"),
    )


def count_range(counts: DataFrame, specs: Iterable[Hist2D]) -> DataFrame:
    """``(hist, min_count, max_count, true_min)`` per 2D histogram.

    ``min_count`` is the lowest value any bin passed through while filling, so 1 as soon
    as there is one event; it anchors the colour scale. ``true_min`` is the smallest
    count of a non-empty bin. An empty histogram has 4294967295, 0 and NULL.
    """
    grouped = with_empty(counts, two_dimensional(specs)).groupBy("hist")
    found = grouped.agg(
        F.max("count").alias("max_count"),
        F.min(F.when(F.col("count") > 0, F.col("count"))).alias("true_min"),
    )
    smallest = F.when(F.col("max_count") == 0, F.lit(EMPTY_MIN_COUNT)).otherwise(F.lit(1))
    return found.select(
        "hist", smallest.cast("bigint").alias("min_count"), "max_count", "true_min"
    )


def legend1d(stats: DataFrame) -> DataFrame:
    """``(hist, line_no, line)``: the three legend lines of every row of ``stats1d``."""
    return _legend(stats, [("Mean", "mean"), ("Stdev", "stdev")])


def legend2d(stats: DataFrame) -> DataFrame:
    """``(hist, line_no, line)``: the five legend lines of every row of ``stats2d``."""
    pairs = [("Mean X", "mean_x"), ("Stdev X", "stdev_x")]
    return _legend(stats, [*pairs, ("Mean Y", "mean_y"), ("Stdev Y", "stdev_y")])


def _legend(stats: DataFrame, entries: Sequence[tuple[str, str]]) -> DataFrame:
    lines = [F.concat(F.lit("Integral: "), F.col("count").cast("string"))]
    lines += [F.concat(F.lit(f"{label}: "), two_decimals(F.col(c))) for label, c in entries]
    return stats.select("hist", F.posexplode(F.array(*lines)).alias("line_no", "line"))
