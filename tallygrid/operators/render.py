"""Plot-ready tables made from a count table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.functions.binning import bin_start
from tallygrid.functions.colors import OVERLAY_COLORS, channel, color_position
from tallygrid.functions.text import plain_number
from tallygrid.operators.geometry import (
    geometry,
    one_dimensional,
    spec_table,
    two_dimensional,
    with_empty,
)
from tallygrid.operators.stats import count_range
from tallygrid.specs import Hist1D, Hist2D, HistSpec, unique_specs


def dense_counts(counts: DataFrame, specs: Iterable[Hist1D]) -> DataFrame:
    """``(hist, bin, start, end, count)`` for every bin of every 1D spec, empty bins included."""
    table = spec_table(counts.sparkSession, one_dimensional(specs))
    bins = table.select(
        "hist", "x_lo", "x_width", F.explode(F.sequence(F.lit(0), F.col("x_bins") - 1)).alias("bin")
    )
    found = counts.select("hist", F.col("x_bin").alias("bin"), "count")
    start = bin_start(F.col("bin"), F.col("x_lo"), F.col("x_width"))
    return (
        bins.join(found, ["hist", "bin"], "left")
        .withColumn("start", start)
        .select(
            "hist",
            "bin",
            "start",
            (F.col("start") + F.col("x_width")).alias("end"),
            F.coalesce("count", F.lit(0)).alias("count"),
        )
    )


def step_points(counts: DataFrame, specs: Iterable[Hist1D]) -> DataFrame:
    """``(hist, bin, side, x, count)``: two points per bin, side 0 at its start and 1 at its end.

    Sorting by ``bin, side`` gives the step line of a histogram.
    """
    corners = F.array(F.col("start"), F.col("end"))
    return dense_counts(counts, specs).select(
        "hist",
        "bin",
        F.posexplode(corners).alias("side", "x"),
        F.col("count").cast("double").alias("count"),
    )


def heatmap_cells(counts: DataFrame, specs: Iterable[Hist2D]) -> DataFrame:
    """``(hist, x_bin, y_bin, x, y, bar_width, height, count)`` for every non-empty 2D bin."""
    chosen = two_dimensional(specs)
    x_start = bin_start(F.col("x_bin"), F.col("spec.x_lo"), F.col("spec.x_width"))
    y_start = bin_start(F.col("y_bin"), F.col("spec.y_lo"), F.col("spec.y_width"))
    return (
        counts.where(F.col("hist").isin([s.name for s in chosen]))
        .withColumn("spec", geometry(chosen, F.col("hist")))
        .withColumns({"x0": x_start, "y0": y_start})
        .select(
            "hist",
            "x_bin",
            "y_bin",
            ((F.col("x0") + (F.col("x0") + F.col("spec.x_width"))) / F.lit(2.0)).alias("x"),
            ((F.col("y0") + (F.col("y0") + F.col("spec.y_width"))) / F.lit(2.0)).alias("y"),
            F.col("spec.x_width").alias("bar_width"),
            F.col("spec.y_width").alias("height"),
            "count",
        )
    )


def heatmap_bars(counts: DataFrame, specs: Iterable[Hist2D]) -> DataFrame:
    """Heat-map cells with base offset, label and viridis colour.

    The colour scale needs the largest count of each histogram: a scalar subquery with
    one map entry per histogram. It reads the same count table as the cells, so Spark
    reuses its shuffle; over a persisted table nothing is computed twice.
    """
    chosen = two_dimensional(specs)
    scale = count_range(counts, chosen).agg(
        F.map_from_entries(F.collect_list(F.struct("hist", "max_count")))
    )
    high = F.element_at(scale.scalar(), F.col("hist"))
    label = F.concat(
        F.lit("x = "),
        plain_number(F.col("x")),
        F.lit("\ny = "),
        plain_number(F.col("y")),
        F.lit("\n"),
        F.col("count").cast("string"),
    )
    # a cell has a count, so its histogram is not empty and its scale starts at 1
    position = color_position(F.col("count"), F.lit(1), F.col("high"))
    cells = heatmap_cells(counts, chosen).withColumn("high", high).withColumn("place", position)
    return cells.select(
        "hist",
        "x_bin",
        "y_bin",
        "x",
        "y",
        "bar_width",
        "height",
        "count",
        (F.col("y") - F.col("height") / F.lit(2.0)).alias("base_offset"),
        label.alias("label"),
        channel(F.col("place"), 0).alias("red"),
        channel(F.col("place"), 1).alias("green"),
        channel(F.col("place"), 2).alias("blue"),
    )


def hist_names(spark: SparkSession, specs: Iterable[HistSpec]) -> DataFrame:
    """Histogram names in byte order."""
    return spec_table(spark, specs).select("hist").orderBy("hist")


def hist_kind(spark: SparkSession, specs: Iterable[HistSpec], name: str) -> DataFrame:
    """``(hist, kind)`` of one histogram; no row for a name that is not there."""
    return spec_table(spark, specs).where(F.col("hist") == F.lit(name)).select("hist", "kind")


def hist_totals(counts: DataFrame, specs: Iterable[HistSpec]) -> DataFrame:
    """``(hist, kind, entries, filled_bins)`` for every spec, zeros for an empty histogram."""
    chosen = unique_specs(specs)
    totals = with_empty(counts, chosen).groupBy("hist")
    return totals.agg(
        F.sum("count").alias("entries"), F.count_if(F.col("count") > 0).alias("filled_bins")
    ).select(
        "hist", geometry(chosen, F.col("hist"))["kind"].alias("kind"), "entries", "filled_bins"
    )


def overlay(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """Count rows of the picked histograms with their pick position and colour.

    A name picked twice keeps its first place; a name that has no rows adds none.
    """
    picked = list(dict.fromkeys(names))
    if not picked:
        raise ValueError("no histogram picked")
    colors = F.array(*[F.lit(color) for color in OVERLAY_COLORS])
    positions = F.array(*[F.lit(name) for name in picked])
    position = F.array_position(positions, F.col("hist")) - F.lit(1)
    return (
        counts.where(F.col("hist").isin(picked))
        .withColumn("position", position.cast("int"))
        .withColumn("color_index", F.col("position") % F.lit(len(OVERLAY_COLORS)))
        .withColumn("color", F.get(colors, F.col("color_index")))
        .select("hist", "position", "color_index", "color", "x_bin", "y_bin", "count")
    )
