"""The registered queries: every operator over whole tables of a scale-factor folder.

The driver tables have no detector columns, so ``detector_view`` derives them, one event
per line item, with the sentinel where a key is divisible by a small number.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tallygrid as tg
from tallygrid.plans.detector import BASES

DETECTOR_VIEW = """
SELECT l_orderkey, l_linenumber,
 CASE WHEN l_orderkey % 10 = 0 THEN -1e6 ELSE (l_extendedprice % 700e0) - 350e0 END AS X1,
 CASE WHEN l_partkey % 8 = 0 THEN -1e6 ELSE ((l_extendedprice * 3e0) % 700e0) - 350e0 END AS X2,
 CASE WHEN l_orderkey % 10 = 0 OR l_partkey % 8 = 0 THEN -1e6 ELSE (l_extendedprice % 600e0) - 300e0 END AS Xavg,
 l_quantity / 31e0 AS Theta,
 CASE WHEN l_suppkey % 11 = 0 THEN -1e6 ELSE (l_extendedprice * 2e0) % 4200e0 END AS DelayFrontLeftEnergy,
 CASE WHEN l_suppkey % 12 = 0 THEN -1e6 ELSE (l_extendedprice * 3e0) % 4200e0 END AS DelayFrontRightEnergy,
 CASE WHEN l_suppkey % 13 = 0 THEN -1e6 ELSE (l_extendedprice * 4e0) % 4200e0 END AS DelayBackLeftEnergy,
 CASE WHEN l_suppkey % 14 = 0 THEN -1e6 ELSE (l_extendedprice * 5e0) % 4200e0 END AS DelayBackRightEnergy,
 CASE WHEN l_suppkey % 15 = 0 THEN -1e6 ELSE (l_extendedprice * 6e0) % 4200e0 END AS AnodeFrontEnergy,
 CASE WHEN l_suppkey % 16 = 0 THEN -1e6 ELSE (l_extendedprice * 7e0) % 4200e0 END AS AnodeBackEnergy,
 CASE WHEN l_suppkey % 17 = 0 THEN -1e6 ELSE (l_extendedprice * 8e0) % 4200e0 END AS CathodeEnergy,
 CASE WHEN l_suppkey % 18 = 0 THEN -1e6 ELSE (l_extendedprice * 9e0) % 4200e0 END AS ScintLeftEnergy,
 CASE WHEN l_suppkey % 19 = 0 THEN -1e6 ELSE (l_extendedprice * 10e0) % 4200e0 END AS ScintRightEnergy,
 CASE WHEN l_partkey % 11 = 0 THEN -1e6 ELSE (l_extendedprice * 2e0) % 5000e0 END AS DelayFrontLeftTime,
 CASE WHEN l_partkey % 12 = 0 THEN -1e6 ELSE (l_extendedprice * 3e0) % 5000e0 END AS DelayFrontRightTime,
 CASE WHEN l_partkey % 13 = 0 THEN -1e6 ELSE (l_extendedprice * 4e0) % 5000e0 END AS DelayBackLeftTime,
 CASE WHEN l_partkey % 14 = 0 THEN -1e6 ELSE (l_extendedprice * 5e0) % 5000e0 END AS DelayBackRightTime,
 CASE WHEN l_partkey % 15 = 0 THEN -1e6 ELSE (l_extendedprice * 6e0) % 5000e0 END AS AnodeFrontTime,
 CASE WHEN l_partkey % 16 = 0 THEN -1e6 ELSE (l_extendedprice * 7e0) % 5000e0 END AS AnodeBackTime,
 CASE WHEN l_partkey % 17 = 0 THEN -1e6 ELSE (l_extendedprice * 8e0) % 5000e0 END AS ScintLeftTime,
 CASE WHEN l_partkey % 18 = 0 THEN -1e6 ELSE (l_extendedprice * 9e0) % 5000e0 END AS ScintRightTime
FROM {lineitem}
"""

QUANTITY = tg.Hist1D("quantity", tg.Axis("l_quantity", 50, 0.0, 50.0))
EVENT_VALUE = tg.Hist1D("event value", tg.Axis("value", 100, 0.0, 500.0))
PART_SIZE = tg.Hist1D("part size", tg.Axis("p_size", 10, 0.0, 50.0))
QTY_PRICE = tg.Hist2D(
    "quantity v price",
    tg.Axis("l_quantity", 50, 0.0, 50.0),
    tg.Axis("l_extendedprice", 64, 0.0, 105000.0),
)
KEY_PRICE = tg.Hist2D(
    "key v price",
    tg.Axis("o_orderkey", 40, 99.5, 9000.25),
    tg.Axis("o_totalprice", 32, 0.0, 500000.0),
)
POSITION = tg.Hist1D("X1", tg.Axis("X1", 600, -300.0, 300.0))
BOTH_POSITIONS = tg.Hist2D(
    "X2 v X1", tg.Axis("X1", 600, -300.0, 300.0), tg.Axis("X2", 600, -300.0, 300.0)
)

WINDOW_1D = (50.0, 200.0)
WINDOW_OUTSIDE = (900.0, 950.0)
WINDOW_X, WINDOW_Y = (10.0, 40.0), (20000.0, 80000.0)

OVERLAY_PICKS = ("X2", "X1: bothplanes", "X1", "X2", "X2: only1plane", "X1: only1plane")


def _star(points: int, cx: float, cy: float, rx: float, ry: float, step: int) -> list:
    angles = [2 * math.pi * ((i * step) % points) / points for i in range(points)]
    return [(cx + rx * math.sin(a), cy + ry * math.cos(a)) for a in angles]


def _wavy(points: int, cx: float, cy: float, rx: float, ry: float) -> list:
    turns = [2 * math.pi * i / points for i in range(points)]
    reach = [1.0 + 0.25 * math.sin(9 * t) for t in turns]
    return [(cx + rx * r * math.cos(t), cy + ry * r * math.sin(t)) for t, r in zip(turns, reach)]


_COLUMNS = ("l_quantity", "l_extendedprice")
TRIANGLE = tg.Cut("triangle", ((10.0, 20000.0), (30.0, 20000.0), (20.0, 60000.0)), *_COLUMNS)
SQUARE = tg.Cut("square", ((5.0, 5e3), (15.0, 5e3), (15.0, 15e3), (5.0, 15e3)), *_COLUMNS)
STAR = tg.Cut("star", tuple(_star(5, 30.0, 50000.0, 15.0, 35000.0, 2)), *_COLUMNS)
WAVY = tg.Cut("wavy", tuple(_wavy(180, 25.0, 45000.0, 18.0, 30000.0)), *_COLUMNS)
KEYS = tg.Cut("keys", ((10.5, 1e3), (6000.25, 1e3), (3000.0, 450e3)), "o_orderkey", "o_totalprice")
UNUSED = tg.Cut("unused", ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0)), "l_quantity", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tg.scan_events(spark, f"{sf_dir}/{name}.parquet")


def detector_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DETECTOR_VIEW, lineitem=table(spark, sf_dir, "lineitem"))


def scratch_dir(spark: SparkSession) -> str:
    """A new folder for written results, in the shared folder the cluster names.

    A session on the local machine without ``spark.checkpoint.dir`` gets a folder of that
    machine. On a cluster its executors could not see each other's files, so there the
    setting is required.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/tallygrid-{uuid.uuid4().hex}"
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all of {master!r} share")
    return tempfile.mkdtemp(prefix="tallygrid-")


# -- fills ---------------------------------------------------------------------------


def _flat(counts: DataFrame) -> DataFrame:
    """A 1D count table without the y bin, which is NULL throughout."""
    return counts.select("hist", F.col("x_bin").alias("bin"), "count")


def _no_nulls(counts: DataFrame) -> DataFrame:
    """A mixed count table with -1 as the y bin of 1D rows."""
    return counts.withColumn("y_bin", F.coalesce("y_bin", F.lit(-1).cast("bigint")))


def hist1d_quantity(spark, sf_dir):
    return _flat(_quantity_counts(spark, sf_dir))


def _quantity_counts(spark, sf_dir):
    return tg.hist1d(table(spark, sf_dir, "lineitem"), QUANTITY)


def hist1d_event_value(spark, sf_dir):
    return _flat(_event_counts(spark, sf_dir))


def _event_counts(spark, sf_dir):
    return tg.hist1d(table(spark, sf_dir, "events"), EVENT_VALUE)


def hist1d_int_column(spark, sf_dir):
    return _flat(tg.hist1d(table(spark, sf_dir, "part"), PART_SIZE))


def hist1d_sentinel_out_of_range(spark, sf_dir):
    return _flat(tg.hist1d(detector_view(spark, sf_dir), POSITION))


def hist2d_qty_price(spark, sf_dir):
    return tg.hist2d(table(spark, sf_dir, "lineitem"), QTY_PRICE)


def hist2d_whole_numbers(spark, sf_dir):
    return tg.hist2d(table(spark, sf_dir, "orders"), KEY_PRICE)


def hist2d_sentinel(spark, sf_dir):
    return tg.hist2d(detector_view(spark, sf_dir), BOTH_POSITIONS)


def hist2d_minmax(spark, sf_dir):
    return tg.count_range(hist2d_sentinel(spark, sf_dir), [BOTH_POSITIONS])


def catalogue_all(spark, sf_dir):
    return _no_nulls(tg.fill_detector_catalogue(detector_view(spark, sf_dir)))


def _small_catalogue(spark, sf_dir):
    specs = [s for s in tg.detector_specs() if s.name in OVERLAY_PICKS]
    return tg.fill_catalogue(detector_view(spark, sf_dir), specs, BASES)


# -- selections and derived columns --------------------------------------------------


def _preset(base: str):
    def query(spark, sf_dir):
        rows = tg.keep(detector_view(spark, sf_dir), BASES[base])
        return rows.select("l_orderkey", "l_linenumber", "X1", "X2", "AnodeBackTime")

    return query


def select_as_double(spark, sf_dir):
    return tg.pick(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_quantity")


def derive_average(spark, sf_dir):
    derived = tg.with_derived_columns(detector_view(spark, sf_dir))
    return derived.select(
        "l_orderkey", "l_linenumber", "DelayFrontAverageEnergy", "DelayBackAverageEnergy"
    )


def derive_time_diff(spark, sf_dir):
    view = detector_view(spark, sf_dir)
    derived = tg.with_derived_columns(view)
    added = [c for c in derived.columns if c not in view.columns and "Time" in c]
    return derived.select("l_orderkey", "l_linenumber", *added)


# -- statistics ----------------------------------------------------------------------


def _rounded(stats: DataFrame) -> DataFrame:
    numbers = [c for c in stats.columns if c not in ("hist", "count")]
    return stats.withColumns({c: F.round(c, 6) for c in numbers})


def stats1d(spark, sf_dir):
    return _rounded(tg.stats1d(_event_counts(spark, sf_dir), [EVENT_VALUE], WINDOW_1D))


def stats1d_windows(spark, sf_dir):
    """A window for each customer, from its balance on."""
    start = F.col("c_acctbal") / 10
    windows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("window_id"), start.alias("start"), (start + 60).alias("end"))
    running = tg.running_sums1d(_event_counts(spark, sf_dir), [EVENT_VALUE])
    found = tg.stats1d_windows(running, [EVENT_VALUE], windows)
    return found.select("window_id", "hist", "count", *(F.round(c, 6).alias(c) for c in ("mean", "stdev")))


def stats1d_outside(spark, sf_dir):
    return _rounded(tg.stats1d(_event_counts(spark, sf_dir), [EVENT_VALUE], WINDOW_OUTSIDE))


def stats1d_strict(spark, sf_dir):
    counts = _event_counts(spark, sf_dir)
    return tg.stats1d(counts, [EVENT_VALUE], WINDOW_OUTSIDE, strict_window=True)


def stats2d(spark, sf_dir):
    counts = hist2d_qty_price(spark, sf_dir)
    return _rounded(tg.stats2d(counts, [QTY_PRICE], WINDOW_X, WINDOW_Y))


def catalogue_stats1d(spark, sf_dir):
    specs = [s for s in tg.detector_specs() if s.kind == "1d"]
    events = tg.with_derived_columns(detector_view(spark, sf_dir))
    return _rounded(tg.stats1d(tg.fill_catalogue(events, specs, BASES), specs))


def catalogue_minmax(spark, sf_dir):
    specs = [s for s in tg.detector_specs() if s.kind == "2d"]
    events = tg.with_derived_columns(detector_view(spark, sf_dir))
    return tg.count_range(tg.fill_catalogue(events, specs, BASES), specs)


def legend1d(spark, sf_dir):
    return tg.legend1d(
        tg.stats1d(_event_counts(spark, sf_dir), [EVENT_VALUE], WINDOW_1D)
    )


def legend2d(spark, sf_dir):
    counts = hist2d_qty_price(spark, sf_dir)
    return tg.legend2d(tg.stats2d(counts, [QTY_PRICE], WINDOW_X, WINDOW_Y))


# -- plot tables ---------------------------------------------------------------------


def step_points(spark, sf_dir):
    return tg.step_points(_quantity_counts(spark, sf_dir), [QUANTITY])


def heatmap_cells(spark, sf_dir):
    return tg.heatmap_cells(hist2d_qty_price(spark, sf_dir), [QTY_PRICE])


def heatmap_colors(spark, sf_dir):
    return tg.heatmap_bars(hist2d_qty_price(spark, sf_dir), [QTY_PRICE])


def hist_names(spark, sf_dir):
    """The names, each with what was counted under it."""
    specs = tg.detector_specs()
    totals = tg.hist_totals(catalogue_all(spark, sf_dir), specs)
    return tg.hist_names(spark, specs).join(totals, "hist").select("hist", "entries", "filled_bins")


def hist_kind(spark, sf_dir):
    specs = [s for s in tg.detector_specs() if s.name in OVERLAY_PICKS]
    known = tg.hist_kind(spark, specs, "X2")
    return known.join(tg.hist_totals(_small_catalogue(spark, sf_dir), specs), ["hist", "kind"])


def _flat_overlay(rows: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("x_bin", "bin").drop("y_bin")


def overlay(spark, sf_dir):
    return _flat_overlay(tg.overlay(_small_catalogue(spark, sf_dir), OVERLAY_PICKS))


# -- cuts ----------------------------------------------------------------------------


def cut_tag(spark, sf_dir):
    tagged = tg.tag_cuts(table(spark, sf_dir, "lineitem"), [TRIANGLE, SQUARE, STAR, WAVY, UNUSED])
    return tagged.select(
        "l_orderkey",
        "l_linenumber",
        *[F.col(c.cut_id).cast("int").alias(c.cut_id) for c in (TRIANGLE, SQUARE, STAR, WAVY)],
    )


def _cut_rows(rows: DataFrame) -> DataFrame:
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


def cut_apply(spark, sf_dir):
    return _cut_rows(tg.apply_cuts(table(spark, sf_dir, "lineitem"), [TRIANGLE]))


def cut_apply_or(spark, sf_dir):
    return _cut_rows(tg.apply_cuts(table(spark, sf_dir, "lineitem"), [SQUARE, STAR, UNUSED]))


def cut_apply_and(spark, sf_dir):
    return _cut_rows(
        tg.apply_cuts(table(spark, sf_dir, "lineitem"), [STAR, TRIANGLE], combine="and")
    )


def cut_apply_large(spark, sf_dir):
    return _cut_rows(tg.apply_cuts(table(spark, sf_dir, "lineitem"), [WAVY]))


def cut_whole_numbers(spark, sf_dir):
    rows = tg.apply_cuts(table(spark, sf_dir, "orders"), [KEYS])
    return rows.select("o_orderkey", "o_totalprice")


def cut_sentinel(spark, sf_dir):
    reach = ((-2e6, -2e6), (0.0, -2e6), (0.0, 0.0), (-2e6, 0.0))
    cut = tg.Cut("low", reach, "X1", "X2")
    rows = tg.apply_cuts(detector_view(spark, sf_dir), [cut])
    return rows.select("l_orderkey", "l_linenumber", "X1", "X2")


def cut_roundtrip(spark, sf_dir):
    folder = scratch_dir(spark)
    paths = [tg.save_cut(spark, c, folder, f"{c.cut_id}.json") for c in (TRIANGLE, STAR)]
    tagged = tg.tag_cuts(table(spark, sf_dir, "lineitem"), tg.load_cuts(spark, paths))
    return tagged.groupBy("cut_1", "cut_2").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("cut_1").cast("int").alias("in_triangle"),
        F.col("cut_2").cast("int").alias("in_star"),
        "n",
    )


# -- files ---------------------------------------------------------------------------


def file_catalogue(spark, sf_dir):
    """Every Parquet file of the folder with the number of rows in it."""
    listed = tg.file_catalogue(spark, sf_dir).select("path", "name")
    files = tg.scan_events(spark, f"{sf_dir}/*.parquet", "file")
    rows = files.groupBy(F.regexp_replace("file", r"\.parquet$", "").alias("name")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    return listed.join(rows, "name").select("name", "n_rows")


def file_select(spark, sf_dir):
    chosen = tg.select_files(tg.file_catalogue(spark, sf_dir), include=["lineitem"])
    events = tg.scan_selected(chosen, "source_file")
    return events.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("sum_qty")
    )


def save_single(spark, sf_dir):
    target = f"{scratch_dir(spark)}/single"
    tg.save_single(spark, f"{sf_dir}/lineitem.parquet", [TRIANGLE, SQUARE], target)
    return _cut_rows(spark.read.parquet(target))


def save_separate(spark, sf_dir):
    target = f"{scratch_dir(spark)}/separate"
    tg.save_separate(spark, f"{sf_dir}/lineitem.parquet", [TRIANGLE, SQUARE], target)
    saved = spark.read.parquet(target)
    return saved.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "out_name"
    )


def save_manifest(spark, sf_dir):
    target = f"{scratch_dir(spark)}/separate"
    paths = f"{sf_dir}/lineitem.parquet"
    return tg.save_separate(spark, paths, [STAR], target, suffix="star", compact=True)


def _many_files(spark, sf_dir):
    """All line items as three files: two by the parity of the order, and one of those with no quantity
    in a cut's reach; returns the folder. Together they are the whole table."""
    folder = scratch_dir(spark)
    items = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_quantity") > 40, "high").when(F.col("l_orderkey") % 2 == 0, "even").otherwise("odd")
    for name in ("even", "odd", "high"):
        items.where(kind == name).write.parquet(f"{folder}/{name}.parquet")
    return folder


def scan_many(spark, sf_dir):
    """A scan over files of the same schema, each row with the folder it came from."""
    folder = _many_files(spark, sf_dir)
    events = tg.scan_events(spark, f"{folder}/*.parquet").withColumn("path", F.col("_metadata.file_path"))
    name = F.regexp_extract("path", r"([a-z]+)\.parquet/", 1)
    return events.groupBy(name.alias("name")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("sum_qty")
    )


def _save_twice(spark, sf_dir):
    """All part files by name, saved with two suffixes into one folder; (folder, second manifest with the folder of each file).

    As many files as tasks wrote: a single one of all rows of a kind would pass through one task.
    """
    folder = _many_files(spark, sf_dir)
    files = tg.scan_events(spark, [f"{folder}/{n}.parquet" for n in ("even", "odd", "high")]).inputFiles()
    target = f"{folder}/saved"
    tg.save_cuts(spark, files, [SQUARE], target, mode="separate", suffix="square")
    manifest = tg.save_cuts(spark, files, [TRIANGLE], target, mode="separate", suffix="triangle")
    kinds = spark.createDataFrame([tuple(reversed(f.rsplit("/", 2)[1:])) for f in files], "source_file string, kind string")
    return target, manifest.join(kinds, "source_file")


def save_many(spark, sf_dir):
    target, _ = _save_twice(spark, sf_dir)
    saved = spark.read.parquet(target)
    cut = F.regexp_extract("out_name", r"_([a-z]+)$", 1).alias("cut")
    return saved.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", cut)


def manifest_many(spark, sf_dir):
    """Rows by kind of input of the second save, the one of high quantities with none."""
    _, manifest = _save_twice(spark, sf_dir)
    kinds = manifest.groupBy("kind").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    return kinds.groupBy("rows").count().withColumnRenamed("count", "files")


def catalogue_below(spark, sf_dir):
    """The catalogue of a folder that holds a saved output: its name=value folders do not count."""
    folder = _many_files(spark, sf_dir)
    tg.scan_events(spark, f"{folder}/odd.parquet").write.partitionBy("l_returnflag").parquet(f"{folder}/all")
    top = tg.file_catalogue(spark, f"{folder}/all").count()
    below = tg.scan_selected(tg.file_catalogue(spark, [f"{folder}/all/l_returnflag={f}" for f in "ANR"]))
    return below.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(top).cast("long").alias("listed_above"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "hist1d_quantity": hist1d_quantity,
    "hist1d_event_value": hist1d_event_value,
    "hist1d_int_column": hist1d_int_column,
    "hist1d_sentinel_out_of_range": hist1d_sentinel_out_of_range,
    "hist2d_qty_price": hist2d_qty_price,
    "hist2d_whole_numbers": hist2d_whole_numbers,
    "hist2d_sentinel": hist2d_sentinel,
    "hist2d_minmax": hist2d_minmax,
    "preset_both_planes": _preset("both planes"),
    "preset_only_x1": _preset("only X1"),
    "preset_only_x2": _preset("only X2"),
    "preset_time_valid": _preset("time valid"),
    "select_as_double": select_as_double,
    "derive_average": derive_average,
    "derive_time_diff": derive_time_diff,
    "stats1d": stats1d,
    "stats1d_windows": stats1d_windows,
    "stats1d_outside": stats1d_outside,
    "stats1d_strict": stats1d_strict,
    "stats2d": stats2d,
    "catalogue_all": catalogue_all,
    "catalogue_stats1d": catalogue_stats1d,
    "catalogue_minmax": catalogue_minmax,
    "cut_tag": cut_tag,
    "cut_apply": cut_apply,
    "cut_apply_or": cut_apply_or,
    "cut_apply_and": cut_apply_and,
    "cut_apply_large": cut_apply_large,
    "cut_whole_numbers": cut_whole_numbers,
    "cut_sentinel": cut_sentinel,
    "cut_roundtrip": cut_roundtrip,
    "step_points": step_points,
    "heatmap_cells": heatmap_cells,
    "heatmap_colors": heatmap_colors,
    "legend1d": legend1d,
    "legend2d": legend2d,
    "hist_names": hist_names,
    "hist_kind": hist_kind,
    "overlay": overlay,
    "file_catalogue": file_catalogue,
    "file_select": file_select,
    "save_single": save_single,
    "save_separate": save_separate,
    "save_manifest": save_manifest,
    "scan_many": scan_many,
    "save_many": save_many,
    "manifest_many": manifest_many,
    "catalogue_below": catalogue_below,
}
