import math
import random

import pytest

from tallygrid import (
    BASES,
    Axis,
    Hist1D,
    Hist2D,
    Selection,
    detector_specs,
    fill_catalogue,
    fill_detector_catalogue,
    hist1d,
    hist2d,
    keep,
    only_first_valid,
    both_valid,
    pick,
    with_derived_columns,
)
from tallygrid.plans.workloads import detector_view

JUST_BELOW = 299.99999999999994
EDGES = [-300.0, -299.5, 0.0, JUST_BELOW, 300.0, -1e6, math.nan, None, -300.00000000000006]
AXIS = Axis("v", 600, -300.0, 300.0)


def as_dict(counts):
    return {(r["hist"], r["x_bin"], r["y_bin"]): r["count"] for r in counts.collect()}


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(v, 1.0) for v in EDGES], "v double, w double")


def test_1d_edges(edges):
    got = as_dict(hist1d(edges, Hist1D("h", AXIS)))
    assert got == {("h", 0, None): 2, ("h", 300, None): 1}


def test_2d_keeps_the_index_that_rounds_up(edges):
    got = as_dict(hist2d(edges, Hist2D("h", AXIS, Axis("w", 2, 0.0, 2.0))))
    assert got == {("h", 0, 1): 2, ("h", 300, 1): 1, ("h", 600, 1): 1}


def test_catalogue_agrees_with_single_fills(edges):
    specs = [Hist1D("one", AXIS), Hist2D("two", AXIS, Axis("w", 2, 0.0, 2.0))]
    want = as_dict(hist1d(edges, specs[0])) | as_dict(hist2d(edges, specs[1]))
    assert as_dict(fill_catalogue(edges, specs)) == want
    assert as_dict(fill_catalogue(edges, specs, entries_per_pass=1)) == want


def test_sentinel_inside_the_range(spark):
    df = spark.createDataFrame([(-1e6, 1.0), (5.0, 1.0), (5.0, -1e6)], "v double, w double")
    wide = Axis("v", 10, -2e6, 2e6)
    flat, square = Hist1D("1", wide), Hist2D("2", wide, Axis("w", 10, -2e6, 2e6))
    got = as_dict(fill_catalogue(df, [flat, square]))
    assert sum(n for (h, *_), n in got.items() if h == "1") == 3
    assert sum(n for (h, *_), n in got.items() if h == "2") == 1
    assert sum(as_dict(hist2d(df, square)).values()) == 1
    off = as_dict(fill_catalogue(df, [flat, square], sentinel=None))
    assert sum(n for (h, *_), n in off.items() if h == "2") == 3
    assert sum(as_dict(hist2d(df, square, sentinel=None)).values()) == 3


def test_keys_too_wide_for_one_word(spark):
    df = spark.createDataFrame([(1.5, 2.5), (1.5, 2.5), (3.5, 0.5)], "v double, w double")
    fine = 2**31
    specs = [
        Hist2D("h", Axis("v", fine, 0.0, 4.0), Axis("w", fine, 0.0, 4.0)),
        Hist1D("flat", Axis("v", 4, 0.0, 4.0)),
        Hist2D("k", Axis("w", 4, 0.0, 4.0), Axis("v", fine, 0.0, 4.0)),
    ]
    want = {}
    for s in specs:
        want |= as_dict(hist1d(df, s) if s.kind == "1d" else hist2d(df, s))
    assert as_dict(fill_catalogue(df, specs)) == want


def test_columns_of_other_types(spark):
    df = spark.createDataFrame([("1.5", 3), ("x", 1), (None, 0)], "`a.b` string, n int")
    specs = [Hist1D("text", Axis("a.b", 4, 0.0, 4.0)), Hist1D("int", Axis("n", 4, 0.0, 4.0))]
    got = as_dict(fill_catalogue(df, specs))
    assert got == {
        ("text", 1, None): 1,
        ("int", 3, None): 1,
        ("int", 1, None): 1,
        ("int", 0, None): 1,
    }
    assert [r["n"] for r in pick(df, "n").collect()] == [3.0, 1.0, 0.0]


def test_empty_table(spark):
    df = spark.createDataFrame([], "v double")
    assert hist1d(df, Hist1D("h", AXIS)).count() == 0
    assert fill_catalogue(df, [Hist1D("h", AXIS)]).count() == 0


def test_missing_columns(spark, edges):
    specs = [Hist1D("there", AXIS), Hist1D("gone", Axis("nope", 10, 0.0, 1.0))]
    with pytest.raises(ValueError, match="nope"):
        fill_catalogue(edges, specs)
    got = as_dict(fill_catalogue(edges, specs, on_missing="skip"))
    assert {h for h, *_ in got} == {"there"}
    assert fill_catalogue(edges, specs[1:], on_missing="skip").count() == 0
    with pytest.raises(ValueError, match="unknown bases"):
        fill_catalogue(edges, [Hist1D("h", AXIS, "nowhere")])


def test_detector_catalogue_without_some_detectors(spark, sf_dir):
    view = detector_view(spark, sf_dir).drop("Theta", "ScintRightTime")
    got = fill_detector_catalogue(view, on_missing="skip").select("hist").distinct()
    names = {r["hist"] for r in got.collect()}
    assert "X1" in names
    assert not names & {"Theta v Xavg: bothplanes", "ScintTimeDif v Xavg"}
    with pytest.raises(ValueError, match="Theta"):
        fill_detector_catalogue(detector_view(spark, sf_dir).drop("Theta"))


def test_presets_split_the_rows(spark, sf_dir):
    view = detector_view(spark, sf_dir)
    both = both_valid(view, "X1", "X2").count()
    first = only_first_valid(view, "X1", "X2").count()
    second = only_first_valid(view, "X2", "X1").count()
    neither = keep(view, Selection(missing=("X1", "X2"))).count()
    assert both + first + second + neither == view.count()
    assert keep(view, BASES["all"]).count() == view.count()


def test_null_and_nan_in_selections(spark):
    df = spark.createDataFrame([(1.0,), (-1e6,), (None,), (math.nan,)], "a double")
    assert keep(df, Selection(valid=("a",))).count() == 2
    assert keep(df, Selection(missing=("a",))).count() == 1


def test_derived_columns(spark, sf_dir):
    view = detector_view(spark, sf_dir)
    derived = with_derived_columns(view)
    assert len(derived.columns) == len(view.columns) + 19
    row = derived.limit(1).collect()[0]
    right, left = row["DelayFrontRightEnergy"], row["DelayFrontLeftEnergy"]
    assert row["DelayFrontAverageEnergy"] == right + left / 2
    assert row["ScintRightTime_ScintLeftTime"] == row["ScintRightTime"] - row["ScintLeftTime"]
    true = with_derived_columns(view, true_mean=True).limit(1).collect()[0]
    assert true["DelayFrontAverageEnergy"] == (right + left) / 2


def test_catalogue_against_brute_force(spark, sf_dir):
    view = with_derived_columns(detector_view(spark, sf_dir))
    rows = [r.asDict() for r in view.collect()]
    tests = {
        "all": lambda r: True,
        "both planes": lambda r: r["X1"] != -1e6 and r["X2"] != -1e6,
        "only X1": lambda r: r["X1"] != -1e6 and r["X2"] == -1e6,
        "only X2": lambda r: r["X2"] != -1e6 and r["X1"] == -1e6,
        "time valid": lambda r: r["AnodeBackTime"] != -1e6 and r["ScintLeftTime"] != -1e6,
    }
    want = {}
    for s in detector_specs():
        for r in rows:
            values = [r[a.column] for a in s.axes]
            if not tests[s.base](r) or (s.kind == "2d" and -1e6 in values):
                continue
            if not all(a.lo <= v < a.hi for a, v in zip(s.axes, values)):
                continue
            bins = [int((v - a.lo) / a.width) for a, v in zip(s.axes, values)]
            if s.kind == "1d" and bins[0] >= s.x.bins:
                continue
            key = (s.name, bins[0], bins[1] if s.kind == "2d" else None)
            want[key] = want.get(key, 0) + 1
    got = as_dict(fill_catalogue(view, detector_specs(), BASES))
    assert got == want


def test_margin_of_2d_is_1d_of_filtered_rows(spark):
    rng = random.Random(5)
    rows = [
        (rng.choice([-1e6, rng.uniform(-400, 400)]), rng.choice([-1e6, rng.uniform(0, 5)]))
        for _ in range(2000)
    ]
    df = spark.createDataFrame(rows, "v double, w double")
    w = Axis("w", 5, 0.0, 5.0)
    margin = hist2d(df, Hist2D("h", AXIS, w)).groupBy("x_bin").sum("count")
    kept = both_valid(df, "v", "w").where("w >= 0 and w < 5")
    flat = hist1d(kept, Hist1D("h", AXIS))
    want = {r["x_bin"]: r["count"] for r in flat.collect()}
    assert {r[0]: r[1] for r in margin.collect()} == want


def test_a_bin_with_a_third_of_all_rows(spark):
    df = spark.range(30_000, numPartitions=7).selectExpr(
        "if(id % 3 = 0, 5D, cast(id % 600 AS double) - 300D) AS v", "1D AS w"
    )
    specs = [Hist1D("h", AXIS), Hist2D("k", AXIS, Axis("w", 2, 0.0, 2.0))]
    counts = fill_catalogue(df, specs)
    hot = {r["hist"]: r["count"] for r in counts.where("x_bin = 305").collect()}
    assert hot == {"h": 10_000 + 50, "k": 10_000 + 50}
    assert counts.groupBy("hist").sum("count").where("`sum(count)` = 30000").count() == 2
