"""The physical plans are part of the contract: pushed filters, pruned columns, no Python."""

import contextlib
import io
import re

import pytest

import tallygrid as tg
from tallygrid.operators.fill import ENTRIES_PER_PASS
from tallygrid.plans import workloads as w
from tallygrid.plans.detector import BASES


def explained(df, mode="formatted"):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain(mode)
    return text.getvalue()


@pytest.fixture(scope="module")
def events(spark, sf_dir, tmp_path_factory):
    """The detector view as a stored Parquet table, as events really come."""
    path = str(tmp_path_factory.mktemp("detector") / "events")
    w.detector_view(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def test_sentinel_and_range_reach_the_reader(events):
    plan = explained(tg.hist2d(events, w.BOTH_POSITIONS))
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "Not(EqualTo(X1,-1000000.0))" in pushed
    assert "GreaterThanOrEqual(X2,-300.0)" in pushed
    assert "LessThan(X1,300.0)" in pushed
    assert "ReadSchema: struct<X1:double,X2:double>" in plan


def test_preset_reaches_the_reader(events):
    plan = explained(tg.keep(events, BASES["only X1"]))
    assert "Not(EqualTo(X1,-1000000.0))" in plan
    assert "EqualTo(X2,-1000000.0)" in plan


@pytest.mark.parametrize("combine", ["or", "and"])
def test_bounding_boxes_reach_the_reader(events, combine):
    cuts = [
        tg.Cut(str(k), ((k, 1.0), (k + 50.0, 1.0), (k, 90.0)), "X1", "AnodeBackEnergy")
        for k in (0.0, 70.0)
    ]
    plan = explained(tg.apply_cuts(events, cuts, combine=combine))
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "GreaterThan(X1,70.0)" in pushed
    assert "LessThan(AnodeBackEnergy,90.0)" in pushed
    assert "Exchange" not in plan


def test_single_fill_has_one_shuffle_with_partial_counts(events):
    plan = explained(tg.hist1d(events, w.POSITION), "simple")
    assert plan.count("Exchange") == 1
    assert plan.count("HashAggregate") == 2


def test_catalogue_passes(events):
    counts = tg.fill_detector_catalogue(events)
    plan = explained(counts, "simple")
    passes = -(-58 // ENTRIES_PER_PASS)
    assert plan.count("FileScan") == plan.count("Exchange hashpartitioning(key") == passes
    assert "Join" not in plan
    assert "SortAggregate" not in plan


def test_catalogue_methods_stay_compilable(spark, events):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = explained(tg.fill_detector_catalogue(events), "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000


def test_one_action_fills_the_catalogue(spark, events):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fill", "planning only")
    tg.fill_detector_catalogue(events)
    assert len(tracker.getJobIdsForGroup("fill")) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_large_polygon_is_one_constant(events):
    cut = tg.Cut("wavy", w.WAVY.vertices, "X1", "X2")
    plan = explained(tg.apply_cuts(events, [cut]), "extended")
    optimized = plan.split("== Optimized Logical Plan ==")[1]
    assert "from_json" not in optimized
    assert "aggregate" in optimized


@pytest.mark.parametrize(
    "name", [n for n in w.QUERIES if not n.startswith(("save", "file", "cut_roundtrip"))]
)
def test_no_python_in_any_plan(spark, sf_dir, name):
    plan = explained(w.QUERIES[name](spark, sf_dir), "simple")
    assert not re.search(r"Python|Arrow|MapInPandas|CartesianProduct|NestedLoop", plan)


def test_passes_of_the_catalogue_share_columns(spark, tmp_path):
    """Each pass reads what its entries need; together not much more than every column once."""
    from tallygrid.plans.workloads import detector_view

    path = str(tmp_path / "events")
    detector_view(spark, "/root/testdata/sf0.001").write.parquet(path)
    plan = explained(tg.fill_detector_catalogue(spark.read.parquet(path)))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert len(schemas) == 3
    assert sum(schema.count(":") for schema in schemas) <= 31


def test_cuts_are_settled_in_generated_code(spark, sf_dir):
    plan = explained(w.QUERIES["cut_apply_or"](spark, sf_dir), "simple")
    lines = [line.strip(" :+-") for line in plan.splitlines()]
    settling = [line for line in lines if "Filter (NOT (code0" in line]
    assert settling and all(line.startswith("*(") for line in settling)
    assert "transform(" not in settling[0] and "Exchange" not in plan
    assert sum("code0" in line and line.startswith("*(") and "Project" in line for line in lines) >= 1


@pytest.mark.parametrize("query", ["cut_tag", "cut_apply_or", "cut_apply_large"])
def test_methods_of_cuts_stay_compilable(spark, sf_dir, query):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = explained(w.QUERIES[query](spark, sf_dir), "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000


@pytest.fixture(scope="module")
def whole_numbers(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole") / "table")
    rows = spark.range(1000).selectExpr("id * 7 - 1000 AS k", "CAST(id * 1.25 AS DECIMAL(12,2)) AS d", "CAST(id AS DOUBLE) AS v")
    rows.write.parquet(path)
    return spark.read.parquet(path)


def test_whole_numbers_and_decimals_reach_the_reader(whole_numbers):
    spec = tg.Hist2D("h", tg.Axis("k", 10, 0.5, 100.25), tg.Axis("d", 10, 10.001, 50.0))
    pushed = next(x for x in explained(tg.hist2d(whole_numbers, spec)).splitlines() if "PushedFilters" in x)
    for part in ("GreaterThanOrEqual(k,1)", "LessThanOrEqual(k,100)", "GreaterThanOrEqual(d,10.01)", "LessThanOrEqual(d,49.99)"):
        assert part in pushed
    cut = tg.Cut("c", ((0.5, 10.001), (100.25, 10.001), (50.0, 50.0)), "k", "d")
    pushed = next(x for x in explained(tg.apply_cuts(whole_numbers, [cut])).splitlines() if "PushedFilters" in x)
    for part in ("GreaterThanOrEqual(k,1)", "LessThanOrEqual(k,100)", "GreaterThanOrEqual(d,10.01)", "LessThanOrEqual(d,49.99)"):
        assert part in pushed
    pushed = next(x for x in explained(tg.keep(whole_numbers, tg.Selection(missing=("k",)))).splitlines() if "PushedFilters" in x)
    assert "GreaterThanOrEqual(k,-1000000)" in pushed and "LessThanOrEqual(k,-1000000)" in pushed
