"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose the
data and the cores. Every query is evaluated in full into a no-op sink; the time is the
best of ``BENCH_RUNS`` (default 2) runs, planning included. With ``BENCH_COMPARE=1`` the
catalogue is also filled by one job per histogram, the execution it replaces.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

import tallygrid as tg
from tallygrid.plans.detector import BASES
from tallygrid.plans.workloads import QUERIES, detector_view

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINE = (
    "hist1d_quantity",
    "hist2d_qty_price",
    "hist2d_sentinel",
    "preset_both_planes",
    "derive_time_diff",
    "catalogue_all",
    "catalogue_stats1d",
    "stats1d",
    "stats2d",
    "step_points",
    "heatmap_colors",
    "overlay",
    "cut_tag",
    "cut_apply_or",
    "cut_apply_large",
    "save_single",
    "save_separate",
)


def evaluate(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def timed(work) -> float:
    best = None
    for _ in range(RUNS):
        started = time.perf_counter()
        work()
        seconds = time.perf_counter() - started
        best = seconds if best is None else min(best, seconds)
    return round(best, 3)


def one_job_per_histogram(spark) -> None:
    events = tg.with_derived_columns(detector_view(spark, SF_DIR))
    for spec in tg.detector_specs():
        fill = tg.hist1d if spec.kind == "1d" else tg.hist2d
        evaluate(fill(events, spec, BASES))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("tallygrid-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    evaluate(spark.read.parquet(f"{SF_DIR}/lineitem.parquet"))
    seconds = {}
    for name in HEADLINE:
        seconds[name] = timed(lambda query=QUERIES[name]: evaluate(query(spark, SF_DIR)))
        print(f"{name}: {seconds[name]} s", file=sys.stderr, flush=True)
    result = {
        "metric": "headline queries, sum of best times",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": SF_DIR.rstrip("/").rsplit("/sf", 1)[-1],
    }
    if os.environ.get("BENCH_COMPARE") == "1":
        result["compare"] = {"one_job_per_histogram": timed(lambda: one_job_per_histogram(spark))}
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
