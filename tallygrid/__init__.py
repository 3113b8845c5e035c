"""Histograms and polygon cuts over Parquet event tables, as Spark plans."""

from tallygrid.operators.cuts import apply_cuts, tag_cuts
from tallygrid.operators.derive import (
    both_valid,
    difference,
    keep,
    mean_of_two,
    only_first_valid,
    pick,
)
from tallygrid.operators.fill import fill_catalogue, hist1d, hist2d
from tallygrid.operators.geometry import spec_table
from tallygrid.operators.render import (
    dense_counts,
    heatmap_bars,
    heatmap_cells,
    hist_kind,
    hist_names,
    hist_totals,
    overlay,
    step_points,
)
from tallygrid.operators.stats import (
    bin_window,
    count_range,
    legend1d,
    legend2d,
    running_sums1d,
    stats1d,
    stats1d_windows,
    stats2d,
)
from tallygrid.plans.detector import (
    BASES,
    detector_specs,
    fill_detector_catalogue,
    with_derived_columns,
)
from tallygrid.sources.cut_files import cut_table, load_cuts, save_cut
from tallygrid.sources.events import (
    file_catalogue,
    scan_events,
    scan_selected,
    select_files,
    toggle_file,
)
from tallygrid.sources.reduced import finish_saves, save_cuts, save_separate, save_single
from tallygrid.specs import SENTINEL, Axis, Cut, Hist1D, Hist2D, Selection

__all__ = [
    "BASES",
    "SENTINEL",
    "Axis",
    "Cut",
    "Hist1D",
    "Hist2D",
    "Selection",
    "apply_cuts",
    "bin_window",
    "both_valid",
    "count_range",
    "cut_table",
    "dense_counts",
    "detector_specs",
    "difference",
    "file_catalogue",
    "fill_catalogue",
    "fill_detector_catalogue",
    "heatmap_bars",
    "heatmap_cells",
    "hist1d",
    "hist2d",
    "hist_kind",
    "hist_names",
    "hist_totals",
    "keep",
    "legend1d",
    "legend2d",
    "load_cuts",
    "mean_of_two",
    "only_first_valid",
    "overlay",
    "pick",
    "save_cut",
    "save_cuts",
    "finish_saves",
    "save_separate",
    "save_single",
    "scan_events",
    "scan_selected",
    "select_files",
    "spec_table",
    "running_sums1d",
    "stats1d",
    "stats1d_windows",
    "stats2d",
    "step_points",
    "tag_cuts",
    "toggle_file",
    "with_derived_columns",
]
