"""The focal-plane detector catalogue: 19 derived columns, 5 selections, 58 histograms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from tallygrid.operators.derive import difference, mean_of_two
from tallygrid.operators.fill import ENTRIES_PER_PASS, fill_catalogue
from tallygrid.specs import SENTINEL, Axis, Hist1D, Hist2D, HistSpec, Selection, require_columns

BASES = {
    "all": Selection(),
    "both planes": Selection(valid=("X1", "X2")),
    "only X1": Selection(valid=("X1",), missing=("X2",)),
    "only X2": Selection(valid=("X2",), missing=("X1",)),
    "time valid": Selection(valid=("AnodeBackTime", "ScintLeftTime")),
}

# Binnings used by the catalogue (bins, lower end, upper end).
BINNINGS = {
    "position": (600, -300.0, 300.0),
    "energy": (256, 0.0, 4096.0),
    "fine energy": (512, 0.0, 4096.0),
    "angle": (300, 0.0, math.pi / 2),
    "time": (1000, -3000.0, 3000.0),
    "fine time": (12800, -3200.0, 3200.0),
}

# The two energy sums, "alias = right + left / 2".
ENERGY_SUMS = """
DelayFrontAverageEnergy = DelayFrontRightEnergy + DelayFrontLeftEnergy
DelayBackAverageEnergy = DelayBackRightEnergy + DelayBackLeftEnergy
"""

# The 17 time differences; each is named "minuend_subtrahend".
TIME_DIFFERENCES = """
DelayFrontLeftTime - AnodeFrontTime
DelayFrontRightTime - AnodeFrontTime
DelayBackLeftTime - AnodeFrontTime
DelayBackRightTime - AnodeFrontTime
DelayFrontLeftTime - AnodeBackTime
DelayFrontRightTime - AnodeBackTime
DelayBackLeftTime - AnodeBackTime
DelayBackRightTime - AnodeBackTime
AnodeFrontTime - AnodeBackTime
AnodeBackTime - AnodeFrontTime
AnodeFrontTime - ScintLeftTime
AnodeBackTime - ScintLeftTime
DelayFrontLeftTime - ScintLeftTime
DelayFrontRightTime - ScintLeftTime
DelayBackLeftTime - ScintLeftTime
DelayBackRightTime - ScintLeftTime
ScintRightTime - ScintLeftTime
"""

# The 58 entries, "name | base | x column, binning | y column, binning".
ENTRIES = """
X1 | all | X1, position
X2 | all | X2, position
X2 v X1 | all | X1, position | X2, position
DelayBackRight v X1 | all | X1, position | DelayBackRightEnergy, energy
DelayBackLeft v X1 | all | X1, position | DelayBackLeftEnergy, energy
DelayFrontRight v X1 | all | X1, position | DelayFrontRightEnergy, energy
DelayFrontLeft v X1 | all | X1, position | DelayFrontLeftEnergy, energy
DelayBackRight v X2 | all | X2, position | DelayBackRightEnergy, energy
DelayBackLeft v X2 | all | X2, position | DelayBackLeftEnergy, energy
DelayFrontRight v X2 | all | X2, position | DelayFrontRightEnergy, energy
DelayFrontLeft v X2 | all | X2, position | DelayFrontLeftEnergy, energy
DelayBackRight v Xavg | all | Xavg, position | DelayBackRightEnergy, energy
DelayBackLeft v Xavg | all | Xavg, position | DelayBackLeftEnergy, energy
DelayFrontRight v Xavg | all | Xavg, position | DelayFrontRightEnergy, energy
DelayFrontLeft v Xavg | all | Xavg, position | DelayFrontLeftEnergy, energy
DelayFrontAverage v X1 | all | X1, position | DelayFrontAverageEnergy, energy
DelayBackAverage v X1 | all | X1, position | DelayBackAverageEnergy, energy
DelayFrontAverage v X2 | all | X2, position | DelayFrontAverageEnergy, energy
DelayBackAverage v X2 | all | X2, position | DelayBackAverageEnergy, energy
DelayFrontAverage v Xavg | all | Xavg, position | DelayFrontAverageEnergy, energy
DelayBackAverage v Xavg | all | Xavg, position | DelayBackAverageEnergy, energy
AnodeBack v ScintLeft | all | ScintLeftEnergy, fine energy | AnodeBackEnergy, fine energy
AnodeFront v ScintLeft | all | ScintLeftEnergy, energy | AnodeFrontEnergy, energy
Cathode v ScintLeft | all | ScintLeftEnergy, energy | CathodeEnergy, energy
AnodeBack v ScintRight | all | ScintRightEnergy, energy | AnodeBackEnergy, energy
AnodeFront v ScintRight | all | ScintRightEnergy, energy | AnodeFrontEnergy, energy
Cathode v ScintRight | all | ScintRightEnergy, energy | CathodeEnergy, energy
ScintLeft v X1 | all | X1, position | ScintLeftEnergy, energy
ScintLeft v X2 | all | X2, position | ScintLeftEnergy, energy
ScintLeft v Xavg | all | Xavg, position | ScintLeftEnergy, energy
ScintRight v X1 | all | X1, position | ScintRightEnergy, energy
ScintRight v X2 | all | X2, position | ScintRightEnergy, energy
ScintRight v Xavg | all | Xavg, position | ScintRightEnergy, energy
AnodeBack v X1 | all | X1, position | AnodeBackEnergy, energy
AnodeBack v X2 | all | X2, position | AnodeBackEnergy, energy
AnodeBack v Xavg | all | Xavg, position | AnodeBackEnergy, energy
AnodeFront v X1 | all | X1, position | AnodeFrontEnergy, energy
AnodeFront v X2 | all | X2, position | AnodeFrontEnergy, energy
AnodeFront v Xavg | all | Xavg, position | AnodeFrontEnergy, energy
Cathode v X1 | all | X1, position | CathodeEnergy, energy
Cathode v X2 | all | X2, position | CathodeEnergy, energy
Cathode v Xavg | all | Xavg, position | CathodeEnergy, energy
X1: bothplanes | both planes | X1, position
X2: bothplanes | both planes | X2, position
Xavg: bothplanes | both planes | Xavg, position
Theta v Xavg: bothplanes | both planes | Xavg, position | Theta, angle
X1: only1plane | only X1 | X1, position
X2: only1plane | only X2 | X2, position
AnodeFrontTime-AnodeBackTime | time valid | AnodeFrontTime_AnodeBackTime, time
AnodeBackTime-AnodeFrontTime | time valid | AnodeBackTime_AnodeFrontTime, time
AnodeFrontTime-ScintLeftTime | time valid | AnodeFrontTime_ScintLeftTime, time
AnodeBackTime-ScintLeftTime | time valid | AnodeBackTime_ScintLeftTime, time
DelayFrontLeftTime-ScintLeftTime | time valid | DelayFrontLeftTime_ScintLeftTime, time
DelayFrontRightTime-ScintLeftTime | time valid | DelayFrontRightTime_ScintLeftTime, time
DelayBackLeftTime-ScintLeftTime | time valid | DelayBackLeftTime_ScintLeftTime, time
DelayBackRightTime-ScintLeftTime | time valid | DelayBackRightTime_ScintLeftTime, time
ScintRightTime-ScintLeftTime | time valid | ScintRightTime_ScintLeftTime, time
ScintTimeDif v Xavg | time valid | Xavg, position | ScintRightTime_ScintLeftTime, fine time
"""


def _fields(text: str, separator: str) -> list[list[str]]:
    lines = text.strip().splitlines()
    return [[field.strip() for field in line.split(separator)] for line in lines]


def _axis(text: str) -> Axis:
    column, binning = (part.strip() for part in text.split(","))
    return Axis(column, *BINNINGS[binning])


def detector_specs() -> list[HistSpec]:
    """The 58 histograms, in catalogue order."""
    return [
        Hist1D(name, _axis(axes[0]), base)
        if len(axes) == 1
        else Hist2D(name, _axis(axes[0]), _axis(axes[1]), base)
        for name, base, *axes in _fields(ENTRIES, "|")
    ]


def with_derived_columns(
    df: DataFrame, true_mean: bool = False, on_missing: str = "raise"
) -> DataFrame:
    """The event table with the 19 derived columns, added in one projection.

    With ``on_missing="skip"`` a derived column whose sources are absent is left out.
    """
    added = {}
    wanted = []
    for alias, sources in _fields(ENERGY_SUMS, "="):
        right, left = (part.strip() for part in sources.split("+"))
        wanted += [right, left]
        if {right, left} <= set(df.columns):
            added[alias] = mean_of_two(df, right, left, alias, true_mean)
    for a, b in _fields(TIME_DIFFERENCES, "-"):
        wanted += [a, b]
        if {a, b} <= set(df.columns):
            added[f"{a}_{b}"] = difference(df, a, b)
    if on_missing == "raise":
        require_columns(df.columns, wanted)
    return df.withColumns(added) if added else df


def fill_detector_catalogue(
    df: DataFrame,
    sentinel: float = SENTINEL,
    on_missing: str = "raise",
    entries_per_pass: int = ENTRIES_PER_PASS,
) -> DataFrame:
    """Count table of all 58 histograms of an event table."""
    events = with_derived_columns(df, on_missing=on_missing)
    return fill_catalogue(
        events, detector_specs(), BASES, sentinel, on_missing, entries_per_pass
    )
