"""What a histogram, a row selection and a polygon cut are, as plain immutable values.

These objects only describe the work. They hold no data, so a catalogue of any
length is a few kilobytes on the driver, and the numbers in them (widths, bounds)
become literals in the Spark plan.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

SENTINEL = -1e6
"""Reading that means "this detector gave nothing"."""


@dataclass(frozen=True)
class Axis:
    """``bins`` equal intervals of ``[lo, hi)`` over one numeric column."""

    column: str
    bins: int
    lo: float
    hi: float

    def __post_init__(self) -> None:
        if not self.column:
            raise ValueError("an axis needs a column name")
        if isinstance(self.bins, bool) or not isinstance(self.bins, int) or self.bins <= 0:
            raise ValueError(f"axis on {self.column!r}: bins must be a positive int, got {self.bins!r}")
        if not (math.isfinite(self.lo) and math.isfinite(self.hi) and self.lo < self.hi):
            raise ValueError(f"axis on {self.column!r}: need finite lo < hi, got [{self.lo}, {self.hi})")

    @property
    def width(self) -> float:
        return (self.hi - self.lo) / self.bins

    def bin_of(self, value: float) -> int | None:
        """Bin that holds a window bound; ``hi`` itself is allowed here and gives ``bins``.

        A bound outside ``[lo, hi]`` has no bin. NaN compares as neither below nor
        above the range and takes bin 0.
        """
        if value < self.lo or value > self.hi:
            return None
        if math.isnan(value):
            return 0
        return math.floor((value - self.lo) / self.width)


@dataclass(frozen=True)
class Selection:
    """Rows in which every ``valid`` column has a reading and every ``missing`` one has none."""

    valid: tuple[str, ...] = ()
    missing: tuple[str, ...] = ()

    @property
    def columns(self) -> tuple[str, ...]:
        return self.valid + self.missing


@dataclass(frozen=True)
class Hist1D:
    """One-dimensional histogram; ``base`` names the selection it is filled from."""

    name: str
    x: Axis
    base: str = "all"

    kind = "1d"

    @property
    def axes(self) -> tuple[Axis, ...]:
        return (self.x,)


@dataclass(frozen=True)
class Hist2D:
    """Two-dimensional histogram; ``base`` names the selection it is filled from."""

    name: str
    x: Axis
    y: Axis
    base: str = "all"

    kind = "2d"

    @property
    def axes(self) -> tuple[Axis, ...]:
        return (self.x, self.y)


HistSpec = Hist1D | Hist2D


@dataclass(frozen=True)
class Cut:
    """Polygon over two columns. The ring closes itself; without both columns it selects nothing."""

    cut_id: str
    vertices: tuple[tuple[float, float], ...]
    x_column: str | None = None
    y_column: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "vertices", tuple((float(x), float(y)) for x, y in self.vertices))
        if not all(math.isfinite(v) for vertex in self.vertices for v in vertex):
            raise ValueError(f"cut {self.cut_id!r} has a vertex that is not finite")

    @property
    def usable(self) -> bool:
        return self.x_column is not None and self.y_column is not None

    @property
    def default_file_name(self) -> str:
        return f"{self.y_column}_{self.x_column}_cut.json" if self.usable else "cut.json"


def unique_specs(specs: Iterable[HistSpec]) -> list[HistSpec]:
    """The specs as a list, after checking that each name is used once."""
    checked = list(specs)
    repeated = _repeated(spec.name for spec in checked)
    if repeated:
        raise ValueError(f"histogram names used more than once: {repeated}")
    return checked


def unique_cuts(cuts: Iterable[Cut]) -> list[Cut]:
    """The cuts as a list, after checking that each id is used once."""
    checked = list(cuts)
    repeated = _repeated(cut.cut_id for cut in checked)
    if repeated:
        raise ValueError(f"cut ids used more than once: {repeated}")
    return checked


def _repeated(names: Iterable[str]) -> list[str]:
    seen: dict[str, int] = {}
    for name in names:
        seen[name] = seen.get(name, 0) + 1
    return sorted(name for name, times in seen.items() if times > 1)


def require_columns(available: Sequence[str], wanted: Iterable[str]) -> None:
    """Fail once, naming every column that is not there."""
    absent = sorted(set(wanted) - set(available))
    if absent:
        raise ValueError(f"columns not in the table: {absent}; it has {sorted(available)}")
