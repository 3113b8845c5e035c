"""Point in polygon as SQL expressions, exact for all finite doubles.

A point is inside when the winding number of the closed ring around it is not zero
(so the middle of a self-crossing star is inside) and it lies on no edge.

Cost per row hardly grows with the polygon:

* four comparisons against the bounding box come first; they prune Parquet row
  groups and leave the rest to rows near the polygon;
* a grid over the bounding box, prepared while the plan is built, says of each cell
  that it is outside, inside, or near an edge; the first two settle a row by one array
  lookup in generated code, whatever the polygon looks like;
* for rows near an edge the y range is divided into equal strips with at most ``SLOTS``
  edges each, and generated code sums the terms of these slots. A term counts if its sign
  is beyond the rounding error; if one is not, the row is undecided (``settled``);
* undecided rows, and those near an edge of a polygon too dense for slots, visit the edges of
  their strip one by one, with products split into whole numbers that are added up exactly.

Coordinates are scaled by powers of two where they are divided or multiplied, so no extent is
too large or too small. Cell and strip numbers come from the same monotone double formula for
edges and points, and the neighbours of every cell an edge touches count as near it, so rounding
cannot move a point past an edge.
"""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Sequence

from tallygrid.functions.readings import double

Vertex = tuple[float, float]
Edge = tuple[float, float, float, float]

MAX_STRIPS = 4096
MAX_LISTED = 16
GRID = 64

OUTSIDE, INSIDE, NEAR_EDGE = 0, 1, 2
#: Edges of a strip that generated code looks at; what ``settled`` says of a row it leaves open.
SLOTS, UNDECIDED = 5, 2
#: A turn beyond this share of its two products has the right sign; the second bound covers underflow.
ROUNDING, LEAST_TURN = 2.0**-51, 2.0**-900

# Far above any winding number, so that one sum carries both.
_ON_EDGE = 1 << 40
# Above twice the number of slots, likewise.
_UNSURE = 64
# A y that no point within a box reaches.
_FAR = 1.7976931348623157e308
_EDGES = "array<struct<x1: double, y1: double, x2: double, y2: double>>"


def ring_edges(vertices: Sequence[Vertex]) -> list[Edge]:
    """Edges of the closed ring; repeated vertices give no edge."""
    ring = list(vertices)
    if ring and ring[0] != ring[-1]:
        ring.append(ring[0])
    return [(*a, *b) for a, b in zip(ring, ring[1:]) if a != b]


def bounding_box(x: str, y: str, vertices: Sequence[Vertex]) -> str:
    """Strictly inside the box. NaN is above every number in Spark and fails the upper tests."""
    xs = [float(v[0]) for v in vertices]
    ys = [float(v[1]) for v in vertices]
    return f"({x} > {double(min(xs))} AND {x} < {double(max(xs))} AND {y} > {double(min(ys))} AND {y} < {double(max(ys))})"


def has_area(vertices: Sequence[Vertex]) -> bool:
    """Whether any point can be inside at all: three corners, spread over both directions."""
    spread_x = len({v[0] for v in vertices}) > 1
    spread_y = len({v[1] for v in vertices}) > 1
    return len(set(vertices)) >= 3 and spread_x and spread_y


def scale(values: Sequence[float]) -> float:
    """The power of two that brings the largest of the values to about 1; 1 if products of them are far from the ends."""
    power = math.frexp(max(map(abs, values)))[1]
    return 1.0 if abs(power) <= 400 else math.ldexp(1.0, max(-1074, min(1023, -power)))


def _times(value: str, factor: float) -> str:
    return value if factor == 1.0 else f"({value} * {double(factor)})"


def inside_polygon(x: str, y: str, vertices: Sequence[Vertex]) -> str:
    """True inside, false or NULL elsewhere (NULL only for a NULL coordinate)."""
    if not has_area(vertices):
        return "false"
    cell = _cell(x, y, ring_edges(vertices))
    inside = f"CASE WHEN {cell} = {NEAR_EDGE} THEN {exact_inside(x, y, vertices)} ELSE {cell} = {INSIDE} END"
    return f"({bounding_box(x, y, vertices)} AND {inside})"


def exact_inside(x: str, y: str, vertices: Sequence[Vertex]) -> str:
    """The same for points within the bounding box, edge by edge."""
    if not has_area(vertices):
        return "false"
    edges = ring_edges(vertices)
    lowest, height, table = strips(edges)
    scale_x, scale_y = scale([e[0] for e in edges]), scale([e[1] for e in edges])
    strip = _number_of(f"({_times(y, scale_y)} - {double(lowest)}) / {double(height)}", len(table) - 1)
    near = f"transform(get({_constant(table, 'array<array<int>>')}, {strip}), i -> get({_constant(_edge_rows(edges), _EDGES)}, i))"
    turn, error = _turn(x, y, "e.x1", "e.y1", "e.x2", "e.y2", scale_x, scale_y)
    exact = exact_sign(x, y, "e.x1", "e.y1", "e.x2", "e.y2")
    side = f"CASE WHEN abs({turn}) > {error} THEN CAST(signum({turn}) AS INT) ELSE {exact} END"
    sides = f"transform({near}, e -> struct(e AS e, {side} AS side))"
    # +1 for an upward edge the point lies left of, -1 for a downward one, or the edge mark
    y1, y2, x1, x2 = "s.e.y1", "s.e.y2", "s.e.x1", "s.e.x2"
    touches = f"{y} BETWEEN least({y1}, {y2}) AND greatest({y1}, {y2}) AND {x} BETWEEN least({x1}, {x2}) AND greatest({x1}, {x2})"
    term = f"""CASE WHEN s.side = 0 AND {touches} THEN {_ON_EDGE}L
        WHEN s.side > 0 AND {y1} <= {y} AND {y} < {y2} THEN 1L WHEN s.side < 0 AND {y2} <= {y} AND {y} < {y1} THEN -1L ELSE 0L END"""
    return f"aggregate({sides}, 0L, (total, s) -> total + {term}, total -> total <> 0 AND total < {_ON_EDGE // 2}L)"


def near_polygon(x: str, y: str, vertices: Sequence[Vertex]) -> str:
    """Whether the point is in a cell of the grid that is not outside; NULL for a NULL coordinate."""
    if not has_area(vertices):
        return "false"
    return f"({bounding_box(x, y, vertices)} AND {_cell(x, y, ring_edges(vertices))} <> {OUTSIDE})"


def slot_edges(y: str, vertices: Sequence[Vertex]) -> list[str]:
    """The edges that a row at this height can touch, one struct for each slot; empty for dense polygons."""
    edges = ring_edges(vertices)
    listed = slots(edges) if has_area(vertices) else None
    if listed is None:
        return []
    lowest, height, count, numbers = listed
    # A last edge that no row reaches fills free slots.
    known = _constant(_edge_rows([*edges, (0.0, _FAR, 0.0, _FAR)]), _EDGES)
    factor, width = scale([e[1] for e in edges]), len(numbers) // (count + 1)
    strip = _number_of(f"({_times(y, factor)} - {double(lowest)}) / {double(height)}", count)
    table = _constant(numbers, "array<int>")
    return [f"get({known}, get({table}, {strip} * {width} + {slot}))" for slot in range(width)]


def settled(x: str, y: str, vertices: Sequence[Vertex], near_edges: Sequence[str] | None = None) -> str:
    """``INSIDE``, ``OUTSIDE``, or ``UNDECIDED`` where rounding or the density of edges leaves it open.

    ``near_edges`` name columns that hold ``slot_edges``. Made of arithmetic without branches, so that a projection
    computes what its terms share once, in generated code. NULL for a NULL coordinate.
    """
    if not has_area(vertices):
        return str(OUTSIDE)
    edges = ring_edges(vertices)
    near_edges = slot_edges(y, vertices) if near_edges is None else near_edges
    box, cell = bounding_box(x, y, vertices), _cell(x, y, edges)
    near, sure = f"({box} AND {cell} = {NEAR_EDGE})", f"({box} AND {cell} = {INSIDE})"
    if not near_edges:
        return f"(CAST({sure} AS INT) + CAST({near} AS INT) * {UNDECIDED})"
    scale_x, scale_y = scale([e[0] for e in edges]), scale([e[1] for e in edges])
    px, py = f"coalesce({x}, 0D)", f"coalesce({y}, 0D)"
    terms = []
    for edge in near_edges:
        x1, y1, x2, y2 = (f"coalesce({edge}.{name}, 0D)" for name in ("x1", "y1", "x2", "y2"))
        turn, error = _turn(px, py, x1, y1, x2, y2, scale_x, scale_y)
        terms.append(f"CAST(({y1} <= {py} AND {py} < {y2} AND {turn} > {error}) AS INT)")
        terms.append(f"-CAST(({y2} <= {py} AND {py} < {y1} AND {turn} < -{error}) AS INT)")
        unsure = f"abs({turn}) <= {error} AND least({y1}, {y2}) <= {py} AND {py} <= greatest({y1}, {y2})"
        terms.append(f"CAST(({unsure}) AS INT) * {_UNSURE}")
    # What is named more than once, the sum and the cell, gets a method of its own.
    total, bound = f"({' + '.join(terms)})", _UNSURE // 2
    result = f"(CAST(({total} <> 0 AND {total} < {bound}) AS INT) + CAST(({total} >= {bound}) AS INT) * {UNDECIDED})"
    return f"(CAST({sure} AS INT) + CAST({near} AS INT) * {result})"


def grid_of(edges: Sequence[Edge]) -> Edge:
    """The grid as (lowest x, lowest y, cell width, cell height), of scaled coordinates."""
    found = []
    for at in (0, 1):
        factor = scale([e[at] for e in edges])
        values = [e[at] * factor for e in edges]
        found.append((min(values), (max(values) - min(values)) / GRID))
    return found[0][0], found[1][0], found[0][1], found[1][1]


@functools.lru_cache(maxsize=256)
def _cells_text(edges: tuple[Edge, ...]) -> tuple[Edge, str]:
    """``cells`` as a JSON text, kept for polygons that are named again."""
    frame, kinds = cells(edges)
    return frame, json.dumps(kinds)


def cells(edges: Sequence[Edge]) -> tuple[Edge, list[int]]:
    """The grid of ``grid_of``, and the kind of each cell.

    Cells are listed column by column. A cell is near an edge if an edge passes through
    it or through one of its eight neighbours. Everything is reckoned in cells, where rounding
    is far below the width of one.
    """
    low_x, low_y, width, height = grid_of(edges)
    factors = scale([e[0] for e in edges]), scale([e[1] for e in edges])

    def in_cells(x: float, y: float) -> tuple[float, float]:
        return (x * factors[0] - low_x) / width, (y * factors[1] - low_y) / height

    lines = [(*in_cells(x1, y1), *in_cells(x2, y2)) for x1, y1, x2, y2 in edges]
    size = GRID + 1
    kinds = [OUTSIDE] * (size * size)
    near = [[False] * size for _ in range(size)]
    for x1, y1, x2, y2 in lines:
        first, last = math.floor(min(x1, x2)), math.floor(max(x1, x2))
        for column in range(max(first - 1, 0), min(last + 2, size)):
            # the part of the edge over this column and its neighbours
            ends = [0.0, 1.0]
            if x1 != x2:
                ends = [min(1.0, max(0.0, (x - x1) / (x2 - x1))) for x in (column - 1, column + 2)]
            ys = [y1 + t * (y2 - y1) for t in ends]
            bottom = max(math.floor(min(ys)) - 1, 0)
            top = min(math.floor(max(ys)) + 2, size)
            near[column][bottom:top] = [True] * (top - bottom)
    for row in range(size):
        y = row + 0.5
        crossings = sorted(
            (x1 + (y - y1) / (y2 - y1) * (x2 - x1), 1 if y1 < y2 else -1)
            for x1, y1, x2, y2 in lines
            if min(y1, y2) <= y < max(y1, y2)
        )
        passed, winding = 0, sum(step for _, step in crossings)
        for column in range(size):
            x = column + 0.5
            while passed < len(crossings) and crossings[passed][0] <= x:
                winding -= crossings[passed][1]
                passed += 1
            kind = INSIDE if winding else OUTSIDE
            kinds[column * size + row] = NEAR_EDGE if near[column][row] else kind
    return (low_x, low_y, width, height), kinds


def _cell(x: str, y: str, edges: Sequence[Edge]) -> str:
    (low_x, low_y, width, height), kinds = _cells_text(tuple(edges))
    scale_x, scale_y = scale([e[0] for e in edges]), scale([e[1] for e in edges])
    column = _number_of(f"({_times(x, scale_x)} - {double(low_x)}) / {double(width)}", GRID)
    row = _number_of(f"({_times(y, scale_y)} - {double(low_y)}) / {double(height)}", GRID)
    return f"get({_constant(kinds, 'array<int>')}, {column} * {GRID + 1} + {row})"


def _number_of(place: str, most: int) -> str:
    """The whole part, held within 0 and ``most``: rows outside the box may have any value."""
    return f"CAST(floor(greatest(0D, least({place}, {most}D))) AS INT)"


def _edge_rows(edges: Sequence[Edge]) -> list[dict[str, float]]:
    return [dict(zip(("x1", "y1", "x2", "y2"), map(float, edge))) for edge in edges]


def _constant(value: object, schema: str) -> str:
    """One JSON literal that the optimizer folds to a value when the plan is built."""
    text = value if isinstance(value, str) else json.dumps(value)
    return f"from_json('{text}', '{schema}', map('mode', 'FAILFAST'))"


def strips(edges: Sequence[Edge]) -> tuple[float, float, list[list[int]]]:
    """Lowest scaled y, strip height, and per strip the numbers of the edges that reach into it.

    Where long edges would be listed over and over, strips get wider instead: the listing
    stays within a small multiple of the number of edges.
    """
    count = min(MAX_STRIPS, 2 * len(edges))
    while True:
        lowest, height, table = _listed(edges, count)
        if count == 1 or sum(map(len, table)) <= MAX_LISTED * len(edges):
            return lowest, height, table
        count = (count + 1) // 2


def slots(edges: Sequence[Edge]) -> tuple[float, float, int, list[int]] | None:
    """Strips of at most ``SLOTS`` edges: lowest scaled y, height, count, and edge numbers strip by strip.

    Free slots have the number after the last edge. None if no number of strips up to ``MAX_STRIPS`` will do.
    """
    count = len(edges)
    while count <= MAX_STRIPS:
        lowest, height, table = _listed(edges, count)
        width = max(map(len, table))
        if width <= SLOTS:
            numbers = [n for strip in table for n in [*strip, *[len(edges)] * (width - len(strip))]]
            return lowest, height, count, numbers
        count *= 2
    return None


def _listed(edges: Sequence[Edge], count: int) -> tuple[float, float, list[list[int]]]:
    factor = scale([e[1] for e in edges])
    lowest = min(e[1] * factor for e in edges)
    height = (max(e[1] * factor for e in edges) - lowest) / count
    table: list[list[int]] = [[] for _ in range(count + 1)]
    for number, edge in enumerate(edges):
        first, last = (
            min(count, math.floor((end * factor - lowest) / height))
            for end in (min(edge[1], edge[3]), max(edge[1], edge[3]))
        )
        for strip in table[first : last + 1]:
            strip.append(number)
    return lowest, height, table


def _turn(x: str, y: str, x1: str, y1: str, x2: str, y2: str, scale_x: float, scale_y: float) -> tuple[str, str]:
    """Twice the scaled area of point and edge, positive where the point is left of it, and its error bound."""
    x, x1, x2 = (_times(c, scale_x) for c in (x, x1, x2))
    y, y1, y2 = (_times(c, scale_y) for c in (y, y1, y2))
    one, other = f"(({x1} - {x}) * ({y2} - {y}))", f"(({y1} - {y}) * ({x2} - {x}))"
    return f"({one} - {other})", f"((abs{one} + abs{other}) * {double(ROUNDING)} + {double(LEAST_TURN)})"


def _whole(value: str) -> str:
    """A finite double as (high * 2**28 + low) / 2**down, in whole numbers."""
    down = f"(CASE WHEN {value} = 0D THEN 0 ELSE 53 - CAST(floor(log2(abs({value}))) AS INT) END)"
    half = f"CAST(floor({down} / 2) AS INT)"
    number = f"CAST({value} * pow(2D, {half}) * pow(2D, {down} - {half}) AS BIGINT)"
    high = f"shiftright({number}, 28)"
    return f"named_struct('high', {high}, 'low', {number} - shiftleft({high}, 28), 'down', {down})"


def exact_sign(x: str, y: str, x1: str, y1: str, x2: str, y2: str) -> str:
    """-1, 0 or 1: on which side of the edge a point lies, without rounding, for all finite doubles.

    The area is a sum of six products of two coordinates. Each is made of whole numbers of up to 57
    bits times powers of two; from the largest power down they are added up in decimals. A sum beyond 2**62
    cannot be turned by all that follows, so it is held there, and so are shifts.
    """
    # x, y, x1, y1, x2, y2 by number, and the sign of the product
    pairs = ((1, 2, 5), (-1, 2, 1), (-1, 0, 5), (-1, 3, 4), (1, 3, 0), (1, 1, 4))
    products = f"array({', '.join(f'struct({sign} AS sign, {a} AS a, {b} AS b)' for sign, a, b in pairs)})"
    left, right = "get(p, q.a)", "get(p, q.b)"
    middle = f"{left}.high * {right}.low + {left}.low * {right}.high"
    parts = ((56, f"{left}.high * {right}.high"), (28, middle), (0, f"{left}.low * {right}.low"))
    terms = ", ".join(
        f"struct({shift} - {left}.down - {right}.down AS power, ({value}) * q.sign AS value)" for shift, value in parts
    )
    wholes = f"transform(array({x}, {y}, {x1}, {y1}, {x2}, {y2}), v -> {_whole('v')})"
    found = f"get(transform(array({wholes}), p -> transform({products}, q -> array({terms}))), 0)"
    limit = f"CAST({1 << 62} AS DECIMAL(38,0))"
    held = f"CAST(greatest(-{limit}, least({limit}, total.sum)) AS DECIMAL(20,0))"
    moved = f"{held} * CAST(shiftleft(1L, least(62, total.power - t.power)) AS DECIMAL(19,0))"
    added = f"struct(CAST({moved} + t.value AS DECIMAL(38,0)) AS sum, t.power AS power)"
    start = "struct(CAST(0 AS DECIMAL(38,0)) AS sum, 100000 AS power)"
    return f"aggregate(sort_array(flatten({found}), false), {start}, (total, t) -> {added}, total -> CAST(signum(total.sum) AS INT))"
