import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallygrid import Cut, apply_cuts, tag_cuts
from tallygrid.functions.polygon import (
    GRID as CELLS,
    INSIDE,
    MAX_LISTED,
    NEAR_EDGE,
    UNDECIDED,
    cells,
    exact_sign,
    inside_polygon,
    ring_edges,
    scale,
    settled,
    slots,
    strips,
)

SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]


def exact_inside(x, y, vertices):
    """Winding number in exact arithmetic; points on an edge are outside."""
    if len(set(vertices)) < 3:
        return False
    px, py = Fraction(x), Fraction(y)
    winding = 0
    ring = [(Fraction(a), Fraction(b)) for a, b in vertices]
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        turn = (x2 - x1) * (py - y1) - (px - x1) * (y2 - y1)
        if turn == 0 and min(x1, x2) <= px <= max(x1, x2) and min(y1, y2) <= py <= max(y1, y2):
            return False
        if y1 <= py < y2 and turn > 0:
            winding += 1
        elif y2 <= py < y1 and turn < 0:
            winding -= 1
    return winding != 0


def subdivided(vertices, times):
    """The same outline with more corners on it, exactly on the edges."""
    out = []
    for (x1, y1), (x2, y2) in zip(vertices, vertices[1:] + vertices[:1]):
        out += [(x1 + (x2 - x1) * k / times, y1 + (y2 - y1) * k / times) for k in range(times)]
    return out


def check(spark, vertices, points):
    df = spark.createDataFrame(points, "x double, y double")
    inside, code = (F.expr(test("x", "y", vertices)) for test in (inside_polygon, settled))
    got = df.select("x", "y", inside.alias("i"), code.alias("code"))
    for x, y, i, code in got.collect():
        assert code in (UNDECIDED, INSIDE if i else 0) or (code is None and (x is None or y is None)), (x, y)
        if x is None or y is None:
            assert not i
        elif math.isnan(x) or math.isnan(y):
            assert i is False
        else:
            assert i is exact_inside(x, y, vertices), (x, y)


GRID = [(a / 2, b / 2) for a in range(-2, 11) for b in range(-2, 11)]
ODD = [(math.nan, 2.0), (2.0, math.nan), (None, 2.0), (2.0, None), (math.inf, 2.0)]


@pytest.mark.parametrize("times", [1, 16])
def test_square(spark, times):
    vertices = subdivided(SQUARE, times)
    check(spark, vertices, GRID + ODD[:4])
    check(spark, list(reversed(vertices)), GRID)
    check(spark, [*vertices, vertices[0]], GRID)


@pytest.mark.parametrize("times", [1, 8])
def test_concave_and_repeated_corners(spark, times):
    arrow = [(0.0, 0.0), (4.0, 0.0), (2.0, 1.0), (4.0, 4.0), (4.0, 4.0), (0.0, 2.0)]
    check(spark, subdivided(arrow, times), GRID + ODD[:4])


@pytest.mark.parametrize("times", [1, 8])
def test_star_includes_its_center(spark, times):
    corners = [(math.sin(4 * math.pi * k / 5), math.cos(4 * math.pi * k / 5)) for k in range(5)]
    vertices = subdivided(corners, times)
    rng = random.Random(1)
    points = [(rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(300)] + [(0.0, 0.0)]
    check(spark, vertices, points)


def test_figure_of_eight(spark):
    check(spark, [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0)], GRID)


@pytest.mark.parametrize(
    "flat",
    [[], [(1.0, 1.0)], [(0.0, 0.0), (4.0, 4.0)], [(0.0, 1.0), (2.0, 1.0), (4.0, 1.0)],
     [(1.0, 0.0), (1.0, 2.0), (1.0, 4.0)], [(1.0, 1.0)] * 5],
)
def test_nothing_is_inside_without_area(spark, flat):
    check(spark, flat, GRID)


@pytest.mark.parametrize("corners", [3, 7, 12, 13, 60, 400])
def test_random_polygons(spark, corners):
    rng = random.Random(corners)
    vertices = [(rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(corners)]
    points = [(rng.uniform(-6, 6), rng.uniform(-6, 6)) for _ in range(600)]
    check(spark, vertices, points + vertices[:20])


def test_every_strip_lists_the_edges_that_reach_it():
    rng = random.Random(9)
    vertices = [(rng.uniform(-5, 5), rng.uniform(-1e-3, 1e7)) for _ in range(300)]
    edges = ring_edges(vertices)
    lowest, height, table = strips(edges)
    factor = scale([e[1] for e in edges])
    assert sum(map(len, table)) <= MAX_LISTED * len(edges)
    for _ in range(3000):
        y = rng.uniform(min(v[1] for v in vertices), max(v[1] for v in vertices))
        listed = {edges[i] for i in table[math.floor((y * factor - lowest) / height)]}
        assert {e for e in edges if min(e[1], e[3]) <= y <= max(e[1], e[3])} <= listed


@pytest.mark.parametrize("corners", [5, 40, 300])
def test_settled_cells_hold_no_edge_and_one_answer(corners):
    rng = random.Random(corners)
    vertices = [(rng.uniform(-5, 5), rng.uniform(0, 3e4)) for _ in range(corners)]
    (low_x, low_y, width, height), kinds = cells(ring_edges(vertices))
    scales = [scale([v[at] for v in vertices]) for at in (0, 1)]
    seen = set()
    for _ in range(400):
        x, y = (rng.uniform(min(v[at] for v in vertices), max(v[at] for v in vertices)) for at in (0, 1))
        column, row = math.floor((x * scales[0] - low_x) / width), math.floor((y * scales[1] - low_y) / height)
        kind = kinds[column * (CELLS + 1) + row]
        seen.add(kind)
        if kind != NEAR_EDGE:
            assert (kind == INSIDE) == exact_inside(x, y, vertices)
    assert NEAR_EDGE in seen


def beside(vertices, rng, count):
    """Points on and within 1e-12 of the edges, and next to the corners."""
    found = []
    for (x1, y1), (x2, y2) in zip(vertices, vertices[1:] + vertices[:1]):
        for _ in range(count):
            t, off = rng.random(), rng.choice([0.0, 1e-12, 1e-15, 1e-17])
            x, y = x1 + t * (x2 - x1), y1 + t * (y2 - y1)
            found.append((x + rng.uniform(-off, off), y + rng.uniform(-off, off)))
            found.append((math.nextafter(x, rng.choice([-9.0, 9.0])), y))
        found.append((math.nextafter(x1, 9.0), math.nextafter(y1, -9.0)))
    return found


@pytest.mark.parametrize("corners", [3, 4, 12, 60])
def test_points_beside_edges(spark, corners):
    rng = random.Random(corners)
    vertices = [(rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(corners)]
    check(spark, vertices, beside(vertices, rng, 40) + vertices)
    check(spark, subdivided([(0.1, 0.1), (0.7, 0.3), (0.3, 0.9)], corners), beside([(0.1, 0.1), (0.7, 0.3), (0.3, 0.9)], rng, 60))


HUGE, TINY = 1.7976931348623157e308, 5e-324
EXTREME = [0.0, -0.0, TINY, -TINY, 3 * TINY, 2.2250738585072014e-308, 1e-200, 1e-17, 0.1, 0.3, 1.0, 1.0000000000000002, 3.0, 1e9, 1e200, HUGE, -HUGE, -1e308, -0.7]


def test_corners_at_the_ends_of_the_doubles(spark):
    check(spark, [(-1e308, -1e308), (1e308, -1e308), (1e308, 1e308), (-1e308, 1e308)], [(0.0, 0.0), (1e308, 0.0), (9e307, -9e307), (HUGE, 0.0)])
    check(spark, [(0.0, 0.0), (TINY, 0.0), (0.0, TINY)], [(0.0, 0.0), (TINY, TINY), (1.0, 1.0)])
    check(spark, [(0.0, 0.0), (9 * TINY, 0.0), (0.0, 9 * TINY)], [(a * TINY, b * TINY) for a in range(10) for b in range(10)])
    check(spark, [(-HUGE, -HUGE), (HUGE, HUGE), (-HUGE, HUGE)], [(0.0, TINY), (TINY, 0.0), (0.0, 0.0), (-TINY, TINY), (1.0, 1.0000000000000002)])


def test_all_finite_doubles(spark):
    """Polygons and points made of any doubles, among them those that mix the smallest and the largest."""
    rng = random.Random(77)

    def any_double():
        if rng.random() < 0.5:
            return rng.choice(EXTREME)
        return math.ldexp(rng.choice([-1, 1]) * rng.random(), rng.randint(-1073, 1024))

    for _ in range(25):
        vertices = [(any_double(), any_double()) for _ in range(rng.randint(3, 6))]
        xs, ys = [v[0] for v in vertices], [v[1] for v in vertices]
        points = [(any_double(), any_double()) for _ in range(60)] + [(rng.choice(xs), rng.choice(ys)) for _ in range(20)]
        points += [(rng.choice(xs) / 2 + rng.choice(xs) / 2, rng.choice(ys) / 2 + rng.choice(ys) / 2) for _ in range(60)]
        check(spark, vertices, points + vertices)


def test_exact_sign(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        x1, y1, x2, y2 = (rng.choice(EXTREME) if rng.random() < 0.3 else rng.uniform(-9, 9) for _ in range(4))
        t = rng.random()
        x, y = x1 + t * (x2 / 2 - x1 / 2) * 2, y1 + t * (y2 / 2 - y1 / 2) * 2
        if math.isfinite(x) and math.isfinite(y):
            rows.append((x, y, x1, y1, x2, y2))
    df = spark.createDataFrame(rows, "x double, y double, x1 double, y1 double, x2 double, y2 double")
    for *row, sign in df.select("*", F.expr(exact_sign(*df.columns))).collect():
        x, y, x1, y1, x2, y2 = map(Fraction, row)
        turn = (x1 - x) * (y2 - y) - (y1 - y) * (x2 - x)
        assert sign == (turn > 0) - (turn < 0), row


def test_slots_hold_the_edges_of_their_strip():
    vertices = [(math.cos(k * math.tau / 180), 40 * math.sin(k * math.tau / 180)) for k in range(180)]
    lowest, height, count, numbers = slots(ring_edges(vertices))
    width = len(numbers) // (count + 1)
    factor = scale([v[1] for v in vertices])
    for number, (_, y1, _, y2) in enumerate(ring_edges(vertices)):
        for y in (y1, (y1 + y2) / 2, y2):
            strip = min(count, math.floor((y * factor - lowest) / height))
            assert number in numbers[strip * width : (strip + 1) * width]
    rng = random.Random(3)
    assert slots(ring_edges([(rng.random(), rng.random()) for _ in range(300)])) is None


# -- cuts ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(
        [(i, *p) for i, p in enumerate(GRID + ODD[:4] + [(-1e6, -1e6)])], "id int, x double, y double"
    )


LEFT = Cut("left", ((0.0, 0.0), (2.0, 0.0), (2.0, 4.0), (0.0, 4.0)), "x", "y")
LOW = Cut("low", ((0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)), "x", "y")
DEEP = Cut("deep", ((-2e6, -2e6), (0.0, -2e6), (0.0, 0.0), (-2e6, 0.0)), "x", "y")
OPEN = Cut("open", ((0.0, 0.0), (4.0, 0.0), (4.0, 2.0)), "x", None)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_tags_and_selection_agree(points):
    tagged = tag_cuts(points, [LEFT, LOW, OPEN])
    assert tagged.columns == ["id", "x", "y", "left", "low"]
    rows = tagged.collect()
    assert all(r["left"] in (True, False) for r in rows)
    either = sorted(r["id"] for r in rows if r["left"] or r["low"])
    both = sorted(r["id"] for r in rows if r["left"] and r["low"])
    assert ids(apply_cuts(points, [LEFT, LOW, OPEN])) == either
    assert ids(apply_cuts(points, [LEFT, LOW], combine="and")) == both
    assert apply_cuts(points, [LEFT]).columns == points.columns


def test_sentinel_rows_can_pass(points):
    kept = apply_cuts(points, [DEEP])
    assert (-1e6, -1e6) in [(r["x"], r["y"]) for r in kept.collect()]
    dropped = apply_cuts(points, [DEEP], drop_sentinel=True)
    assert (-1e6, -1e6) not in [(r["x"], r["y"]) for r in dropped.collect()]


def test_cut_errors(points):
    with pytest.raises(ValueError, match="both columns"):
        apply_cuts(points, [OPEN])
    with pytest.raises(ValueError, match="both columns"):
        apply_cuts(points, [])
    with pytest.raises(ValueError, match="nope"):
        apply_cuts(points, [Cut("c", SQUARE, "x", "nope")])
    with pytest.raises(ValueError, match="columns of the table"):
        tag_cuts(points, [Cut("id", SQUARE, "x", "y")])
    with pytest.raises(ValueError, match="combine"):
        apply_cuts(points, [LEFT], combine="xor")
    assert tag_cuts(points, [OPEN]).columns == points.columns
