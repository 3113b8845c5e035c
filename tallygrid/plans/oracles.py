"""Plain SQL for the registered queries, written from the definitions, not from the operators."""

from __future__ import annotations

from tallygrid.functions.colors import VIRIDIS_KEYS
from tallygrid.plans import workloads as w
from tallygrid.plans.detector import BASES, ENERGY_SUMS, TIME_DIFFERENCES, detector_specs
from tallygrid.specs import Axis, Cut, Hist1D, HistSpec

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

MISSING = "CAST('-1e6' AS DOUBLE)"


def num(value: float) -> str:
    """A double literal; a bare decimal would be taken as DECIMAL."""
    return f"CAST('{float(value)!r}' AS DOUBLE)"


def col(name: str) -> str:
    return f'CAST("{name}" AS DOUBLE)'


def view(derived: bool = False) -> str:
    text = w.DETECTOR_VIEW.format(lineitem="lineitem").strip()
    if not derived:
        return f"view0 AS MATERIALIZED ({text})"
    extra = []
    for line in ENERGY_SUMS.strip().splitlines():
        alias, sources = (part.strip() for part in line.split("="))
        right, left = (part.strip() for part in sources.split("+"))
        extra.append(f'{right} + {left} / 2e0 AS "{alias}"')
    for line in TIME_DIFFERENCES.strip().splitlines():
        a, b = (part.strip() for part in line.split("-"))
        extra.append(f'{a} - {b} AS "{a}_{b}"')
    return f"view0 AS MATERIALIZED (SELECT *, {', '.join(extra)} FROM ({text}))"


def where_base(base: str) -> list[str]:
    chosen = BASES[base]
    tests = [f"{col(c)} <> {MISSING}" for c in chosen.valid]
    return tests + [f"{col(c)} = {MISSING}" for c in chosen.missing]


def bin_of(axis: Axis) -> str:
    return f"CAST(floor(({col(axis.column)} - {num(axis.lo)}) / {num(axis.width)}) AS BIGINT)"


def in_range(axis: Axis) -> str:
    c = col(axis.column)
    return f"{c} >= {num(axis.lo)} AND {c} < {num(axis.hi)}"


def counts(spec: HistSpec, source: str) -> str:
    tests = where_base(spec.base) + [in_range(a) for a in spec.axes]
    if isinstance(spec, Hist1D):
        tests.append(f"{bin_of(spec.x)} < {spec.x.bins}")
        y = "CAST(NULL AS BIGINT)"
    else:
        tests += [f"{col(a.column)} <> {MISSING}" for a in spec.axes]
        y = bin_of(spec.y)
    return (
        f"SELECT '{spec.name}' AS hist, {bin_of(spec.x)} AS x_bin, {y} AS y_bin, "
        f"count(*) AS count FROM {source} WHERE {' AND '.join(tests)} GROUP BY 1, 2, 3"
    )


def flat(spec: Hist1D, source: str) -> str:
    return f"SELECT hist, x_bin AS bin, count FROM ({counts(spec, source)})"


def all_counts(specs: list[HistSpec], source: str = "view0") -> str:
    return " UNION ALL ".join(counts(s, source) for s in specs)


def center(axis: Axis, index: str) -> str:
    return f"({num(axis.lo)} + {index} * {num(axis.width)} + {num(axis.width * 0.5)})"


def stats1d(spec: Hist1D, source: str, first: int, last: int, with_view: str = "") -> str:
    c = center(spec.x, "x_bin")
    return f"""WITH {with_view} h AS (
      SELECT count AS n, {c} AS c FROM ({counts(spec, source)})
      WHERE x_bin >= {first} AND x_bin <= {last}),
    m AS (SELECT coalesce(sum(n), 0) AS n, sum(n * c) / sum(n) AS mean FROM h)
    SELECT '{spec.name}' AS hist, CAST(any_value(m.n) AS BIGINT) AS count,
      coalesce(any_value(m.mean), 0e0) AS mean,
      coalesce(sqrt(sum(h.n * (h.c - m.mean) * (h.c - m.mean)) / sum(h.n)), 0e0) AS stdev
    FROM m LEFT JOIN h ON true"""


def windows1d(spec: Hist1D, source: str) -> str:
    lo, hi, last = num(spec.x.lo), num(spec.x.hi), spec.x.bins - 1

    def bin_at(bound: str, otherwise: int) -> str:
        place = f"CAST(floor(({bound} - {lo}) / {num(spec.x.width)}) AS BIGINT)"
        return f"CASE WHEN {bound} < {lo} OR {bound} > {hi} THEN {otherwise} ELSE least({place}, {spec.x.bins}) END"

    return f"""WITH h AS (SELECT x_bin, count AS n, {center(spec.x, "x_bin")} AS c FROM ({counts(spec, source)})),
    w AS (SELECT c_custkey AS window_id, {bin_at("(c_acctbal / 10e0)", 0)} AS first,
      {bin_at("(c_acctbal / 10e0 + 60e0)", last)} AS last FROM customer),
    m AS (SELECT window_id, first, last, coalesce(sum(n), 0) AS n, sum(n * c) / sum(n) AS mean
      FROM w LEFT JOIN h ON x_bin BETWEEN first AND last GROUP BY ALL)
    SELECT window_id, '{spec.name}' AS hist, CAST(any_value(m.n) AS BIGINT) AS count,
      round(coalesce(any_value(mean), 0e0), 6) AS mean,
      round(coalesce(sqrt(sum(h.n * (c - mean) * (c - mean)) / sum(h.n)), 0e0), 6) AS stdev
    FROM m LEFT JOIN h ON x_bin BETWEEN first AND last GROUP BY window_id"""


def stats2d(spec, source: str, x: tuple[int, int], y: tuple[int, int]) -> str:
    cx, cy = center(spec.x, "x_bin"), center(spec.y, "y_bin")
    return f"""WITH h AS (
      SELECT count AS n, {cx} AS x, {cy} AS y FROM ({counts(spec, source)})
      WHERE x_bin BETWEEN {x[0]} AND {x[1]} AND y_bin BETWEEN {y[0]} AND {y[1]}),
    m AS (SELECT sum(n) AS n, sum(n * x) / sum(n) AS mx, sum(n * y) / sum(n) AS my FROM h)
    SELECT '{spec.name}' AS hist, CAST(any_value(m.n) AS BIGINT) AS count,
      any_value(mx) AS mean_x, sqrt(sum(h.n * (x - mx) * (x - mx)) / sum(h.n)) AS stdev_x,
      any_value(my) AS mean_y, sqrt(sum(h.n * (y - my) * (y - my)) / sum(h.n)) AS stdev_y
    FROM m, h"""


def rounded(sql: str, *columns: str) -> str:
    each = ", ".join(f"round({c}, 6) AS {c}" for c in columns)
    return f"SELECT hist, count, {each} FROM ({sql})"


def legend(sql: str, *entries: tuple[str, str]) -> str:
    lines = ["SELECT hist, 0 AS line_no, 'Integral: ' || count AS line FROM s"]
    lines += [
        f"SELECT hist, {i} AS line_no, '{label}: ' || printf('%.2f', {c}) AS line FROM s"
        for i, (label, c) in enumerate(entries, start=1)
    ]
    return f"WITH s AS ({sql}) " + " UNION ALL ".join(lines)


def inside(cut: Cut) -> str:
    """Winding number over every edge, then the edges themselves taken out."""
    x, y = col(cut.x_column), col(cut.y_column)
    ring = [*cut.vertices, cut.vertices[0]]
    winding, on_edge = [], []
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        a, b, c, d = num(x1), num(y1), num(x2), num(y2)
        turn = f"(({a} - {x}) * ({d} - {y}) - ({b} - {y}) * ({c} - {x}))"
        winding.append(
            f"CASE WHEN {b} <= {y} AND {y} < {d} AND {turn} > 0 THEN 1 "
            f"WHEN {d} <= {y} AND {y} < {b} AND {turn} < 0 THEN -1 ELSE 0 END"
        )
        on_edge.append(
            f"({turn} = 0 AND {x} BETWEEN least({a}, {c}) AND greatest({a}, {c}) "
            f"AND {y} BETWEEN least({b}, {d}) AND greatest({b}, {d}))"
        )
    return f"(({' + '.join(winding)}) <> 0 AND NOT ({' OR '.join(on_edge)}))"


def cut_rows(condition: str, extra: str = "") -> str:
    return (
        f"SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice{extra} "
        f"FROM lineitem WHERE {condition}"
    )


def preset(base: str) -> str:
    return (
        f"WITH {view()} SELECT l_orderkey, l_linenumber, X1, X2, AnodeBackTime "
        f"FROM view0 WHERE {' AND '.join(where_base(base))}"
    )


def cells_sql() -> str:
    s = w.QTY_PRICE
    xw, yw = num(s.x.width), num(s.y.width)
    x0, y0 = f"({num(s.x.lo)} + x_bin * {xw})", f"({num(s.y.lo)} + y_bin * {yw})"
    return (
        f"SELECT hist, x_bin, y_bin, ({x0} + ({x0} + {xw})) / 2e0 AS x, "
        f"({y0} + ({y0} + {yw})) / 2e0 AS y, {xw} AS bar_width, {yw} AS height, count "
        f"FROM ({counts(s, 'lineitem')})"
    )


def colors_sql() -> str:
    def keys(channel: int) -> str:
        return "[" + ", ".join(f"CAST('{k[channel]!r}' AS FLOAT)" for k in VIRIDIS_KEYS) + "]"

    def level(name: str) -> str:
        low, high = f"{name}[k + 1]", f"{name}[least(k + 1, 31) + 1]"
        return (
            f"CAST(floor(CAST(({low} + f * ({high} - {low})) * CAST(255 AS FLOAT) AS DOUBLE)) "
            "AS INTEGER)"
        )

    def text(c: str) -> str:
        return f"regexp_replace(CAST({c} AS VARCHAR), '\\.0$', '')"

    return f"""WITH cells AS ({cells_sql()}),
    top AS (SELECT CAST(max(count) AS DOUBLE) AS high FROM cells),
    scaled AS (SELECT cells.*, CASE WHEN high > 1 THEN (count - 1e0) / (high - 1e0) ELSE 0e0 END
      * 31e0 AS p FROM cells, top),
    placed AS (SELECT *, CAST(floor(p) AS INTEGER) AS k, CAST(p - floor(p) AS FLOAT) AS f,
      {keys(0)} AS r, {keys(1)} AS g, {keys(2)} AS b FROM scaled)
    SELECT hist, x_bin, y_bin, x, y, bar_width, height, count, y - height / 2e0 AS base_offset,
      'x = ' || {text("x")} || chr(10) || 'y = ' || {text("y")} || chr(10) || count AS label,
      {level("r")} AS red, {level("g")} AS green, {level("b")} AS blue FROM placed"""


def step_sql() -> str:
    s = w.QUANTITY
    start = f"({num(s.x.lo)} + bin * {num(s.x.width)})"
    return f"""WITH h AS ({counts(s, "lineitem")}),
    bins AS (SELECT CAST(range AS BIGINT) AS bin FROM range({s.x.bins})),
    dense AS (SELECT '{s.name}' AS hist, bin, {start} AS low,
      CAST(coalesce(h.count, 0) AS DOUBLE) AS count FROM bins LEFT JOIN h ON h.x_bin = bins.bin)
    SELECT hist, bin, 0 AS side, low AS x, count FROM dense
    UNION ALL SELECT hist, bin, 1 AS side, low + {num(s.x.width)} AS x, count FROM dense"""


def totals_sql(specs: list[HistSpec]) -> str:
    names = ", ".join(f"('{s.name}', '{s.kind}')" for s in specs)
    return f"""SELECT n.hist, n.kind, CAST(coalesce(sum(c.count), 0) AS BIGINT) AS entries,
      count(c.count) AS filled_bins FROM (VALUES {names}) n(hist, kind)
      LEFT JOIN ({all_counts(specs)}) c ON c.hist = n.hist GROUP BY 1, 2"""


def overlay_sql() -> str:
    picked = list(dict.fromkeys(w.OVERLAY_PICKS))
    specs = [s for s in detector_specs() if s.name in picked]
    tints = ["LIGHT_BLUE", "LIGHT_RED", "LIGHT_GREEN", "LIGHT_YELLOW", "LIGHT_GRAY"]
    rows = ", ".join(
        f"('{name}', {i}, {i % 5}, '{tints[i % 5]}')" for i, name in enumerate(picked)
    )
    return f"""WITH {view()} SELECT c.hist, p.position, p.color_index, p.color, x_bin AS bin, count
      FROM ({all_counts(specs)}) c JOIN (VALUES {rows}) p(hist, position, color_index, color)
      ON p.hist = c.hist"""


def kept_as(cut: str) -> str:
    return f", '{cut}' AS cut"


def _oracles() -> dict[str, str]:
    kind = "CASE WHEN l_quantity > 40 THEN 'high' WHEN l_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END"
    specs = detector_specs()
    picked = [s for s in specs if s.name in w.OVERLAY_PICKS]
    one_d = [s for s in specs if s.kind == "1d"]
    events = w.EVENT_VALUE
    one = stats1d(events, "events", 10, 40)
    whole = stats1d(events, "events", 0, events.x.bins - 1)
    two = stats2d(w.QTY_PRICE, "lineitem", (10, 40), (12, 48))
    tags = [w.TRIANGLE, w.SQUARE, w.STAR, w.WAVY]
    tag_list = ", ".join(f"CAST({inside(c)} AS INTEGER) AS {c.cut_id}" for c in tags)
    either = f"({inside(w.TRIANGLE)} OR {inside(w.SQUARE)})"
    sums = "DelayFrontAverageEnergy, DelayBackAverageEnergy"
    differences = ", ".join(
        '"' + "_".join(part.strip() for part in line.split("-")) + '"'
        for line in TIME_DIFFERENCES.strip().splitlines()
    )
    flat_stats = " UNION ALL ".join(
        f"SELECT * FROM ({stats1d(s, 'view0', 0, s.x.bins - 1)})" for s in one_d
    )
    return {
        "hist1d_quantity": flat(w.QUANTITY, "lineitem"),
        "hist1d_event_value": flat(events, "events"),
        "hist1d_int_column": flat(w.PART_SIZE, "part"),
        "hist1d_sentinel_out_of_range": f"WITH {view()} {flat(w.POSITION, 'view0')}",
        "hist2d_qty_price": counts(w.QTY_PRICE, "lineitem"),
        "hist2d_whole_numbers": counts(w.KEY_PRICE, "orders"),
        "hist2d_sentinel": f"WITH {view()} {counts(w.BOTH_POSITIONS, 'view0')}",
        "hist2d_minmax": (
            f"WITH {view()} SELECT hist, CAST(1 AS BIGINT) AS min_count, max(count) AS max_count, "
            f"min(count) AS true_min FROM ({counts(w.BOTH_POSITIONS, 'view0')}) GROUP BY hist"
        ),
        "preset_both_planes": preset("both planes"),
        "preset_only_x1": preset("only X1"),
        "preset_only_x2": preset("only X2"),
        "preset_time_valid": preset("time valid"),
        "select_as_double": (
            "SELECT CAST(l_linenumber AS DOUBLE) AS l_linenumber, l_quantity FROM lineitem"
        ),
        "derive_average": (
            f"WITH {view(True)} SELECT l_orderkey, l_linenumber, {sums} FROM view0"
        ),
        "derive_time_diff": (
            f"WITH {view(True)} SELECT l_orderkey, l_linenumber, {differences} FROM view0"
        ),
        "stats1d": rounded(one, "mean", "stdev"),
        "stats1d_windows": windows1d(events, "events"),
        "stats1d_outside": rounded(whole, "mean", "stdev"),
        "stats1d_strict": (
            f"SELECT '{events.name}' AS hist, count(*) AS count, 0e0 AS mean, 0e0 AS stdev "
            "FROM events WHERE value >= 900 AND value <= 950 AND value < 500"
        ),
        "stats2d": rounded(two, "mean_x", "stdev_x", "mean_y", "stdev_y"),
        "catalogue_all": (
            f"WITH {view(True)} SELECT hist, x_bin, coalesce(y_bin, -1) AS y_bin, count "
            f"FROM ({all_counts(specs)})"
        ),
        "catalogue_stats1d": f"WITH {view(True)} " + rounded(flat_stats, "mean", "stdev"),
        "catalogue_minmax": (
            f"WITH {view(True)} SELECT hist, CAST(1 AS BIGINT) AS min_count, "
            "max(count) AS max_count, min(count) AS true_min "
            f"FROM ({all_counts([s for s in specs if s.kind == '2d'])}) GROUP BY hist"
        ),
        "cut_tag": f"SELECT l_orderkey, l_linenumber, {tag_list} FROM lineitem",
        "cut_apply": cut_rows(inside(w.TRIANGLE)),
        "cut_apply_or": cut_rows(f"{inside(w.SQUARE)} OR {inside(w.STAR)}"),
        "cut_apply_and": cut_rows(f"{inside(w.STAR)} AND {inside(w.TRIANGLE)}"),
        "cut_apply_large": cut_rows(inside(w.WAVY)),
        "cut_whole_numbers": f"SELECT o_orderkey, o_totalprice FROM orders WHERE {inside(w.KEYS)}",
        "cut_sentinel": (
            f"WITH {view()} SELECT l_orderkey, l_linenumber, X1, X2 FROM view0 "
            "WHERE X1 > -2e6 AND X1 < 0 AND X2 > -2e6 AND X2 < 0"
        ),
        "cut_roundtrip": (
            f"SELECT CAST({inside(w.TRIANGLE)} AS INTEGER) AS in_triangle, "
            f"CAST({inside(w.STAR)} AS INTEGER) AS in_star, count(*) AS n "
            "FROM lineitem GROUP BY 1, 2"
        ),
        "step_points": step_sql(),
        "heatmap_cells": cells_sql(),
        "heatmap_colors": colors_sql(),
        "legend1d": legend(one, ("Mean", "mean"), ("Stdev", "stdev")),
        "legend2d": legend(
            two,
            ("Mean X", "mean_x"),
            ("Stdev X", "stdev_x"),
            ("Mean Y", "mean_y"),
            ("Stdev Y", "stdev_y"),
        ),
        "hist_names": (
            f"WITH {view(True)} SELECT hist, entries, filled_bins FROM ({totals_sql(specs)}) "
            "ORDER BY hist"
        ),
        "hist_kind": f"WITH {view()} SELECT * FROM ({totals_sql(picked)}) WHERE hist = 'X2'",
        "overlay": overlay_sql(),
        "file_catalogue": " UNION ALL ".join(
            f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t in TABLES
        ),
        "file_select": (
            "SELECT 'lineitem.parquet' AS source_file, count(*) AS n_rows, "
            "sum(l_quantity) AS sum_qty FROM lineitem"
        ),
        "save_single": cut_rows(either),
        "save_separate": cut_rows(either, ", 'lineitem_filtered' AS out_name"),
        "save_manifest": (
            "SELECT 'lineitem.parquet' AS source_file, 'lineitem_star' AS out_name, "
            f"count(*) AS rows FROM lineitem WHERE {inside(w.STAR)}"
        ),
        "scan_many": (
            f"SELECT {kind} AS name, count(*) AS n_rows, sum(l_quantity) AS sum_qty FROM lineitem GROUP BY 1"
        ),
        "save_many": (
            f"{cut_rows(inside(w.SQUARE), kept_as("square"))} UNION ALL "
            f"{cut_rows(inside(w.TRIANGLE), kept_as("triangle"))}"
        ),
        "manifest_many": (
            "SELECT rows, count(*) AS files FROM (SELECT kind, sum(hit)::BIGINT AS rows FROM "
            f"(SELECT {kind} AS kind, CASE WHEN {inside(w.TRIANGLE)} THEN 1 ELSE 0 END AS hit FROM lineitem) "
            "GROUP BY kind) GROUP BY rows"
        ),
        "catalogue_below": (
            f"SELECT count(*) AS n_rows, 0::BIGINT AS listed_above FROM lineitem WHERE {kind} = 'odd'"
        ),
    }


ORACLES = _oracles()
