"""The same answers in plain SQL, written from the definitions: nested loops over whole
windows, no grid where the query does not ask for one."""

from __future__ import annotations


from farpoint.functions import hashing
from farpoint.params import GridParams, LshParams, WindowSpec, preset
from farpoint.streaming.state import tick_us
from workloads import inputs as inp
from workloads.queries import ONE_TABLE, PROBED, PROBED_TABLES, THREE_TABLES

EVENT_XS = [
    "value",
    "CAST(props->>'$.k' AS DOUBLE)",
    "CAST(hour(ts) AS DOUBLE) + CAST(minute(ts) AS DOUBLE) / CAST(60 AS DOUBLE)",
]


def _events(dims: int) -> str:
    xs = ", ".join(f"{x} AS x{i}" for i, x in enumerate(EVENT_XS[:dims]))
    return f"p AS (SELECT event_id AS id, epoch_us(ts) AS us, {xs} FROM events)"


def _scaled_events() -> str:
    xs = ", ".join(f"({x}) / CAST({by!r} AS DOUBLE) AS x{i}" for i, (x, by) in enumerate(zip(EVENT_XS, (30.0, 30.0, 6.0))))
    return f"p AS (SELECT event_id AS id, epoch_us(ts) AS us, {xs} FROM events)"


def _shipped() -> str:
    order = (
        "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, "
        "l_tax, l_returnflag, l_linestatus, l_shipdate"
    )
    return (
        f"p AS (SELECT row_number() OVER (ORDER BY {order}) - 1 AS id, epoch_us(l_shipdate) AS us, "
        "l_quantity AS x0, l_extendedprice / 1000 AS x1, l_discount * 100 AS x2, "
        "l_tax * 100 AS x3, CAST(l_linenumber AS DOUBLE) AS x4, CAST(l_orderkey % 50 AS DOUBLE) AS x5, "
        "CAST(l_partkey % 50 AS DOUBLE) AS x6, CAST(l_suppkey % 50 AS DOUBLE) AS x7, "
        "dayofyear(l_shipdate) / 10.0::DOUBLE AS x8, l_quantity * l_discount AS x9 FROM lineitem)"
    )


def _windowed(spec: WindowSpec) -> str:
    w, s = spec.size_us, spec.slide_us
    return f"w AS (SELECT p.*, unnest(generate_series((us - {w}) // {s} + 1, us // {s})) AS win FROM p)"


def _start(spec: WindowSpec, win: str = "win") -> str:
    return f"CAST({win} * {spec.slide_us // 1000} AS BIGINT) AS window_start_ms"


def _end(spec: WindowSpec, win: str = "win") -> str:
    return f"CAST({win} * {spec.slide_us // 1000} + {spec.size_us // 1000} AS BIGINT) AS window_end_ms"


def _near(params: GridParams, a: str = "a", b: str = "b") -> str:
    squares = " + ".join(f"({a}.x{i} - {b}.x{i}) * ({a}.x{i} - {b}.x{i})" for i in range(params.dims))
    return f"sqrt({squares})"


def _cells(params: GridParams) -> str:
    return ", ".join(f"CAST(floor(x{i} / {params.side!r} + 1e-8) AS BIGINT) AS c{i}" for i in range(params.dims))


def _cs(params: GridParams, of: str = "") -> str:
    return ", ".join(f"{of}c{i}" for i in range(params.dims))


def _cell(params: GridParams, of: str = "", out: str = "cell") -> str:
    return "concat_ws(':', " + ", ".join(f"{of}c{i}" for i in range(params.dims)) + f") AS {out}"


def _s2(params: GridParams) -> str:
    return " + ".join(f"(a.c{i} - b.c{i}) * (a.c{i} - b.c{i})" for i in range(params.dims))


def _celled(params: GridParams, spec: WindowSpec, points: str | None = None) -> str:
    """Points per window with their cell (``g``) and cell counts (``c``)."""
    cs = _cs(params)
    return (
        f"{points or _events(params.dims)}, {_windowed(spec)}, g AS (SELECT w.*, {_cells(params)} FROM w), "
        f"c AS (SELECT win, {cs}, count(*) AS n FROM g GROUP BY win, {cs})"
    )


def _outliers(points: str, params: GridParams, spec: WindowSpec) -> str:
    return (
        f"{points}, {_windowed(spec)}, o AS (SELECT a.win, a.id, any_value(a.us) AS us FROM w a JOIN w b ON a.win = b.win "
        f"AND {_near(params)} <= {params.radius!r} GROUP BY a.win, a.id HAVING count(*) - 1 < {params.min_pts})"
    )


def _exact(points: str, params: GridParams, spec: WindowSpec, where: str = "TRUE") -> str:
    return (
        f"WITH {_outliers(points, params, spec)} SELECT {_start(spec)}, {_end(spec)}, id AS point_id "
        f"FROM o WHERE {where}"
    )


def _mode(kind: str, spec: WindowSpec = inp.EVENT_WINDOW) -> str:
    w, s = spec.size_us, spec.slide_us
    newest = f"us + {s} >= win * {s} + {w}"
    expiring = f"us < win * {s} + {s}"
    middle = f"us >= win * {s} + {w // 2} AND us < win * {s} + {w // 2} + {s}"
    where = {"newest": newest, "expiring": expiring, "middle": f"({middle}) OR ({expiring})"}[kind]
    return _exact(_events(3), inp.EVENTS_3D, spec, where)


def _embedded() -> str:
    p = inp.EMBEDDED
    return (
        "WITH p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) "
        "SELECT a.id AS point_id FROM p a JOIN p b ON "
        f"list_distance(a.e, b.e) <= {p.radius!r} GROUP BY a.id HAVING count(*) - 1 < {p.min_pts}"
    )


# ---- cells ----------------------------------------------------------------------------


def _running() -> str:
    p, spec = inp.EVENTS_1D, inp.EVENT_WINDOW
    return (
        f"{_events(1)}, g AS (SELECT p.*, {_cells(p)} FROM p), r AS (SELECT id, us, c0, count(*) OVER "
        f"(PARTITION BY c0 ORDER BY us RANGE BETWEEN {spec.size_us} PRECEDING AND CURRENT ROW) AS cell_count FROM g)"
    )


def _updates() -> str:
    p, spec = inp.EVENTS_1D, inp.EVENT_WINDOW
    return (
        f"WITH {_events(1)}, g AS (SELECT p.*, {_cells(p)} FROM p), m AS (SELECT c0, us AS moment, 1 AS delta FROM g "
        f"UNION ALL SELECT c0, us + {spec.size_us + 1}, -1 FROM g), d AS (SELECT c0, moment, sum(delta) AS delta FROM m "
        "GROUP BY c0, moment), t AS (SELECT c0, moment, delta, sum(delta) OVER (PARTITION BY c0 ORDER BY moment) AS total FROM d) "
        f"SELECT {_cell(p)}, moment AS at_us, CAST(total AS BIGINT) AS cell_count FROM t WHERE delta <> 0"
    )


def _tick_end(us: str) -> str:
    """End of the tick of a trailing count that holds an instant."""
    tick = tick_us(inp.EVENT_WINDOW.size)
    return f"({us} + {tick - 1}) // {tick} * {tick}"


def _latest() -> str:
    p, spec = inp.EVENTS_1D, inp.EVENT_WINDOW
    w, s = spec.size_us, spec.slide_us
    return (
        f"WITH {_running()}, v AS (SELECT r.*, unnest(generate_series((us - {w}) // {s} + 1, us // {s})) AS win FROM r) "
        f"SELECT {_start(spec)}, {_cell(p)}, max_by(cell_count, us) AS cell_count, max(us) AS version_us "
        "FROM v GROUP BY win, c0"
    )


def _slab_order(params: GridParams) -> str:
    return f"(PARTITION BY win, c{params.sort_dim} ORDER BY n DESC, {_cs(params)})"


def _reach_sums(params: GridParams, spec: WindowSpec, source: str = "c", extra: str = "") -> str:
    d = params.dims
    return (
        f"n AS (SELECT a.win, {_cs(params, 'a.')}, any_value(a.n) AS n, "
        f"CAST(coalesce(sum(b.n) FILTER (WHERE {_s2(params)} <= {d}), 0) AS BIGINT) AS level1_count, "
        f"CAST(coalesce(sum(b.n), 0) AS BIGINT) AS level2_count FROM c a LEFT JOIN {source} b ON a.win = b.win "
        f"AND {_s2(params)} <= {9 * d}{extra} GROUP BY a.win, {_cs(params, 'a.')})"
    )


def _on_cells(a: str, b: str, params: GridParams) -> str:
    return " AND ".join([f"{a}.win = {b}.win"] + [f"{a}.c{i} = {b}.c{i}" for i in range(params.dims)])


# ---- hashing --------------------------------------------------------------------------


def _hash(direction: list[float], shift: float, width: float) -> str:
    dot = " + ".join(f"x{i} * CAST({a!r} AS DOUBLE)" for i, a in enumerate(direction))
    return f"CAST(floor(({dot} + CAST({shift!r} AS DOUBLE)) / CAST({width!r} AS DOUBLE)) AS BIGINT)"


def _hashed(params: GridParams, lsh: LshParams) -> str:
    """Points per window with their cell and all hashes of each table."""
    width = lsh.width_for(params.radius)
    tables = hashing.projections(lsh, params.dims, params.radius)
    lists = ", ".join(
        "[" + ", ".join(_hash(a, b, width) for a, b in t) + f"] AS h{i}" for i, t in enumerate(tables)
    )
    spec = inp.EVENT_WINDOW
    w, s = spec.size_us, spec.slide_us
    cs = _cs(params)
    return (
        f"{_events(params.dims)}, q AS (SELECT p.*, {_cells(params)}, {lists} FROM p), g AS (SELECT q.*, "
        f"unnest(generate_series((us - {w}) // {s} + 1, us // {s})) AS win FROM q), "
        f"c AS (SELECT win, {cs}, count(*) AS n FROM g GROUP BY win, {cs}), {_reach_sums(params, spec)}"
    )


def _k(n: str) -> str:
    return f"greatest(1, CAST(floor(ln({n}) + 0.5) AS INTEGER))"


def _collide(lsh: LshParams, k: str) -> str:
    return " OR ".join(f"a.h{t}[1:{k}] = b.h{t}[1:{k}]" for t in range(lsh.num_tables))


def _few(params: GridParams, lsh: LshParams, verify: bool, indexed: str) -> str:
    """Open points ``s`` (with their k) that meet too few of the indexed points."""
    within = f" AND {_near(params)} <= {params.radius!r}" if verify else ""
    return (
        f"f AS (SELECT a.win, a.id FROM s a JOIN g b ON a.win = b.win AND ({_collide(lsh, 'a.k')}){indexed}{within} "
        f"GROUP BY a.win, a.id HAVING count(*) - 1 < {params.min_pts})"
    )


def _lsh_rows(params: GridParams, lsh: LshParams, verify: bool) -> str:
    return (
        f"{_hashed(params, lsh)}, z AS (SELECT win, {_k('count(*)')} AS k FROM g GROUP BY win), "
        f"s AS (SELECT g.*, z.k FROM g JOIN n ON {_on_cells('g', 'n', params)} JOIN z ON g.win = z.win "
        f"WHERE n.level1_count - 1 < {params.min_pts}), {_few(params, lsh, verify, '')}"
    )


def _lsh(params: GridParams, lsh: LshParams, verify: bool) -> str:
    spec = inp.EVENT_WINDOW
    return f"WITH {_lsh_rows(params, lsh, verify)} SELECT {_start(spec)}, {_end(spec)}, id AS point_id FROM f"


def _lsh_near(params: GridParams, lsh: LshParams, verify: bool, shared: bool) -> str:
    spec, d, k = inp.EVENT_WINDOW, params.dims, params.min_pts
    open_cells = f"level1_count - 1 < {k} AND level2_count - 1 >= {k}"
    if shared:
        models = (
            f"u AS (SELECT DISTINCT b.win, {_cs(params, 'b.')}, b.n FROM n a JOIN c b ON a.win = b.win AND "
            f"{_s2(params)} <= {9 * d} WHERE a.level1_count - 1 < {k} AND a.level2_count - 1 >= {k}), "
            f"z AS (SELECT win, {_k('sum(n)')} AS k FROM u GROUP BY win), "
            f"s AS (SELECT g.*, z.k FROM g JOIN n ON {_on_cells('g', 'n', params)} JOIN z ON g.win = z.win WHERE {open_cells})"
        )
        indexed = " AND (" + f"b.win, {_cs(params, 'b.')}) IN (SELECT win, {_cs(params)} FROM u)"
    else:
        models = (
            f"s AS (SELECT g.*, {_k('level2_count')} AS k FROM g JOIN n ON {_on_cells('g', 'n', params)} WHERE {open_cells})"
        )
        indexed = f" AND {_s2(params)} <= {9 * d}"
    return (
        f"WITH {_hashed(params, lsh)}, {models}, {_few(params, lsh, verify, indexed)}, e AS (SELECT g.win, g.id FROM g "
        f"JOIN n ON {_on_cells('g', 'n', params)} WHERE level2_count - 1 < {k}) "
        f"SELECT {_start(spec)}, {_end(spec)}, id AS point_id FROM (SELECT * FROM f UNION ALL SELECT * FROM e)"
    )


def _value(direction: list[float], shift: float, width: float) -> str:
    dot = " + ".join(f"x{i} * CAST({a!r} AS DOUBLE)" for i, a in enumerate(direction))
    return f"({dot} + CAST({shift!r} AS DOUBLE)) / CAST({width!r} AS DOUBLE)"


def _probed(params: GridParams, lsh: LshParams, asked: str) -> str:
    """Points per window ``g``, and ``near``: the pairs within the radius that a table brings
    together. ``asked`` is SQL of the questions ``a (win, id)``."""
    width, spec = lsh.width_for(params.radius), inp.EVENT_WINDOW
    tables = hashing.projections(lsh, params.dims, params.radius)
    values = ", ".join("[" + ", ".join(_value(a, b, width) for a, b in t) + f"] AS v{i}" for i, t in enumerate(tables))
    w, s = spec.size_us, spec.slide_us
    parts = [
        f"{_events(params.dims)}, q AS (SELECT p.*, {_cells(params)}, {values} FROM p), g AS (SELECT q.*, "
        f"unnest(generate_series((us - {w}) // {s} + 1, us // {s})) AS win FROM q), "
        f"c AS (SELECT win, {_cs(params)}, count(*) AS n FROM g GROUP BY win, {_cs(params)}), {_reach_sums(params, spec)}, "
        f"z AS (SELECT win, {_k('count(*)')} AS k FROM g GROUP BY win), {asked}"
    ]
    for t in range(lsh.num_tables):
        parts.append(
            f"h{t} AS (SELECT g.*, z.k, v{t}[1:z.k] AS v, list_transform(v{t}[1:z.k], lambda x: CAST(floor(x) AS BIGINT)) AS b "
            f"FROM g JOIN z ON g.win = z.win), "
            f"a{t} AS (SELECT h.win, h.id, h.v, h.b FROM h{t} h JOIN a ON h.win = a.win AND h.id = a.id), "
            f"m{t} AS (SELECT win, id, i, step, CASE WHEN step < 0 THEN (v[i] - floor(v[i])) * (v[i] - floor(v[i])) "
            f"ELSE (1.0::DOUBLE - (v[i] - floor(v[i]))) * (1.0::DOUBLE - (v[i] - floor(v[i]))) END AS score FROM "
            f"(SELECT *, unnest(generate_series(1, len(b))) AS i FROM a{t}), (SELECT unnest([-1, 1]) AS step)), "
            f"r{t} AS (SELECT *, row_number() OVER (PARTITION BY win, id ORDER BY score, i, step) AS place FROM m{t} "
            f"QUALIFY place <= {lsh.probes}), "
            f"e{t} AS (SELECT win, id, score, i, step, 0 AS j, 0 AS other FROM r{t} UNION ALL SELECT x.win, x.id, "
            f"x.score + y.score, x.i, x.step, y.i, y.step FROM r{t} x JOIN r{t} y ON x.win = y.win AND x.id = y.id "
            f"AND x.place < y.place AND x.i <> y.i), "
            f"s{t} AS (SELECT *, row_number() OVER (PARTITION BY win, id ORDER BY score, i, step, j, other) AS place FROM e{t} "
            f"QUALIFY place <= {lsh.probes}), "
            f"o{t} AS (SELECT win, id, b FROM a{t} UNION ALL SELECT s.win, s.id, list_transform(a.b, lambda x, n: "
            f"x + CASE WHEN n = s.i THEN s.step ELSE 0 END + CASE WHEN n = s.j THEN s.other ELSE 0 END) FROM s{t} s "
            f"JOIN a{t} a ON s.win = a.win AND s.id = a.id)"
        )
    met = " UNION ".join(
        f"SELECT o.win, o.id, h.id AS other FROM o{t} o JOIN h{t} h ON o.win = h.win AND o.b = h.b AND o.id <> h.id"
        for t in range(lsh.num_tables)
    )
    near = (
        f"met AS ({met}), near AS (SELECT met.win, met.id, met.other, {_near(params, 'x', 'y')} AS distance FROM met JOIN p x "
        f"ON met.id = x.id JOIN p y ON met.other = y.id WHERE {_near(params, 'x', 'y')} <= {params.radius!r})"
    )
    return "WITH " + ", ".join([*parts, near])


def _lsh_probed(p: GridParams, where: str = "TRUE") -> str:
    spec = inp.EVENT_WINDOW
    asked = (
        f"a AS (SELECT g.win, g.id FROM g JOIN n ON {_on_cells('g', 'n', p)} WHERE n.level1_count - 1 < {p.min_pts})"
    )
    return (
        f"{_probed(p, PROBED, asked)} SELECT {_start(spec)}, {_end(spec)}, id AS point_id FROM (SELECT a.win, a.id FROM a LEFT JOIN "
        f"near USING (win, id) GROUP BY a.win, a.id HAVING count(near.other) < {p.min_pts}) WHERE {where}"
    )


def _knn_lsh() -> str:
    p, spec = inp.EVENTS_3D, inp.EVENT_WINDOW
    asked = (
        f"a AS (SELECT x.win, x.id FROM g x JOIN g y ON x.win = y.win AND {_near(p, 'x', 'y')} <= {p.radius!r} "
        f"GROUP BY x.win, x.id HAVING count(*) - 1 < {p.min_pts})"
    )
    return (
        f"{_probed(p, PROBED_TABLES, asked)}, f AS (SELECT *, row_number() OVER (PARTITION BY win, id ORDER BY distance, other) "
        f"AS place FROM near) SELECT {_start(spec)}, id AS point_id, other AS neighbor_id, distance, place FROM f "
        f"WHERE place <= {p.min_pts}"
    )


def _accuracy() -> str:
    p, spec = inp.EVENTS_3D, inp.EVENT_WINDOW
    return (
        f"WITH {_lsh_rows(p, ONE_TABLE, True)}, o AS (SELECT a.win, a.id FROM g a JOIN g b ON a.win = b.win AND "
        f"{_near(p)} <= {p.radius!r} GROUP BY a.win, a.id HAVING count(*) - 1 < {p.min_pts}), "
        "m AS (SELECT g.win, o.id IS NOT NULL AS e, f.id IS NOT NULL AS a FROM g LEFT JOIN o ON g.win = o.win AND "
        "g.id = o.id LEFT JOIN f ON g.win = f.win AND g.id = f.id), "
        "t AS (SELECT win, count(*) FILTER (WHERE e AND a) AS tp, count(*) FILTER (WHERE NOT e AND a) AS fp, "
        "count(*) FILTER (WHERE NOT e AND NOT a) AS tn, count(*) FILTER (WHERE e AND NOT a) AS fn FROM m GROUP BY win) "
        f"SELECT {_start(spec)}, tp, fp, tn, fn, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS precision, "
        "CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS recall FROM t"
    )


def build() -> dict[str, str]:
    ev, fine, many = inp.EVENT_WINDOW, inp.EVENT_FINE_WINDOW, inp.EVENT_MANY_WINDOW
    p1, p2, p3 = inp.EVENTS_1D, inp.EVENTS_2D, inp.EVENTS_3D
    delay = round(inp.STREAM_DELAY.total_seconds() * 1_000_000)
    closed = f"win * {ev.slide_us} + {ev.size_us} <= (SELECT max(us) - {delay} FROM p)"
    counts3 = f"WITH {_celled(p3, ev)}"
    counts2 = f"WITH {_celled(p2, ev)}"
    all_points = _exact(_events(3), p3, ev)
    line_xs = (
        "l_quantity AS x0, l_extendedprice AS x1, l_discount AS x2"
    )
    slabs = f"b AS (SELECT win, c{p3.sort_dim} AS slab, count(*) AS n_cells, CAST(sum(n) AS BIGINT) AS n_points FROM c GROUP BY ALL)"
    cap = f" AND abs(a.c{p3.sort_dim} - b.c{p3.sort_dim}) <= 1"
    n3 = f"{counts3}, {_reach_sums(p3, ev)}"
    n2 = f"{counts2}, {_reach_sums(p2, ev)}"
    p5, near5, ship = inp.SHIPPED_5D, inp.SHIPPED_NEAR_5D, inp.SHIP_WINDOW
    n5 = f"WITH {_celled(p5, ship, _shipped())}, {_reach_sums(p5, ship)}"
    cell = _cell(p3)
    level = f"CASE WHEN s2 <= {p2.dims} THEN 1 WHEN s2 <= {9 * p2.dims} THEN 2 ELSE 0 END"
    strict = (
        f"CASE WHEN s2 < {p2.dims} THEN 1 WHEN s2 > {p2.dims} AND s2 < {9 * p2.dims} THEN 2 ELSE 0 END"
    )
    text = "'[' || CAST(x0 AS VARCHAR) || ', ' || CAST(x1 AS VARCHAR) || ']' AS value"
    return {
        "outliers_exact": all_points,
        "outliers_exact_fine": _exact(_events(3), p3, fine),
        "outliers_preset": _exact(_scaled_events(), preset("TAO"), ev),
        "outliers_shipped": _exact(_shipped(), inp.SHIPPED, inp.SHIP_WINDOW),
        "outliers_shipped_wide": _exact(_shipped(), inp.SHIPPED_10D, inp.SHIP_WINDOW),
        "outliers_embedded": _embedded(),
        "outliers_filtered": _embedded(),
        "mode_all": all_points,
        "mode_newest": _mode("newest"),
        "mode_expiring": _mode("expiring"),
        "mode_middle_expiring": _mode("middle", fine),
        "range_count": (
            f"WITH {_events(3)}, {_windowed(ev)} SELECT {_start(ev, 'a.win')}, a.id AS point_id, count(*) - 1 AS n_neighbors "
            f"FROM w a JOIN w b ON a.win = b.win AND {_near(p3)} <= {p3.radius!r} GROUP BY a.win, a.id"
        ),
        "knn_topk": (
            f"WITH {_outliers(_events(3), p3, ev)}, d AS (SELECT a.win, a.id, b.id AS other, {_near(p3)} AS distance "
            "FROM o JOIN w a ON o.win = a.win AND o.id = a.id JOIN w b ON a.win = b.win AND a.id <> b.id "
            f"WHERE {_near(p3)} <= {p3.radius!r}), r AS (SELECT d.*, row_number() OVER (PARTITION BY win, id ORDER BY "
            f"distance, other) AS place FROM d) SELECT {_start(ev)}, id AS point_id, other AS neighbor_id, distance, place "
            "FROM r WHERE place <= " + str(p3.min_pts)
        ),
        "parse_points": (
            f"WITH l AS (SELECT {line_xs}, l_returnflag = 'R' AS bad FROM lineitem) SELECT CASE WHEN NOT bad THEN x0 END AS x0, "
            "CASE WHEN NOT bad THEN x1 END AS x1, CASE WHEN NOT bad THEN x2 END AS x2, bad FROM l"
        ),
        "read_text_points": f"SELECT {line_xs} FROM lineitem",
        "arrival_from_order": (
            "SELECT event_id, CAST(1704067200000 + row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS arrival_ms FROM events"
        ),
        "outlier_text": f"WITH {_outliers(_events(2), p2, ev)} SELECT {text} FROM o JOIN p ON o.id = p.id",
        "window_assign": (
            f"WITH {_events(1)}, {_windowed(fine)} SELECT {_start(fine)}, {_end(fine)}, id AS point_id FROM w"
        ),
        "window_sizes": f"WITH {_events(1)}, {_windowed(fine)} SELECT {_start(fine)}, count(*) AS n FROM w GROUP BY win",
        "cell_assign": f"WITH {_events(3)}, g AS (SELECT id, {_cells(p3)} FROM p) SELECT id AS point_id, {cell} FROM g",
        "cell_center": (
            f"WITH {_events(3)}, g AS (SELECT id, {_cells(p3)} FROM p) SELECT id AS point_id, "
            + ", ".join(f"CAST(c{i} AS DOUBLE) + CAST(0.5 AS DOUBLE) AS center{i}" for i in range(3))
            + " FROM g"
        ),
        "cell_from_center": f"WITH {_events(3)}, g AS (SELECT id, {_cells(p3)} FROM p) SELECT id AS point_id, {cell} FROM g",
        "cell_counts": f"{counts3} SELECT {_start(ev)}, {cell}, n FROM c",
        "cell_running_count": f"WITH {_running()} SELECT id AS point_id, {_cell(p1)}, cell_count FROM r",
        "cell_updates": _updates(),
        "cell_latest": _latest(),
        "slab_ranked": (
            f"{counts3} SELECT {_start(ev)}, c{p3.sort_dim} AS slab, {cell}, n, row_number() OVER {_slab_order(p3)} AS place FROM c"
        ),
        "slab_pairs": (
            f"{counts3}, {slabs} SELECT {_start(ev, 'a.win')}, a.slab, o.slab AS other_slab, o.n_cells, o.n_points "
            "FROM b a JOIN b o ON a.win = o.win AND abs(a.slab - o.slab) <= 1"
        ),
        "neighbor_level": (
            f"{counts2}, t AS (SELECT a.win, {_cell(p2, 'a.')}, {_cell(p2, 'b.', 'near')}, {_s2(p2)} AS s2 FROM c a JOIN c b "
            f"ON a.win = b.win AND {_s2(p2)} <= {10 * p2.dims}) SELECT {_start(ev)}, cell, near, s2, {level} AS level, "
            f"{strict} AS level_strict FROM t"
        ),
        "level1_count": f"{n3} SELECT {_start(ev)}, {cell}, n, level1_count FROM n",
        "level1_capped": f"{counts3}, {_reach_sums(p3, ev, 'c', cap)} SELECT {_start(ev)}, {cell}, n, level1_count FROM n",
        "level2_count": f"{n2} SELECT {_start(ev)}, {_cell(p2)}, n, level1_count, level2_count FROM n",
        "candidate_pairs": (
            f"{n2}, t AS (SELECT a.win, {_cell(p2, 'a.')}, {_cell(p2, 'b.', 'near')}, {_s2(p2)} AS s2, b.n FROM n a JOIN c b "
            f"ON a.win = b.win AND {_s2(p2)} <= {9 * p2.dims} WHERE a.level1_count - 1 < {p2.min_pts} AND "
            f"a.level2_count - 1 >= {p2.min_pts}) SELECT {_start(ev)}, cell, near, {level} AS level, n FROM t"
        ),
        "cell_counts_many": f"WITH {_celled(p1, many)} SELECT {_start(many)}, {_cell(p1)}, n FROM c",
        "dense_prune_many": (
            f"WITH {_celled(p1, many)} SELECT {_start(many, 'g.win')}, g.id AS point_id FROM g JOIN c ON {_on_cells('g', 'c', p1)} "
            f"WHERE c.n - 1 < {p1.min_pts}"
        ),
        "outliers_odd_slide": _exact(_events(3), p3, inp.EVENT_ODD_WINDOW),
        "dense_prune": (
            f"WITH {_celled(p1, ev)} SELECT {_start(ev, 'g.win')}, g.id AS point_id FROM g JOIN c ON {_on_cells('g', 'c', p1)} "
            f"WHERE c.n - 1 < {p1.min_pts}"
        ),
        "definite_outliers": (
            f"{n2} SELECT {_start(ev, 'g.win')}, g.id AS point_id FROM g JOIN n ON {_on_cells('g', 'n', p2)} "
            f"WHERE n.level2_count - 1 < {p2.min_pts}"
        ),
        "level1_count_wide": f"{n5} SELECT {_start(ship)}, {_cell(p5)}, n, level1_count FROM n",
        "definite_outliers_wide": (
            f"WITH {_celled(near5, ship, _shipped())}, {_reach_sums(near5, ship)} SELECT {_start(ship, 'g.win')}, g.id AS point_id "
            f"FROM g JOIN n ON {_on_cells('g', 'n', near5)} WHERE n.level2_count - 1 < {near5.min_pts}"
        ),
        "lsh_params": (
            f"WITH {_events(3)}, {_windowed(ev)} SELECT {_start(ev)}, count(*) AS n, CAST({4 * p3.radius!r} AS DOUBLE) AS width, "
            f"{_k('count(*)')} AS k FROM w GROUP BY win"
        ),
        "outliers_lsh": _lsh(p3, ONE_TABLE, True),
        "outliers_lsh_candidates": _lsh(p3, ONE_TABLE, False),
        "outliers_lsh_shared": _lsh_near(p2, THREE_TABLES, True, True),
        "outliers_lsh_shared_candidates": _lsh_near(p2, THREE_TABLES, False, True),
        "outliers_lsh_local": _lsh_near(p2, THREE_TABLES, True, False),
        "outliers_lsh_local_candidates": _lsh_near(p2, THREE_TABLES, False, False),
        "outliers_lsh_probed": _lsh_probed(p3),
        "outliers_stream_probed": _lsh_probed(p2, closed),
        "knn_lsh": _knn_lsh(),
        "accuracy": _accuracy(),
        "outliers_stream": _exact(_events(2), p2, ev, closed),
        "outliers_stream_joined": _exact(_events(2), p2, ev, closed),
        "cell_running_count_stream": (
            f"WITH {_running()} SELECT id AS point_id, {_cell(p1)}, cell_count FROM r WHERE {_tick_end('us')} <= "
            f"(SELECT max(us) - {delay} FROM p)"
        ),
        "cell_updates_stream": f"{_updates()} AND {_tick_end('moment')} <= (SELECT max(us) - {delay} FROM p)",
        "window_metrics": (
            f"WITH {_outliers(_events(2), p2, ev)}, z AS (SELECT win, count(*) AS n FROM w GROUP BY win), m AS (SELECT z.win, "
            "any_value(z.n) AS n_points, count(o.id) AS n_outliers FROM z LEFT JOIN o ON z.win = o.win GROUP BY z.win), "
            "t AS (SELECT *, row_number() OVER (ORDER BY win) AS n_windows, CAST(sum(n_outliers) OVER (ORDER BY win) AS BIGINT) "
            f"AS total_outliers FROM m WHERE {closed}) SELECT {_start(ev)}, n_points, n_outliers, n_windows, total_outliers, "
            "CAST(total_outliers AS DOUBLE) / n_windows AS mean_outliers FROM t"
        ),
        "text_stream_points": f"SELECT {line_xs}, CAST(1 AS BIGINT) AS copies, TRUE AS stamped FROM lineitem",
        "text_stream_outliers": (
            f"WITH {_outliers(_events(2), p2, ev)} SELECT {_end(ev, 'o.win')}, {text} FROM o JOIN p ON o.id = p.id "
            f"WHERE {closed.replace('win', 'o.win', 1)}"
        ),
        "cell_counts_stream": f"{counts2} SELECT {_start(ev)}, {_cell(p2)}, n FROM c WHERE {closed}",
    }
