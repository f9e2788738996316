"""DuckDB SQL that gives the rows of `queries.QUERIES`, written on its own over the driver's views."""

from __future__ import annotations

_FIXES = """
base AS (SELECT user_id AS source_id, ts, event_id, CAST(10 * k + value % 10 AS DOUBLE) AS x, CAST(10 * (value % 100) AS DOUBLE) AS y, value, k
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
fixes AS (SELECT *, CAST(row_number() OVER w - 1 AS INTEGER) AS record_number, lag(x) OVER w AS prev_x, lag(y) OVER w AS prev_y,
    coalesce((x - lag(x) OVER w) / 30, 0) AS vx, coalesce((y - lag(y) OVER w) / 30, 0) AS vy
    FROM base WINDOW w AS (PARTITION BY source_id ORDER BY ts, event_id))"""

_GRID = """
cells AS (SELECT CAST(e AS INTEGER) AS edge_id, e // 110 AS way, e % 110 AS r FROM range(440) t(e)),
corners AS (SELECT edge_id, way, CASE WHEN way < 2 THEN r % 10 ELSE r // 10 END AS i, CASE WHEN way < 2 THEN r // 10 ELSE r % 10 END AS j,
    CASE WHEN way < 2 THEN 1 ELSE 0 END AS di, CASE WHEN way < 2 THEN 0 ELSE 1 END AS dj FROM cells),
turned AS (SELECT edge_id, way, CASE WHEN way % 2 = 0 THEN i ELSE i + di END AS ai, CASE WHEN way % 2 = 0 THEN j ELSE j + dj END AS aj,
    CASE WHEN way % 2 = 0 THEN i + di ELSE i END AS bi, CASE WHEN way % 2 = 0 THEN j + dj ELSE j END AS bj FROM corners),
edges AS (SELECT edge_id, way, CAST(ai * 11 + aj AS INTEGER) AS from_node, CAST(bi * 11 + bj AS INTEGER) AS to_node,
    CAST(100 * ai AS DOUBLE) AS ax, CAST(100 * aj AS DOUBLE) AS ay, CAST(50 * (ai + bi) AS DOUBLE) AS mx, CAST(50 * (aj + bj) AS DOUBLE) AS my,
    CAST(100 * bi AS DOUBLE) AS bx, CAST(100 * bj AS DOUBLE) AS by_ FROM turned),
segs AS (SELECT edge_id, way, 0 AS seg_idx, ax AS x0, ay AS y0, mx AS x1, my AS y1, 50::DOUBLE AS seg_len, 0::DOUBLE AS start_dist, 100::DOUBLE AS edge_len, 1 AS next_seg_idx FROM edges
    UNION ALL SELECT edge_id, way, 1, mx, my, bx, by_, 50::DOUBLE, 50::DOUBLE, 100::DOUBLE, NULL FROM edges)"""

_T = "greatest(0, least(s.seg_len, ((f.x - s.x0) * (s.x1 - s.x0) + (f.y - s.y0) * (s.y1 - s.y0)) / s.seg_len))"

_NEAR = f"""
placed AS (SELECT f.source_id, f.record_number, f.x, f.y, f.vx, f.vy, f.prev_x, f.prev_y, f.value, s.*, {_T} AS t FROM fixes f JOIN segs s
    ON s.x0 BETWEEN f.x - 180 AND f.x + 180 AND s.y0 BETWEEN f.y - 180 AND f.y + 180),
pointed AS (SELECT *, x0 + t / seg_len * (x1 - x0) AS snap_x, y0 + t / seg_len * (y1 - y0) AS snap_y FROM placed),
measured AS (SELECT *, sqrt((snap_x - x) * (snap_x - x) + (snap_y - y) * (snap_y - y)) AS dist FROM pointed),
near AS MATERIALIZED (SELECT * FROM measured WHERE dist < 60),
snapped AS MATERIALIZED (SELECT *, start_dist + t AS along FROM (SELECT *, row_number() OVER (PARTITION BY source_id, record_number ORDER BY dist, edge_id, seg_idx) AS best FROM near) WHERE best = 1)"""

_ON_OFF = """
onoff AS MATERIALIZED (SELECT f.source_id, f.record_number, f.x, f.y, f.vx, f.vy, f.value, s.edge_id, s.dist FROM fixes f
    LEFT JOIN (SELECT * FROM snapped WHERE dist < 25) s ON f.source_id = s.source_id AND f.record_number = s.record_number)"""

_WEIGHTED = """
logged AS (SELECT *, -0.5 * (ln(2 * pi()) + ln(100) + dist * dist / 100) AS log_w FROM near),
topped AS (SELECT *, max(log_w) OVER (PARTITION BY source_id, record_number) AS top FROM logged),
totalled AS (SELECT *, top + ln(sum(exp(log_w - top)) OVER (PARTITION BY source_id, record_number)) AS log_total FROM topped),
weighted AS (SELECT *, exp(log_w - log_total) AS weight FROM totalled)"""

_COUNTS = """
stepped AS (SELECT source_id, record_number, edge_id, lag(edge_id) OVER (PARTITION BY source_id ORDER BY record_number) AS before FROM onoff),
counted AS (SELECT source_id, count(*) FILTER (record_number > 0 AND before IS NOT NULL AND edge_id IS NOT NULL) AS on_on,
    count(*) FILTER (record_number > 0 AND before IS NOT NULL AND edge_id IS NULL) AS on_off,
    count(*) FILTER (record_number > 0 AND before IS NULL AND edge_id IS NULL) AS off_off,
    count(*) FILTER (record_number > 0 AND before IS NULL AND edge_id IS NOT NULL) AS off_on FROM stepped GROUP BY source_id)"""

_WORLD = "world AS (SELECT event_id, value % 160 - 80 AS lat, 3.6::DOUBLE * CAST(json_extract_string(props, '$.k') AS INTEGER) - 180 + value % 3.5::DOUBLE AS lon FROM events)"

_ZONE = "zoned AS (SELECT *, CASE WHEN lon = 180 THEN 60 ELSE CAST(floor((lon + 180) / 6) AS INTEGER) + 1 END AS zone FROM world)"

# Krueger's series to the third power of the third flattening, spelled out
_UTM = """
k0 AS (SELECT (1 / 298.257223563::DOUBLE) / (2 - 1 / 298.257223563::DOUBLE) AS n),
k AS (SELECT n, 6378137 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS r, 2 * sqrt(n) / (1 + n) AS e,
    n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 AS a1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 AS a2, 61 * n ** 3 / 240 AS a3,
    n / 2 - 2 * n ** 2 / 3 + 37 * n ** 3 / 96 AS b1, n ** 2 / 48 + n ** 3 / 15 AS b2, 17 * n ** 3 / 480 AS b3,
    2 * n - 2 * n ** 2 / 3 - 2 * n ** 3 AS d1, 7 * n ** 2 / 3 - 8 * n ** 3 / 5 AS d2, 56 * n ** 3 / 15 AS d3 FROM k0),
angled AS (SELECT z.*, k.*, radians(lon) - radians(zone * 6 - 183) AS dl, sinh(atanh(sin(radians(lat))) - e * atanh(e * sin(radians(lat)))) AS t FROM zoned z, k),
conformal AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM angled),
utm AS (SELECT *, 500000 + 0.9996::DOUBLE * r * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)) AS easting,
    0.9996::DOUBLE * r * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)) + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END AS northing FROM conformal)"""

_BACK = """
flat AS (SELECT event_id, lat AS lat0, lon AS lon0, zone, b1, b2, b3, d1, d2, d3, (northing - CASE WHEN lat < 0 THEN 10000000 ELSE 0 END) / (0.9996::DOUBLE * r) AS u, (easting - 500000) / (0.9996::DOUBLE * r) AS w FROM utm),
sphere AS (SELECT *, u - b1 * sin(2 * u) * cosh(2 * w) - b2 * sin(4 * u) * cosh(4 * w) - b3 * sin(6 * u) * cosh(6 * w) AS p, w - b1 * cos(2 * u) * sinh(2 * w) - b2 * cos(4 * u) * sinh(4 * w) - b3 * cos(6 * u) * sinh(6 * w) AS q FROM flat),
back AS (SELECT event_id, lat0, lon0, degrees(c + d1 * sin(2 * c) + d2 * sin(4 * c) + d3 * sin(6 * c)) AS lat, degrees(radians(zone * 6 - 183) + atan2(sinh(q), cos(p))) AS lon FROM (SELECT *, asin(sin(p) / cosh(q)) AS c FROM sphere))"""


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 4) + 0.0 AS {n}" for n in names)


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(parts)


_FG, _FGN = (_FIXES, _GRID), (_FIXES, _GRID, _NEAR)

_WALK = """
walk AS (SELECT edge_id AS start_edge, to_node AS node, CAST(edge_id AS VARCHAR) AS path, edge_id AS last, 100::DOUBLE AS path_len FROM edges
    UNION ALL SELECT w.start_edge, e.to_node, w.path || ',' || e.edge_id, e.edge_id, w.path_len + 100 FROM walk w JOIN edges e ON e.from_node = w.node WHERE w.path_len < 250)"""

_REACH = """
hop AS (SELECT DISTINCT from_node AS node, from_node AS other, 0::DOUBLE AS cost, 0 AS n FROM edges
    UNION ALL SELECT h.node, e.to_node, h.cost + 100, h.n + 1 FROM hop h JOIN edges e ON e.from_node = h.other WHERE h.n < 4),
reach AS (SELECT node, other, min(cost) AS cost FROM hop GROUP BY node, other)"""

_APART = "(abs(a.to_node // 11 - b.from_node // 11) + abs(a.to_node % 11 - b.from_node % 11))"

# streets between moved grid points: the points, the ends of the streets, their segments
_CROOKED = """
spots AS (SELECT i, j, CAST(100 * i + (7 * i + 13 * j) % 41 - 20 AS DOUBLE) AS px, CAST(100 * j + (11 * i + 5 * j) % 37 - 18 AS DOUBLE) AS py FROM range(8) a(i), range(8) b(j)),
legs AS (SELECT 0 AS way, i, j, i AS i0, j AS j0, i + 1 AS i1, j AS j1 FROM spots WHERE i < 7
    UNION ALL SELECT 1, i, j, i + 1, j, i, j FROM spots WHERE i < 7 AND (i + 2 * j) % 5 <> 0
    UNION ALL SELECT 2, i, j, i, j, i, j + 1 FROM spots WHERE j < 7
    UNION ALL SELECT 3, i, j, i, j + 1, i, j FROM spots WHERE j < 7 AND (3 * i + j) % 4 <> 0),
edges AS (SELECT CAST(way * 100 + l.i * 10 + l.j AS INTEGER) AS edge_id, CAST(i0 * 8 + j0 AS INTEGER) AS from_node, CAST(i1 * 8 + j1 AS INTEGER) AS to_node,
    a.px AS ax, a.py AS ay, (a.px + b.px) / 2 + CASE WHEN way % 2 = 1 THEN -5 ELSE 6 END AS mx, (a.py + b.py) / 2 + CASE WHEN way % 2 = 1 THEN 7 ELSE -4 END AS my, b.px AS bx, b.py AS by_
    FROM legs l JOIN spots a ON a.i = i0 AND a.j = j0 JOIN spots b ON b.i = i1 AND b.j = j1),
streets AS (SELECT *, sqrt((mx - ax) ** 2 + (my - ay) ** 2) AS l0, sqrt((bx - mx) ** 2 + (by_ - my) ** 2) AS l1 FROM edges),
segs AS (SELECT edge_id, 0 AS way, 0 AS seg_idx, ax AS x0, ay AS y0, mx AS x1, my AS y1, l0 AS seg_len, 0::DOUBLE AS start_dist, l0 + l1 AS edge_len FROM streets
    UNION ALL SELECT edge_id, 0, 1, mx, my, bx, by_, l1, l0, l0 + l1 FROM streets)"""

_CROOKED_WALK = """
walk AS (SELECT edge_id AS start_edge, to_node AS node, CAST(edge_id AS VARCHAR) AS path, l0 + l1 AS path_len, 1 AS n FROM streets
    UNION ALL SELECT w.start_edge, e.to_node, w.path || ',' || e.edge_id, w.path_len + (e.l0 + e.l1), w.n + 1 FROM walk w JOIN streets e ON e.from_node = w.node WHERE w.path_len < 250)"""


def _integral(f: str, low: str, high: str, n: int = 600) -> str:
    """Simpson's rule for an expression in z."""
    step = f"(({high}) - ({low})) / {n}"
    weight = f"CASE WHEN k = 0 OR k = {n} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return f"({step} / 3 * list_sum(list_transform(range({n + 1}), lambda k: {weight} * ({f.replace('z', f'(({low}) + k * {step})')}))))"


_U = "(x1 - x0) / seg_len"
_V = "(y1 - y0) / seg_len"

_C0, _C1, _C2 = "100.0::DOUBLE", "100.0::DOUBLE / 30", "200.0::DOUBLE / 900"
_P00 = f"({_C0} + 60 * ({_C1}) + 900 * ({_C2}) + 6.25e-4 * 450 * 450)"
_P01 = f"(({_C1}) + 30 * ({_C2}) + 6.25e-4 * 450 * 30)"
_P11 = f"(({_C2}) + 6.25e-4 * 30 * 30)"

_DIFF_CASES = [
    ("c.ax = p.ax AND c.ay = p.ay AND c.mx = p.mx AND c.my = p.my", "p.along", 1),
    ("c.bx = p.bx AND c.by_ = p.by_ AND c.mx = p.mx AND c.my = p.my", "p.along", 1),
    ("c.ax = p.mx AND c.ay = p.my AND c.mx = p.bx AND c.my = p.by_", "p.along - 50", 1),
    ("c.mx = p.ax AND c.my = p.ay AND c.bx = p.mx AND c.by_ = p.my", "50 + p.along", 1),
    ("c.ax = p.mx AND c.ay = p.my AND c.mx = p.ax AND c.my = p.ay", "50 - p.along", -1),
    ("c.mx = p.bx AND c.my = p.by_ AND c.bx = p.mx AND c.by_ = p.my", "150 - p.along", -1),
    ("c.ax = p.bx AND c.ay = p.by_ AND c.mx = p.mx AND c.my = p.my", "100 - p.along", -1),
    ("c.mx = p.mx AND c.my = p.my AND c.bx = p.ax AND c.by_ = p.ay", "100 - p.along", -1),
    ("c.ax = p.bx AND c.ay = p.by_", "p.along - 100", 1),
    ("c.bx = p.ax AND c.by_ = p.ay", "100 + p.along", 1),
    ("c.ax = p.ax AND c.ay = p.ay", "-p.along", -1),
    ("c.bx = p.bx AND c.by_ = p.by_", "200 - p.along", -1),
]
_DIFF_D = " ".join(f"WHEN {c} THEN c.along - ({place})" for c, place, _ in _DIFF_CASES)
_DIFF_V = " ".join(f"WHEN {c} THEN c.vx {'-' if agrees > 0 else '+'} p.vx" for c, _, agrees in _DIFF_CASES)

_TURN = """
pairs AS (SELECT source_id, record_number, edge_id, seg_idx, x0, y0, x1, y1, edge_len, lag(edge_id) OVER w AS p_edge, lag(seg_idx) OVER w AS p_seg,
    lag(x0) OVER w - lag(x1) OVER w AS gx, lag(y0) OVER w - lag(y1) OVER w AS gy, lag(edge_len) OVER w AS p_len
    FROM snapped WINDOW w AS (PARTITION BY source_id ORDER BY record_number)),
angles AS (SELECT *, (gx * (x1 - x0) + gy * (y1 - y0)) / (sqrt(gx * gx + gy * gy) * sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))) AS c FROM pairs)"""

ORACLE_SQL = {
    "obs_scan": f"{_with(_FIXES)} SELECT source_id, record_number, event_id, {_r('x', 'y', 'prev_x', 'prev_y')} FROM fixes",
    "obs_displacement_velocity": f"{_with(_FIXES)} SELECT source_id, record_number, {_r('vx', 'vy')} FROM fixes",
    "obs_in_extent": f"{_with(_FIXES)} SELECT x BETWEEN 0 AND 1000 AND y BETWEEN 0 AND 1000 AS in_extent, count(*) AS n FROM fixes GROUP BY 1",
    "utm_zone_epsg": f"{_with(_WORLD, _ZONE)} SELECT event_id, zone, CAST(32600 + zone + CASE WHEN lat < 0 THEN 100 ELSE 0 END AS INTEGER) AS epsg FROM zoned",
    "utm_forward": f"{_with(_WORLD, _ZONE, _UTM)} SELECT event_id, round(easting, 2) AS easting, round(northing, 2) AS northing FROM utm",
    "utm_roundtrip": f"{_with(_WORLD, _ZONE, _UTM, _BACK)} SELECT event_id, abs(lat - lat0) < 1e-6 AS lat_ok, abs(lon - lon0) < 1e-6 AS lon_ok, round(lat, 5) AS lat, round(lon, 5) AS lon FROM back",
    "metres_to_degrees": f"{_with(_FIXES)} SELECT event_id, round(x / (pi() / 180) / 6378137, 8) AS degrees FROM fixes",
    "graph_segments": f"{_with(_GRID)} SELECT edge_id, seg_idx, {_r('x0', 'y0', 'x1', 'y1', 'seg_len', 'start_dist', 'edge_len')}, next_seg_idx FROM segs",
    "graph_extent": f"{_with(_GRID)} SELECT min(least(x0, x1)) + 0.0 AS min_x, min(least(y0, y1)) + 0.0 AS min_y, max(greatest(x0, x1)) + 0.0 AS max_x, max(greatest(y0, y1)) + 0.0 AS max_y, count(DISTINCT edge_id) AS n_edges, sum(seg_len) + 0.0 AS total_len FROM segs",
    "graph_edge_facts": f"{_with(_GRID)} SELECT edge_id, 100.0::DOUBLE AS length, round((ax + mx + bx) / 3, 4) + 0.0 AS centre_x, round((ay + my + by_) / 3, 4) + 0.0 AS centre_y, ax + 0.0 AS x_from, ay + 0.0 AS y_from, bx + 0.0 AS x_to, by_ + 0.0 AS y_to FROM edges",
    "adjacency_out": f"{_with(_GRID)} SELECT a.edge_id, b.edge_id AS out_edge_id FROM edges a JOIN edges b ON a.to_node = b.from_node",
    "adjacency_in": f"{_with(_GRID)} SELECT a.edge_id, b.edge_id AS in_edge_id FROM edges a JOIN edges b ON a.from_node = b.to_node",
    "reverse_edges": f"{_with(_GRID)} SELECT a.edge_id, b.edge_id AS reverse_edge_id, b.edge_id IS NOT NULL AS has_reverse FROM edges a LEFT JOIN edges b ON a.from_node = b.to_node AND a.to_node = b.from_node",
    "same_street": f"{_with(_GRID)} SELECT a.edge_id, b.edge_id AS equal_edge_id FROM edges a JOIN edges b ON a.edge_id = b.edge_id OR (a.from_node = b.to_node AND a.to_node = b.from_node)",
    "segments_between": f"{_with(_GRID)} SELECT edge_id, seg_idx, {_r('start_dist')} FROM segs WHERE start_dist BETWEEN 25 AND 80",
    "nearby_segments": f"{_with(*_FGN)} SELECT source_id, record_number, edge_id, seg_idx, {_r('dist')} FROM near",
    "paths_to_length": f"{_with(_GRID, _WALK, recursive=True)} SELECT start_edge, path, {_r('path_len')} FROM walk WHERE path_len >= 250",
    "edges_at_length": f"{_with(_GRID, _WALK, recursive=True)} SELECT DISTINCT start_edge, last AS edge_id FROM walk WHERE path_len >= 250",
    "node_reach": f"{_with(_GRID, _REACH, recursive=True)} SELECT node, other, {_r('cost')} FROM reach",
    "candidate_paths": f"""{_with(*_FGN, _ON_OFF)},
        steps AS (SELECT source_id, record_number, lag(edge_id) OVER (PARTITION BY source_id ORDER BY record_number) AS prev_edge FROM onoff QUALIFY record_number > 0),
        goals AS (SELECT DISTINCT s.source_id, s.record_number, s.prev_edge, n.edge_id FROM steps s JOIN near n ON s.source_id = n.source_id AND s.record_number = n.record_number)
        SELECT source_id, record_number, prev_edge, g.edge_id, 'ahead' AS kind, 100.0::DOUBLE * {_APART} AS cost FROM goals g JOIN edges a ON a.edge_id = g.prev_edge JOIN edges b ON b.edge_id = g.edge_id WHERE 100 * {_APART} <= 1620
        UNION ALL SELECT source_id, record_number, prev_edge, edge_id, 'same', 0 FROM goals WHERE edge_id = prev_edge
        UNION ALL SELECT source_id, record_number, prev_edge, edge_id, 'onto', NULL FROM goals WHERE prev_edge IS NULL
        UNION ALL SELECT source_id, record_number, prev_edge, NULL, 'off', NULL FROM steps""",
    "node_distances": f"""WITH n AS (SELECT CAST(k AS INTEGER) AS k FROM range(121) t(k)) SELECT a.k AS node, b.k AS other, 100.0::DOUBLE * (abs(a.k // 11 - b.k // 11) + abs(a.k % 11 - b.k % 11)) AS cost
        FROM n a, n b WHERE 100 * (abs(a.k // 11 - b.k // 11) + abs(a.k % 11 - b.k % 11)) <= 1620""",
    "nearby_by_belief": f"{_with(*_FGN)} SELECT source_id, record_number, edge_id, seg_idx, {_r('dist')} FROM near WHERE dist < 2.5 * sqrt((20 + value % 100) * sqrt(2))",
    "nearby_open_streets": f"{_with(*_FGN)} SELECT source_id, record_number, edge_id, seg_idx, {_r('dist')} FROM near WHERE edge_id % 3 <> 0",
    "turn_seconds": f"""{_with(_GRID)} SELECT a.edge_id, b.edge_id AS out_edge_id, round((100 + CASE WHEN b.to_node = a.from_node THEN 3 ELSE 0 END) / 15.0::DOUBLE, 4) AS seconds
        FROM edges a JOIN edges b ON a.to_node = b.from_node WHERE NOT (b.to_node = a.from_node AND a.edge_id % 7 = 0)""",
    "search_costs": f"{_with(*_FGN)} SELECT source_id, record_number, round(greatest(0, 50 + along - 30 * abs(vx)), 4) + 0.0 AS cost, round(greatest(0, dist - 10) / 15, 4) + 0.0 AS heuristic FROM snapped",
    "crooked_facts": f"{_with(_CROOKED)} SELECT edge_id, round(l0 + l1, 4) AS length, round((ax + mx + bx) / 3, 4) + 0.0 AS centre_x, round((ay + my + by_) / 3, 4) + 0.0 AS centre_y, ax AS x_from, ay AS y_from, bx AS x_to, by_ AS y_to FROM streets",
    "crooked_snap": f"""{_with(_FIXES, _CROOKED, _NEAR)}, first AS (SELECT *, start_dist + t AS road FROM near QUALIFY row_number() OVER (PARTITION BY source_id, record_number ORDER BY round(dist, 6), edge_id, seg_idx) = 1)
        SELECT source_id, record_number, edge_id, seg_idx, round(dist, 6) + 0.0 AS dist, round(road, 4) + 0.0 AS along, round(100 * ({_U}) ** 2 + 40 * ({_U}) * ({_V}) + 50 * ({_V}) ** 2, 4) + 0.0 AS road_var FROM first""",
    "crooked_distances": f"""{_with(_CROOKED, recursive=True)}, hop AS (SELECT DISTINCT from_node AS node, from_node AS other, 0::DOUBLE AS cost FROM edges
        UNION SELECT h.node, e.to_node, h.cost + (e.l0 + e.l1) FROM hop h JOIN streets e ON e.from_node = h.other WHERE h.cost + (e.l0 + e.l1) <= 600)
        SELECT node, other, round(min(cost), 4) + 0.0 AS cost FROM (SELECT * FROM hop UNION ALL SELECT to_node, to_node, 0 FROM edges) GROUP BY node, other""",
    "crooked_walks": f"{_with(_CROOKED, _CROOKED_WALK, recursive=True)} SELECT start_edge, path, {_r('path_len')} FROM walk WHERE path_len >= 250",
    "walk_geometry": f"""{_with(_CROOKED, _CROOKED_WALK, recursive=True)}, whole AS (SELECT start_edge, path, path_len, n, list_transform(string_split(path, ','), lambda e: CAST(e AS INTEGER)) AS e FROM walk WHERE path_len >= 250),
        ends AS (SELECT start_edge, path, path_len, n, unnest(e[:-2]) AS a, unnest(e[2:]) AS b FROM whole)
        SELECT w.start_edge, w.path, CAST(any_value(2 * w.n + 1) AS INTEGER) AS n_points, round(any_value(w.path_len), 4) AS length, true AS joins, coalesce(bool_and(b.to_node = a.from_node), true) AS joins_back
        FROM ends w JOIN edges a ON a.edge_id = w.a JOIN edges b ON b.edge_id = w.b GROUP BY w.start_edge, w.path""",
    "path_tests": f"""{_with(*_FGN)}, spot AS (SELECT source_id, record_number, value % 130 - 15 AS d FROM snapped)
        SELECT source_id, record_number, round(greatest(0, least(100, d)), 4) + 0.0 AS clamped, round(least(0, greatest(-100, d - 100)), 4) + 0.0 AS clamped_back, round(d, 4) + 0.0 AS arc_back, d BETWEEN -1 AND 101 AS on_path, d >= 0 AND d <= 100 + 1e-7 AS on_edge,
        CASE WHEN d BETWEEN 0 AND 100 THEN round(d, 4) + 0.0 END AS checked, round(CASE WHEN d < 0 THEN 0.0001 WHEN d > 100 THEN 99.9999 ELSE d END, 6) AS nudged, CASE WHEN d < 50 THEN 0 ELSE 1 END AS piece FROM spot""",
    "movements": f"""{_with(*_FGN)}, spot AS (SELECT s.source_id, s.record_number, least(100, s.value % 130 - 15) AS b, (e.bx - e.ax) / 100 AS u, (e.by_ - e.ay) / 100 AS v, e.ax, e.ay FROM snapped s JOIN edges e USING (edge_id) WHERE s.value % 130 - 15 > 10)
        SELECT source_id, record_number, CASE WHEN b > 50 THEN 3 ELSE 2 END AS n_points, round(ax + 10 * u, 4) + 0.0 AS x0, round(ay + 10 * v, 4) + 0.0 AS y0, round(ax + b * u, 4) + 0.0 AS x1, round(ay + b * v, 4) + 0.0 AS y1,
        round(b - 10, 4) + 0.0 AS length, round(b, 4) + 0.0 AS upto, 50.0::DOUBLE AS rest FROM spot""",
    "state_algebra": f"""{_with(*_FGN)}, two AS (SELECT *, lag(along) OVER w AS pa, lag(vx) OVER w AS pv, lag(x1) OVER w - lag(x0) OVER w AS pu, lag(y1) OVER w - lag(y0) OVER w AS pw FROM snapped WINDOW w AS (PARTITION BY source_id ORDER BY record_number))
        SELECT source_id, record_number, round(along + pa, 4) + 0.0 AS sum_d, round(vx + pv, 4) + 0.0 AS sum_v, round(along - pa / 2, 4) + 0.0 AS half_d, round(vx - pv / 2, 4) + 0.0 AS half_v, round(along * pa + vx * pv, 4) + 0.0 AS dot,
        round(sqrt(along * along + vx * vx), 4) + 0.0 AS norm, round(CASE WHEN pu * (x1 - x0) + pw * (y1 - y0) < 0 THEN -vx ELSE vx END, 4) + 0.0 AS seen FROM two WHERE pa IS NOT NULL""",
    "state_order": f"""{_with(*_FGN)} SELECT s.source_id, s.record_number, CAST(row_number() OVER (PARTITION BY s.source_id ORDER BY e.ax, e.ay, e.mx, e.my, e.bx, e.by_, round(s.along, 6), round(s.vx, 6), s.record_number) AS INTEGER) AS place FROM snapped s JOIN edges e USING (edge_id)""",
    "ground_belief": f"""{_with(*_FGN)} SELECT source_id, record_number, round(x0 + ({_U}) * (along - start_dist), 4) + 0.0 AS gx, round(({_U}) * abs(vx), 4) + 0.0 AS gvx, round(y0 + ({_V}) * (along - start_dist), 4) + 0.0 AS gy, round(({_V}) * abs(vx), 4) + 0.0 AS gvy,
        round({_C0}, 4) AS g0, round({_C1}, 4) AS g1, 0.0::DOUBLE AS g2, 0.0::DOUBLE AS g3, round({_C2}, 4) AS g4, 0.0::DOUBLE AS g5, 0.0::DOUBLE AS g6, round({_C0}, 4) AS g7, round({_C1}, 4) AS g8, round({_C2}, 4) AS g9 FROM snapped""",
    "road_belief": f"""{_with(*_FGN)} SELECT source_id, record_number, round(along, 4) + 0.0 AS road_d, round(sqrt((x - prev_x) ** 2 + (y - prev_y) ** 2) / 30 * sign((x - prev_x) * ({_U}) + (y - prev_y) * ({_V})), 4) + 0.0 AS road_v,
        round({_C0}, 4) AS road_c00, round({_C1}, 4) AS road_c01, round({_C2}, 4) AS road_c11 FROM snapped WHERE prev_x IS NOT NULL""",
    "truncated_mean": f"""{_with(*_FGN)}, pulled AS (SELECT source_id, record_number, along AS m FROM snapped)
        SELECT source_id, record_number, round({_integral("z * exp(-0.5 * (z - m) * (z - m) / 100)", "0::DOUBLE", "100::DOUBLE")} / {_integral("exp(-0.5 * (z - m) * (z - m) / 100)", "0::DOUBLE", "100::DOUBLE")}, 4) AS mean FROM pulled""",
    "folded_mean": f"""{_with(*_FGN)}, pulled AS (SELECT source_id, record_number, along - 50 AS m FROM snapped)
        SELECT source_id, record_number, round({_integral("z * (exp(-0.5 * (z - m) * (z - m) / 400) + exp(-0.5 * (z + m) * (z + m) / 400))", "0::DOUBLE", "260::DOUBLE", 1200)} / (20 * sqrt(2 * pi())), 4) AS mean FROM pulled""",
    "dirichlet_density": f"""{_with(*_FGN, _ON_OFF, _COUNTS)}, s AS (SELECT source_id, (on_on + 1)::DOUBLE / (on_on + on_off + 2) AS p FROM counted)
        SELECT source_id, round(94 * ln(p) + 4 * ln(1 - p) + lgamma(100) - lgamma(95) - lgamma(5), 4) AS log_density FROM s""",
    "mean_next_edge": f"""{_with(*_FGN, _ON_OFF, _COUNTS, recursive=True)}, p AS (SELECT source_id, (95.0::DOUBLE + on_on) / (100 + on_on + on_off) AS p_on, (5.0::DOUBLE + off_off) / (100 + off_off + off_on) AS p_off FROM counted),
        far AS (SELECT edge_id AS start_edge, to_node AS node, edge_id AS last, 100 AS len FROM edges UNION ALL SELECT f.start_edge, e.to_node, e.edge_id, f.len + 100 FROM far f JOIN edges e ON e.from_node = f.node WHERE f.len < 150),
        ahead AS (SELECT start_edge, min(last) AS least FROM far WHERE len >= 150 GROUP BY start_edge), beside AS (SELECT source_id, record_number, min(edge_id) AS least FROM near GROUP BY ALL)
        SELECT o.source_id, o.record_number, CASE WHEN o.edge_id IS NOT NULL AND p_on >= 0.5 THEN a.least WHEN o.edge_id IS NULL AND p_off < 0.5 THEN b.least END AS mean_edge
        FROM onoff o JOIN p USING (source_id) LEFT JOIN ahead a ON a.start_edge = o.edge_id LEFT JOIN beside b ON b.source_id = o.source_id AND b.record_number = o.record_number""",
    "simulate_exact": """WITH steps AS (SELECT k AS source_id, CAST(n AS INTEGER) AS record_number, 7000 * n AS t_ms, (50 + 7 * n * k) % 400 AS s, k::DOUBLE AS true_speed, n FROM range(48) a(k), range(100) b(n)),
        side AS (SELECT *, CASE WHEN s = 0 AND n > 0 AND k > 0 THEN 400 ELSE s END AS d FROM (SELECT *, source_id AS k FROM steps)),
        spot AS (SELECT *, CASE WHEN d <= 100 THEN d WHEN d <= 200 THEN 100 WHEN d <= 300 THEN 300 - d ELSE 0 END::DOUBLE AS x, CASE WHEN d <= 100 THEN 0 WHEN d <= 200 THEN d - 100 WHEN d <= 300 THEN 100 ELSE 400 - d END::DOUBLE AS y FROM side)
        SELECT source_id, record_number, t_ms, x, y, true AS true_on_road, true_speed, x AS true_x, y AS true_y FROM spot""",
    "result_paths": f"""{_with(*_FGN)}, before AS (SELECT b.edge_id, min(a.edge_id) AS in_edge_id FROM edges a JOIN edges b ON a.to_node = b.from_node GROUP BY b.edge_id),
        two AS (SELECT s.source_id, s.record_number, s.along, a.ax, a.ay, a.mx, a.my, e.ax AS cx, e.ay AS cy, e.mx AS dx, e.my AS dy, e.ax + (e.bx - e.ax) / 100 * s.along AS ex, e.ay + (e.by_ - e.ay) / 100 * s.along AS ey
            FROM snapped s JOIN before USING (edge_id) JOIN edges a ON a.edge_id = in_edge_id JOIN edges e ON e.edge_id = s.edge_id),
        said AS (SELECT source_id, record_number, list_concat([[ax, ay], [mx, my]], CASE WHEN along > 0 THEN [[cx, cy]] ELSE [] END, CASE WHEN along > 50 THEN [[dx, dy]] ELSE [] END, [[ex, ey]]) AS p FROM two)
        SELECT source_id, record_number, '[' || array_to_string(list_transform(p, lambda q: '[' || printf('%.4f', round(q[1], 4) + 0.0) || ',' || printf('%.4f', round(q[2], 4) + 0.0) || ']'), ',') || ']' AS json FROM said""",
    "geometry_roundtrip": f"{_with(_GRID)} SELECT edge_id, 3 AS n, round(40.7 + ay / 111000, 5) AS lat_from, round(ax / 111000 - 74, 5) AS lon_from, round(40.7 + by_ / 111000, 5) AS lat_to, round(bx / 111000 - 74, 5) AS lon_to FROM edges",
    "covariance_json": """WITH c AS (SELECT event_id, value % 50 + 1 AS a, value % 50 / 4 AS b, value % 50 + 2 AS d FROM events), t AS (SELECT event_id, printf('%.4f', round(a, 4)) AS a, printf('%.4f', round(b, 4)) AS b, printf('%.4f', round(d, 4)) AS d FROM c)
        SELECT event_id, '[[' || a || ',' || b || '],[' || b || ',' || d || ']]' AS json, round(a::DOUBLE + 2 * b::DOUBLE + d::DOUBLE, 4) + 0.0 AS total FROM t""",
    "snap_nearest": f"{_with(*_FGN)} SELECT source_id, record_number, edge_id, seg_idx, {_r('dist', 'snap_x', 'snap_y', 'along')} FROM snapped",
    "road_observation": f"{_with(*_FGN)} SELECT source_id, record_number, edge_id, round(along, 4) + 0.0 AS road_obs, round(100 * ({_U}) * ({_U}) + 40 * ({_U}) * ({_V}) + 50 * ({_V}) * ({_V}), 4) + 0.0 AS road_var FROM snapped",
    "ground_from_road": f"""{_with(*_FGN)} SELECT source_id, record_number, round(x0 + ({_U}) * (along - start_dist), 4) + 0.0 AS gx, round(({_U}) * (vx - vy), 4) + 0.0 AS gvx,
        round(y0 + ({_V}) * (along - start_dist), 4) + 0.0 AS gy, round(({_V}) * (vx - vy), 4) + 0.0 AS gvy FROM snapped""",
    "road_from_ground": f"{_with(*_FGN)} SELECT source_id, record_number, round(along, 4) + 0.0 AS road_d, round(sqrt(vx * vx + vy * vy) * sign(vx * ({_U}) + vy * ({_V})), 4) + 0.0 AS road_v FROM snapped",
    "covariance_projection": f"""{_with(*_FGN)}, uv AS (SELECT source_id, record_number, {_U} AS u, {_V} AS v, {_C0} AS a, {_C1} AS b, {_C2} AS c FROM snapped)
        SELECT source_id, record_number, round(100 * u * u + 40 * u * v + 50 * v * v, 4) + 0.0 AS road_var, round(u * u * a, 4) + 0.0 AS g0, round(u * u * b, 4) + 0.0 AS g1, round(u * v * a, 4) + 0.0 AS g2, round(u * v * b, 4) + 0.0 AS g3,
        round(u * u * c, 4) + 0.0 AS g4, round(u * v * b, 4) + 0.0 AS g5, round(u * v * c, 4) + 0.0 AS g6, round(v * v * a, 4) + 0.0 AS g7, round(v * v * b, 4) + 0.0 AS g8, round(v * v * c, 4) + 0.0 AS g9 FROM uv""",
    "state_diff": f"""{_with(*_FGN)},
        streets AS (SELECT s.source_id, s.record_number, s.along, s.vx, e.ax, e.ay, e.mx, e.my, e.bx, e.by_, row_number() OVER (PARTITION BY s.source_id ORDER BY s.record_number) AS n FROM snapped s JOIN edges e USING (edge_id))
        SELECT c.source_id, c.record_number, round(CASE {_DIFF_D} END, 4) + 0.0 AS d, round(CASE {_DIFF_V} END, 4) + 0.0 AS v FROM streets c JOIN streets p ON c.source_id = p.source_id AND c.n = p.n + 1""",
    "kalman_predict": f"""{_with(_FIXES)} SELECT source_id, record_number, round(x + 30 * vx, 4) + 0.0 AS px, round(vx, 4) + 0.0 AS pvx, round(y + 30 * vy, 4) + 0.0 AS py, round(vy, 4) + 0.0 AS pvy,
        round({_P00}, 4) + 0.0 AS p00, round({_P01}, 4) + 0.0 AS p01, round({_P11}, 4) + 0.0 AS p11 FROM fixes""",
    "kalman_filter_offroad": f"""{_with(_FIXES, recursive=True)},
        kf AS (SELECT source_id, record_number, x AS mx, 0::DOUBLE AS mvx, y AS my, 0::DOUBLE AS mvy, {_C0} AS c0, {_C1} AS c1, {_C2} AS c2 FROM fixes WHERE record_number = 0
        UNION ALL SELECT source_id, record_number, ax + p0 / s * (zx - ax), mvx + p1 / s * (zx - ax), ay + p0 / s * (zy - ay), mvy + p1 / s * (zy - ay), p0 - p0 / s * p0, p1 - p0 / s * p1, p2 - p1 / s * p1
        FROM (SELECT f.source_id, f.record_number, f.x AS zx, f.y AS zy, mx + 30 * mvx AS ax, my + 30 * mvy AS ay, mvx, mvy, c0 + 60 * c1 + 900 * c2 + 6.25e-4 * 450 * 450 AS p0, c1 + 30 * c2 + 6.25e-4 * 450 * 30 AS p1,
            c2 + 6.25e-4 * 900 AS p2, c0 + 60 * c1 + 900 * c2 + 6.25e-4 * 450 * 450 + 100 AS s FROM kf JOIN fixes f ON f.source_id = kf.source_id AND f.record_number = kf.record_number + 1))
        SELECT source_id, record_number, round(mx, 4) + 0.0 AS x, round(mvx, 4) + 0.0 AS vx, round(my, 4) + 0.0 AS y, round(mvy, 4) + 0.0 AS vy, round(c0, 4) + 0.0 AS c00, round(c1, 4) + 0.0 AS c01, round(c2, 4) + 0.0 AS c11 FROM kf""",
    "obs_loglik": f"""{_with(_FIXES)}, told AS (SELECT *, x - (prev_x + 30 * lag(vx) OVER w) AS ex, y - (prev_y + 30 * lag(vy) OVER w) AS ey, {_P00} + 100 AS s FROM fixes WINDOW w AS (PARTITION BY source_id ORDER BY record_number))
        SELECT source_id, record_number, round(-ln(2 * pi()) - ln(s) - 0.5 * (ex * ex + ey * ey) / s, 4) + 0.0 AS loglik FROM told WHERE record_number > 0""",
    "edge_predictive": f"""{_with(*_FGN)}, prior AS (SELECT source_id, record_number, edge_id, along + abs(vx) AS d, abs(vx) AS v, {_P00} AS p0, {_P01} AS p1, {_P11} AS p2, start_dist, seg_len, {_P00} + seg_len * seg_len / 12 AS s FROM snapped)
        SELECT source_id, record_number, edge_id, round(d + p0 / s * (start_dist + seg_len / 2 - d), 4) + 0.0 AS d, round(greatest(0, v + p0 / s * (start_dist + seg_len / 2 - d) / 30), 4) + 0.0 AS v,
        round(p0 - p0 * p0 / s, 4) + 0.0 AS c00, round(p1 - p0 * p1 / s, 4) + 0.0 AS c01, round(p2 - p1 * p1 / s, 4) + 0.0 AS c11 FROM prior""",
    "transition_counts": f"{_with(*_FGN, _ON_OFF, _COUNTS)} SELECT * FROM counted",
    "dirichlet_mean": f"{_with(*_FGN, _ON_OFF, _COUNTS)} SELECT source_id, round((95.0::DOUBLE + on_on) / (100 + on_on + on_off), 4) + 0.0 AS p_on_on, round((5.0::DOUBLE + off_off) / (100 + off_off + off_on), 4) + 0.0 AS p_off_off FROM counted",
    "uturn_logprob": f"""{_with(*_FGN, _TURN)} SELECT source_id, record_number, round(CASE WHEN p_edge IS NULL THEN 0 WHEN p_edge = edge_id AND p_seg = seg_idx THEN ln(0.9)
        WHEN c > 0 AND least(p_len, edge_len) * sqrt(greatest(0, 1 - c * c)) < 15 AND p_edge <> edge_id THEN ln(0.1) ELSE ln(0.9) END, 4) + 0.0 AS logprob FROM angles""",
    "inverse_gamma_running": f"""{_with(*_FGN)}, run AS (SELECT source_id, record_number, 20 + 0.5 * count(*) OVER w AS a, 1900 + 0.5 * sum(dist * dist) OVER w AS b FROM snapped WINDOW w AS (PARTITION BY source_id ORDER BY record_number ROWS UNBOUNDED PRECEDING))
        SELECT source_id, record_number, a::DOUBLE AS ig_shape, round(b, 6) AS ig_scale, round(b / (a - 1), 9) AS ig_mean FROM run""",
    "mixture_normalise": f"{_with(*_FGN, _WEIGHTED)} SELECT source_id, record_number, edge_id, seg_idx, {_r('log_total', 'weight')} FROM weighted",
    "ess_by_fix": f"{_with(*_FGN, _WEIGHTED)} SELECT source_id, record_number, round(1 / sum(weight * weight), 4) + 0.0 AS ess, count(*) AS n FROM weighted GROUP BY source_id, record_number",
    "best_state": f"""{_with(*_FGN, _WEIGHTED)} SELECT source_id, record_number, edge_id, seg_idx, round(round(log_w, 6), 4) + 0.0 AS log_w FROM (SELECT *, row_number() OVER (PARTITION BY source_id, record_number
        ORDER BY round(log_w, 6) DESC, edge_id, seg_idx) AS r FROM weighted) WHERE r = 1""",
    "edge_weights": f"{_with(*_FGN, _WEIGHTED)} SELECT edge_id, round(sum(weight), 4) + 0.0 AS weight, count(*) AS n FROM weighted GROUP BY edge_id",
    "rmse": f"{_with(*_FGN)} SELECT source_id, round(sqrt(avg(dist * dist)), 4) + 0.0 AS rmse, count(*) AS n FROM snapped GROUP BY source_id",
    "onoff_agreement": f"{_with(*_FGN, _ON_OFF)} SELECT source_id, round(avg(CASE WHEN (edge_id IS NOT NULL) = (value % 2 < 1) THEN 1.0::DOUBLE ELSE 0 END), 4) + 0.0 AS agreement, count(*) AS n FROM onoff GROUP BY source_id",
    "distance_summary": f"""{_with(*_FGN)} SELECT CAST(way AS INTEGER) AS way, round(min(dist), 4) + 0.0 AS least, round(quantile_cont(dist, 0.25), 4) + 0.0 AS q1, round(quantile_cont(dist, 0.5), 4) + 0.0 AS median,
        round(quantile_cont(dist, 0.75), 4) + 0.0 AS q3, round(max(dist), 4) + 0.0 AS most, round(avg(dist), 4) + 0.0 AS mean, round(stddev_samp(dist), 4) + 0.0 AS sd FROM snapped GROUP BY way""",
    "error_statistics": f"""{_with(*_FGN)}, e AS (SELECT source_id, x - snap_x AS ex, y - snap_y AS ey FROM snapped) SELECT source_id, round(avg(ex), 4) + 0.0 AS mean_x, round(avg(ey), 4) + 0.0 AS mean_y,
        round(covar_samp(ex, ex), 4) + 0.0 AS cxx, round(covar_samp(ex, ey), 4) + 0.0 AS cxy, round(covar_samp(ey, ey), 4) + 0.0 AS cyy FROM e GROUP BY source_id""",
    "state_json": f"""{_with(*_FGN, _ON_OFF)}, said AS (SELECT *, printf('%.4f', round(x, 4) + 0.0) AS tx, printf('%.4f', round(y, 4) + 0.0) AS ty, printf('%.4f', round(vx, 4) + 0.0) AS tvx, printf('%.4f', round(vy, 4) + 0.0) AS tvy FROM onoff)
        SELECT source_id, record_number, '{{"meanLocation":[' || tx || ',' || ty || '],"state":{{"state":[' || CASE WHEN edge_id IS NOT NULL THEN printf('%.4f', round(dist, 4) + 0.0) || ',' || tvx ELSE tx || ',' || tvx || ',' || ty || ',' || tvy END
        || '],"stateLoc":[' || tx || ',' || ty || '],"path":null}}}}' AS json FROM said""",
    "csv_roundtrip": f"""{_with(_FIXES)} SELECT 'veh' || source_id AS source_id, count(*) AS n, CAST(count(*) - 1 AS INTEGER) AS last, round(sum(40.7::DOUBLE + y / 111000), 3) AS lat, round(sum(x / 111000 - 74), 3) AS lon FROM fixes GROUP BY source_id""",
    "mixture_mean": f"""{_with(*_FGN, _WEIGHTED)}, per_edge AS (SELECT source_id, record_number, edge_id, sum(weight) AS edge_weight, sum(weight * (start_dist + t)) / sum(weight) AS mean FROM weighted GROUP BY ALL)
        SELECT source_id, record_number, edge_id, round(edge_weight, 4) + 0.0 AS edge_weight, round(mean, 4) + 0.0 AS mean FROM (SELECT *, row_number() OVER (PARTITION BY source_id, record_number ORDER BY round(edge_weight, 6) DESC, edge_id) AS r FROM per_edge) WHERE r = 1""",
    "truncated_density": f"""{_with(*_FGN)}, law AS (SELECT source_id, record_number, along, vx, 50 + vx AS m FROM snapped),
        first AS (SELECT *, {_integral("exp(-0.5 * (z - m) * (z - m) / 100)", "0::DOUBLE", "80::DOUBLE")} AS mass, {_integral("z * exp(-0.5 * (z - m) * (z - m) / 100)", "0::DOUBLE", "80::DOUBLE")} AS moment FROM law),
        second AS (SELECT *, moment / mass AS c FROM first),
        third AS (SELECT *, {_integral("(z - c) * (z - c) * exp(-0.5 * (z - m) * (z - m) / 100)", "0::DOUBLE", "80::DOUBLE")} / mass AS variance FROM second)
        SELECT source_id, record_number, CASE WHEN along <= 80 THEN round(-0.5 * (ln(2 * pi()) + ln(variance) + (along - c) ** 2 / variance), 4) + 0.0 END AS log_density,
        round(greatest(0, abs(vx) + (along - 50) / 30), 4) + 0.0 AS v FROM third""",
    "routes": f"""{_with(*_FGN)}, ends AS (SELECT s.source_id, s.record_number, lag(e.to_node) OVER (PARTITION BY s.source_id ORDER BY s.record_number) AS node, e.from_node AS other FROM snapped s JOIN edges e USING (edge_id))
        SELECT source_id, record_number, node, other, CAST(abs(node // 11 - other // 11) + abs(node % 11 - other % 11) AS INTEGER) AS n_edges, 100.0::DOUBLE * (abs(node // 11 - other // 11) + abs(node % 11 - other % 11)) AS length FROM ends WHERE node IS NOT NULL""",
    "merged_streets": f"""{_with(_GRID)} SELECT a.edge_id, b.edge_id AS out_edge_id, CASE WHEN b.to_node = a.from_node THEN 3 ELSE 5 END AS n_points, CASE WHEN b.to_node = a.from_node THEN 100.0::DOUBLE ELSE 200 END AS length, b.to_node = a.from_node AS reversed
        FROM edges a JOIN edges b ON a.to_node = b.from_node""",
    "longest_paths": f"{_with(_GRID, _WALK, recursive=True)} SELECT path FROM walk WHERE path_len >= 250",
    "transition_domain": f"""{_with(*_FGN, _ON_OFF, recursive=True)}, far AS (SELECT edge_id AS start_edge, to_node AS node, edge_id AS last, 100 AS len FROM edges
            UNION ALL SELECT f.start_edge, e.to_node, e.edge_id, f.len + 100 FROM far f JOIN edges e ON e.from_node = f.node WHERE f.len < 150)
        SELECT o.source_id, o.record_number, f.last AS next_edge FROM onoff o JOIN (SELECT DISTINCT start_edge, last FROM far WHERE len >= 150) f ON o.edge_id = f.start_edge
        UNION ALL SELECT DISTINCT n.source_id, n.record_number, n.edge_id FROM near n JOIN onoff o ON n.source_id = o.source_id AND n.record_number = o.record_number WHERE o.edge_id IS NULL
        UNION ALL SELECT source_id, record_number, NULL FROM onoff""",
    "likely_moves": f"""{_with(*_FGN, _ON_OFF, _COUNTS)}, p AS (SELECT source_id, (95.0::DOUBLE + on_on) / (100 + on_on + on_off) AS p_on, (5.0::DOUBLE + off_off) / (100 + off_off + off_on) AS p_off FROM counted),
        s AS (SELECT o.source_id, o.record_number, o.edge_id IS NULL AS off, CASE WHEN o.edge_id IS NULL THEN p_off ELSE p_on END AS stay FROM onoff o JOIN p USING (source_id))
        SELECT source_id, record_number, CASE WHEN off THEN stay < 0.5 ELSE stay >= 0.5 END AS next_on_road, round(greatest(stay, 1 - stay), 4) + 0.0 AS p_next FROM s""",
}
