"""SQL of the terrain queries."""

_MERCATOR = "radians({lon}) * 6378137.0 AS x, 6378137.0 * ln(tan(pi() / 4 + radians({lat}) / 2)) AS y"
_COMPUTED = f"pc AS (SELECT * EXCLUDE (loaded_at), {_MERCATOR.format(lon='lon', lat='lat')} FROM peaks_computed QUALIFY row_number() OVER (PARTITION BY peak_id) = 1)"
_CORRIDOR = f"pk AS (SELECT * EXCLUDE (loaded_at), {_MERCATOR.format(lon='lon', lat='lat')} FROM peaks_corridor QUALIFY row_number() OVER (PARTITION BY peak_id) = 1)"
_FEATURES = f"op AS (SELECT osm_id, name, {_MERCATOR.format(lon='geometry.x', lat='geometry.y')} FROM osm_peaks QUALIFY row_number() OVER (PARTITION BY osm_id) = 1)"
_ROUTE = """rt AS (SELECT osm_id, geom_type, ref, parts FROM (SELECT * FROM osm_ways QUALIFY row_number() OVER (PARTITION BY osm_id) = 1)
  WHERE tags['highway'] IN ('motorway', 'motorway_link', 'trunk') AND geom_type IN ('LineString', 'MultiLineString')
    AND coalesce(len(list_filter(string_split(ref, ';'), lambda v: contains(v, '90') AND contains(upper(v), 'I'))) > 0, false))"""
_SEGMENTS = """pt AS (SELECT osm_id, p.part - 1 AS part, p.pts FROM rt, (SELECT unnest(range(1, len(parts) + 1)) AS part, unnest(parts) AS pts) p WHERE len(p.pts) >= 2),
sd AS (SELECT osm_id, part, i - 1 AS seg, pts[i] AS a, pts[i + 1] AS b FROM (SELECT osm_id, part, pts, unnest(range(1, len(pts))) AS i FROM pt)),
sg AS (SELECT osm_id, part, seg, radians(a.x) * 6378137.0 AS x0, 6378137.0 * ln(tan(pi() / 4 + radians(a.y) / 2)) AS y0, radians(b.x) * 6378137.0 AS x1, 6378137.0 * ln(tan(pi() / 4 + radians(b.y) / 2)) AS y1 FROM sd)"""
_RASTER = """g AS (SELECT max(vec_id) + 1 AS nrows FROM embeddings),
r AS MATERIALIZED (SELECT vec_id AS row, i - 1 AS col, vec_id * 64 + i - 1 AS cell, CAST(floor(CAST(embedding[i] AS DOUBLE) * 1000) AS BIGINT) AS z FROM embeddings, range(1, 65) t(i))"""
_LINE = "ln AS (SELECT * FROM (SELECT n_nationkey AS k, n_nationkey * 37 % 64 + 0.5::DOUBLE AS x0, n_nationkey * 19 + 0.5::DOUBLE AS y0, lead(n_nationkey * 37 % 64 + 0.5::DOUBLE) OVER (ORDER BY n_nationkey) AS x1, lead(n_nationkey * 19 + 0.5::DOUBLE) OVER (ORDER BY n_nationkey) AS y1 FROM nation) WHERE x1 IS NOT NULL)"
_CELLS = """tt AS (SELECT *, list_sort(list_distinct(list_concat([0.0::DOUBLE, 1.0::DOUBLE],
    CASE WHEN x0 <> x1 THEN list_transform(range(ceil(least(x0, x1))::BIGINT, floor(greatest(x0, x1))::BIGINT + 1), lambda q: (q - x0) / (x1 - x0)) ELSE [] END,
    CASE WHEN y0 <> y1 THEN list_transform(range(ceil(least(y0, y1))::BIGINT, floor(greatest(y0, y1))::BIGINT + 1), lambda q: (q - y0) / (y1 - y0)) ELSE [] END))) AS t FROM ln),
mm AS (SELECT k, x0, y0, x1, y1, unnest(list_concat([0.0::DOUBLE, 1.0::DOUBLE], list_transform(range(1, len(t)), lambda i: (t[i] + t[i + 1]) / 2))) AS t FROM tt),
lc AS (SELECT DISTINCT CAST(k AS BIGINT) AS k, CAST(floor(y0 + (y1 - y0) * t) AS INTEGER) AS row, CAST(floor(x0 + (x1 - x0) * t) AS INTEGER) AS col FROM mm),
seed AS (SELECT DISTINCT row * 64 + col AS cell FROM lc, g WHERE row BETWEEN 0 AND nrows - 1 AND col BETWEEN 0 AND 63)"""
_POINTS = "pp AS (SELECT c_custkey AS peak_id, c_custkey * 7 % nrows AS row, c_custkey * 13 % 64 AS col FROM customer, g)"
_NAMES = f"""{_COMPUTED}, {_FEATURES}, nm AS (SELECT pc.peak_id, op.name, row_number() OVER (PARTITION BY pc.peak_id ORDER BY sqrt((pc.x - op.x) ** 2 + (pc.y - op.y) ** 2), op.osm_id) AS n FROM pc JOIN op
  ON op.x BETWEEN pc.x - 200 AND pc.x + 200 AND op.y BETWEEN pc.y - 200 AND pc.y + 200 WHERE op.name IS NOT NULL AND sqrt((pc.x - op.x) ** 2 + (pc.y - op.y) ** 2) <= 200),
pn AS (SELECT pc.*, coalesce(nm.name, '') AS name, pc.peak_id % 3 = 0 AS frontrow FROM pc LEFT JOIN nm ON nm.peak_id = pc.peak_id AND nm.n = 1)"""
_W = "CAST(CAST(round_even({0}, 0) AS BIGINT) AS VARCHAR)"
_D8 = """dn AS (SELECT r.cell, o, CASE WHEN r.row + dr BETWEEN 0 AND nrows - 1 AND r.col + dc BETWEEN 0 AND 63 THEN n.cell ELSE r.cell END AS to_cell,
    CASE WHEN r.row + dr BETWEEN 0 AND nrows - 1 AND r.col + dc BETWEEN 0 AND 63 THEN (r.z - n.z) / d ELSE 'inf'::DOUBLE END AS drop
  FROM r CROSS JOIN g CROSS JOIN (VALUES (0, -1, 0, 1.0::DOUBLE), (1, 1, 0, 1.0), (2, 0, -1, 1.0), (3, 0, 1, 1.0), (4, -1, -1, 1.41421356), (5, -1, 1, 1.41421356), (6, 1, -1, 1.41421356), (7, 1, 1, 1.41421356)) s(o, dr, dc, d)
  LEFT JOIN r n ON n.cell = CASE WHEN r.col + dc BETWEEN 0 AND 63 THEN (r.row + dr) * 64 + r.col + dc END),
rec AS (SELECT r.cell, coalesce(b.to_cell, r.cell) AS receiver FROM r LEFT JOIN (SELECT cell, to_cell FROM dn WHERE drop > 0 QUALIFY row_number() OVER (PARTITION BY cell ORDER BY drop DESC, o) = 1) b USING (cell))"""
_CATCH = """ca(cell) AS (SELECT cell FROM seed UNION SELECT rec.cell FROM rec JOIN ca ON rec.receiver = ca.cell)"""


def _maxima(steps: str) -> str:
    return f"""WITH {_RASTER} SELECT r.cell, r.z AS elev FROM r CROSS JOIN (VALUES {steps}) s(dr, dc) LEFT JOIN r n ON n.row = r.row + dr AND n.col = r.col + dc
GROUP BY r.cell, r.z HAVING bool_and(n.cell IS NULL OR (r.z, r.cell) > (n.z, n.cell))"""


def _marks(step: str, seeds: str = "seed", near: str = "(n.row = r.row AND abs(n.col - r.col) = 1) OR (n.col = r.col AND abs(n.row - r.row) = 1)") -> str:
    """CTEs up to m(cell, h): the least height that a path from the seeds must climb to."""
    return f"""WITH RECURSIVE {_RASTER}, {_LINE}, {_CELLS}, {_POINTS},
rim AS (SELECT cell FROM r, g WHERE row IN (0, nrows - 1) OR col IN (0, 63)),
e AS (SELECT r.cell AS a, n.cell AS b, n.z FROM r JOIN r n ON {near}),
m(cell, h) USING KEY (cell) AS (SELECT r.cell, r.z FROM r JOIN {seeds} USING (cell)
  UNION SELECT e.b, min(greatest(m.h, e.z)) FROM m JOIN e ON e.a = m.cell LEFT JOIN recurring.m AS old ON old.cell = e.b WHERE {step} (old.h IS NULL OR greatest(m.h, e.z) < old.h) GROUP BY e.b),
sn AS (SELECT peak_id, r.cell, r.z FROM pp JOIN r ON r.row BETWEEN pp.row - 3 AND pp.row + 3 AND r.col BETWEEN pp.col - 3 AND pp.col + 3 QUALIFY row_number() OVER (PARTITION BY peak_id ORDER BY z DESC, r.row, r.col) = 1)
"""


def _reach(step: str) -> str:
    return _marks(step) + "SELECT cell, h AS mark FROM m"


#: Filled heights with the steps to where a flat drains, as one number v = height * 1000000 + steps; receivers over them; what drains to the line.
_FILLED = f"""WITH RECURSIVE {_RASTER}, {_LINE}, {_CELLS}, {_POINTS},
rim AS (SELECT cell FROM r, g WHERE row IN (0, nrows - 1) OR col IN (0, 63)),
s8(o, dr, dc, d) AS (VALUES (0, -1, 0, 1.0::DOUBLE), (1, 1, 0, 1.0), (2, 0, -1, 1.0), (3, 0, 1, 1.0), (4, -1, -1, 1.41421356), (5, -1, 1, 1.41421356), (6, 1, -1, 1.41421356), (7, 1, 1, 1.41421356)),
e AS MATERIALIZED (SELECT r.cell AS a, n.cell AS b, n.z FROM r CROSS JOIN s8 JOIN r n ON n.cell = CASE WHEN r.col + dc BETWEEN 0 AND 63 THEN (r.row + dr) * 64 + r.col + dc END),
m(cell, v) USING KEY (cell) AS (SELECT r.cell, r.z * 1000000 FROM r JOIN rim USING (cell)
  UNION SELECT e.b, min(CASE WHEN e.z > floor(m.v / 1000000) THEN e.z * 1000000 ELSE m.v + 1 END)::BIGINT FROM m JOIN e ON e.a = m.cell LEFT JOIN recurring.m AS old ON old.cell = e.b
  WHERE old.v IS NULL OR (CASE WHEN e.z > floor(m.v / 1000000) THEN e.z * 1000000 ELSE m.v + 1 END) < old.v GROUP BY e.b),
fl AS MATERIALIZED (SELECT r.cell, r.row, r.col, floor(v / 1000000) AS z, v - floor(v / 1000000) * 1000000 AS hops FROM m JOIN r USING (cell)),
dn AS (SELECT f.cell, o, CASE WHEN n.cell IS NULL THEN f.cell ELSE n.cell END AS to_cell, CASE WHEN n.cell IS NULL THEN 'inf'::DOUBLE ELSE (f.z - n.z) / d END AS drop, CASE WHEN f.z = n.z THEN (f.hops - n.hops) / d ELSE 0 END AS down
  FROM fl f CROSS JOIN s8 LEFT JOIN fl n ON n.cell = CASE WHEN f.col + dc BETWEEN 0 AND 63 THEN (f.row + dr) * 64 + f.col + dc END),
rec AS MATERIALIZED (SELECT cell, to_cell AS receiver FROM dn WHERE drop > 0 OR (drop = 0 AND down > 0) QUALIFY row_number() OVER (PARTITION BY cell ORDER BY drop DESC, down DESC, o) = 1),
ca(cell) AS (SELECT cell FROM seed UNION SELECT rec.cell FROM rec JOIN ca ON rec.receiver = ca.cell),
sn AS (SELECT peak_id, r.row, r.col FROM pp JOIN r ON r.row BETWEEN pp.row - 3 AND pp.row + 3 AND r.col BETWEEN pp.col - 3 AND pp.col + 3 QUALIFY row_number() OVER (PARTITION BY peak_id ORDER BY z DESC, r.row, r.col) = 1)
"""

#: The chosen profile of each point: the shortest clear one among those from its 30 nearest stations on the line, else that of the nearest.
_CHOSEN = f"""WITH {_RASTER}, {_LINE}, {_POINTS},
le AS (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len FROM ln), lc AS (SELECT *, sum(len) OVER (ORDER BY k) AS upto, lead(k) OVER (ORDER BY k) IS NULL AS last FROM le),
st AS (SELECT CAST(k * 100000 + floor(d * 10) AS BIGINT) AS cand_id, x, y FROM (
  SELECT k, q * 5.0::DOUBLE AS d, x0 + (x1 - x0) * ((q * 5.0::DOUBLE - (upto - len)) / len) AS x, y0 + (y1 - y0) * ((q * 5.0::DOUBLE - (upto - len)) / len) AS y
  FROM (SELECT *, unnest(range(ceil((upto - len) / 5)::BIGINT, ceil(upto / 5)::BIGINT)) AS q FROM lc WHERE len > 0) UNION ALL SELECT k, upto, x1, y1 FROM lc WHERE last)),
sn AS (SELECT pp.peak_id, pp.col + 0.5::DOUBLE AS px, pp.row + 0.5::DOUBLE AS py, r.col + 0.5::DOUBLE AS sx, r.row + 0.5::DOUBLE AS sy FROM pp JOIN r ON r.row BETWEEN pp.row - 3 AND pp.row + 3 AND r.col BETWEEN pp.col - 3 AND pp.col + 3
  QUALIFY row_number() OVER (PARTITION BY peak_id ORDER BY z DESC, r.row, r.col) = 1),
nn AS (SELECT peak_id, sx, sy, x AS hx, y AS hy, row_number() OVER (PARTITION BY peak_id ORDER BY sqrt((px - x) ** 2 + (py - y) ** 2), cand_id) - 1 AS rank FROM sn, st QUALIFY rank < 30),
np AS (SELECT *, greatest(2, CAST(floor(sqrt((sx - hx) ** 2 + (sy - hy) ** 2)) AS BIGINT) + 1) AS n, sqrt((sx - hx) ** 2 + (sy - hy) ** 2) AS length FROM nn),
sm AS (SELECT peak_id, rank, length, i, r.z FROM (SELECT *, unnest(range(0, n)) AS i FROM np), g,
  r WHERE r.cell = greatest(0, least(nrows - 1, CAST(trunc(CASE WHEN i = n - 1 THEN sy ELSE hy + i * ((sy - hy) / (n - 1)) END) AS BIGINT))) * 64 + greatest(0, least(63, CAST(trunc(CASE WHEN i = n - 1 THEN sx ELSE hx + i * ((sx - hx) / (n - 1)) END) AS BIGINT)))),
lo AS (SELECT *, first_value(i) OVER (PARTITION BY peak_id, rank ORDER BY z, i) AS lo FROM sm),
fa AS (SELECT *, max(z) OVER (PARTITION BY peak_id, rank ORDER BY i ROWS UNBOUNDED PRECEDING) - z AS fall FROM lo WHERE i >= lo),
pr AS (SELECT peak_id, rank, any_value(length) AS length, any_value(lo) AS lo, max(fall) >= 150 AS blocked, arg_max(i, (fall, -i)) AS place FROM fa GROUP BY peak_id, rank),
ch AS (SELECT peak_id, rank, NOT blocked AS frontrow, blocked, lo, CASE WHEN blocked THEN place ELSE -1 END AS barrier FROM pr QUALIFY row_number() OVER (PARTITION BY peak_id ORDER BY blocked, CASE WHEN blocked THEN 0 ELSE length END, rank) = 1)
"""

_FOUR = "(-1, 0), (1, 0), (0, -1), (0, 1)"
_EIGHT = _FOUR + ", (-1, -1), (-1, 1), (1, -1), (1, 1)"
_PARSE = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

_SERIES = """lo AS (SELECT *, first_value(i) OVER (PARTITION BY user_id ORDER BY z NULLS LAST, i) AS lo FROM s),
hi AS (SELECT *, max(CASE WHEN i >= lo THEN z END) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS high FROM lo),
fa AS (SELECT *, CASE WHEN i >= lo THEN coalesce(high - z, 0) END AS fall FROM hi)
SELECT user_id, count(*) AS n, count(z) < 2 OR max(fall) >= 76.2 AS blocked, CASE WHEN count(z) < 2 THEN 0 ELSE min(lo) END AS lo,
  CASE WHEN count(z) < 2 OR max(fall) < 76.2 THEN -1 ELSE arg_max(i, (fall, -i)) FILTER (fall IS NOT NULL) END AS barrier FROM fa GROUP BY user_id"""

SQL = {
    "profile_barrier": f"WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS z FROM events), {_SERIES}",
    "profile_barrier_array": f"""WITH q AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS c, value AS z FROM events),
k AS (SELECT DISTINCT user_id, c, CASE WHEN c <= 80 THEN j WHEN j = 79 THEN c - 1 ELSE CAST(trunc(j * ((c - 1) / 79.0::DOUBLE)) AS BIGINT) END AS i, j FROM q, range(0, 1000) t(j) WHERE j < least(c, CASE WHEN c <= 80 THEN c ELSE 80 END)),
s AS (SELECT k.user_id, k.j AS i, q.z FROM k JOIN q ON q.user_id = k.user_id AND q.i = k.i), {_SERIES}""",
    "terrarium_decode": """WITH t AS (SELECT p_partkey, CAST((120 + p_partkey % 36) * 256 + p_partkey * 7 % 256 + (p_partkey * 13 % 256) / 256.0::DOUBLE - 32768 AS FLOAT)::DOUBLE AS elev FROM part)
SELECT p_partkey, elev, CASE WHEN elev <= 4500 AND elev <> -32768 THEN elev END AS masked FROM t""",
    "mask_counts": """WITH t AS (SELECT CAST((120 + p_partkey % 36) * 256 + p_partkey * 7 % 256 + (p_partkey * 13 % 256) / 256.0::DOUBLE - 32768 AS FLOAT)::DOUBLE AS elev FROM part)
SELECT count(*) AS cells, count(*) FILTER (elev > 4500) AS implausible, count(*) FILTER (elev <= 4500 AND elev <> -32768) AS valid, min(elev) FILTER (elev <= 4500 AND elev <> -32768) AS lowest FROM t""",
    "corridor_tiles": """WITH c AS (SELECT z, CAST(pow(2, z) AS BIGINT) AS n FROM range(9, 13) t(z)),
b AS (SELECT z, CAST(floor((-122.40 / 360 + 0.5) * n) AS INTEGER) AS x0, CAST(floor(((-119.80 - 1e-11) / 360 + 0.5) * n) AS INTEGER) AS x1,
  CAST(floor((0.5 - ln((1 + sin(radians(47.75))) / (1 - sin(radians(47.75)))) / (4 * pi())) * n) AS INTEGER) AS y0,
  CAST(floor((0.5 - ln((1 + sin(radians(46.75 + 1e-11))) / (1 - sin(radians(46.75 + 1e-11)))) / (4 * pi())) * n) AS INTEGER) AS y1 FROM c)
SELECT CAST(z AS INTEGER) AS z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM b, range(0, 4096) tx(x), range(0, 4096) ty(y) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1""",
    "mosaic_cells": "SELECT CAST(vec_id * 8 + (i - 1) // 8 AS INTEGER) AS row, count(*) AS cells, CAST(sum(floor(CAST(embedding[i] AS DOUBLE) * 1000)) AS BIGINT) AS total FROM embeddings, range(1, 65) t(i) GROUP BY 1",
    "mercator": f"""WITH {_COMPUTED}, c AS (SELECT 2 * pi() * 6378137.0 / 4096 / 256 AS s), o AS (SELECT s, 655 * 256 * s - pi() * 6378137.0 AS x0, pi() * 6378137.0 - 1428 * 256 * s AS y0 FROM c)
SELECT peak_id, CAST(round(x, 0) AS BIGINT) AS x, CAST(round(y, 0) AS BIGINT) AS y, CAST(greatest(0, least(4351, floor((y0 - y) / s))) AS INTEGER) AS row, CAST(greatest(0, least(7679, floor((x - x0) / s))) AS INTEGER) AS col,
  round_even(degrees(x / 6378137.0), 6) AS lon, round_even(degrees(2 * atan(exp(y / 6378137.0)) - pi() / 2), 6) AS lat FROM pc, o""",
    "parse_list": f"""WITH f AS (SELECT line_id, string_split(raw_line, ',') AS f FROM kirmse_raw), n AS (SELECT line_id, list_transform(f[1:6], lambda v: CASE WHEN regexp_matches(v, '{_PARSE}') THEN try_cast(regexp_replace(v, '\\s', '', 'g') AS DOUBLE) END) AS v FROM f WHERE len(f) >= 6)
SELECT line_id, v[1] AS lat, v[2] AS lon, v[3] AS elev_ft, v[4] AS ksaddle_lat, v[5] AS ksaddle_lon, v[6] AS prom_ft FROM n WHERE len(list_filter(v, lambda q: q IS NULL)) = 0 AND v[6] >= 250 AND v[1] BETWEEN 46.75 AND 47.75 AND v[2] BETWEEN -122.40 AND -119.80""",
    "bbox_filter": "SELECT DISTINCT peak_id, lat, lon, prom_ft FROM peaks_corridor WHERE prom_ft >= 250 AND lat BETWEEN 46.75 AND 47.75 AND lon BETWEEN -122.40 AND -119.80",
    "route_filter": f"WITH {_ROUTE} SELECT osm_id, geom_type, ref FROM rt",
    "route_dissolved": f"""WITH {_ROUTE}, {_SEGMENTS}, u AS (SELECT DISTINCT CASE WHEN (a.x, a.y) < (b.x, b.y) THEN [a.x, a.y, b.x, b.y] ELSE [b.x, b.y, a.x, a.y] END AS s FROM sd)
SELECT 'I 90' AS name, count(*) AS segments, min(least(s[1], s[3])) AS west, max(greatest(s[1], s[3])) AS east FROM u""",
    "local_maxima_4": _maxima(_FOUR),
    "local_maxima_8": _maxima(_EIGHT),
    "snap_summit": f"""WITH {_RASTER}, {_POINTS} SELECT peak_id, CAST(r.row AS INTEGER) AS row, CAST(r.col AS INTEGER) AS col, z AS elev FROM pp JOIN r ON r.row BETWEEN pp.row - 3 AND pp.row + 3 AND r.col BETWEEN pp.col - 3 AND pp.col + 3
QUALIFY row_number() OVER (PARTITION BY peak_id ORDER BY z DESC, r.row, r.col) = 1""",
    "reach_mark": _reach("e.z >= m.h - 150 AND"),
    "ceiling_mark": _reach(""),
    "fill_depressions": _marks("", "rim", "abs(n.row - r.row) <= 1 AND abs(n.col - r.col) <= 1 AND n.cell <> r.cell") + "SELECT cell, h AS elev FROM m",
    "classify_ascent": _marks("e.z >= m.h - 150 AND") + "SELECT peak_id, CAST(z AS FLOAT) AS summit_elev_m, h IS NOT NULL AS frontrow, CAST(h - z AS DOUBLE) AS approach_crest_above_m FROM sn LEFT JOIN m USING (cell)",
    "classify_ceiling": _marks("") + "SELECT peak_id, CAST(z AS FLOAT) AS summit_elev_m, CAST(h - z AS DOUBLE) AS barrier_above_m, coalesce(h - z <= 0, false) AS frontrow FROM sn LEFT JOIN m USING (cell)",
    "d8_receivers": f"WITH {_RASTER}, {_D8} SELECT cell, receiver FROM rec",
    "catchment": f"WITH RECURSIVE {_RASTER}, {_LINE}, {_CELLS}, {_D8}, {_CATCH} SELECT cell FROM ca",
    "catchment_filled": _FILLED + "SELECT cell FROM ca",
    "classify_drainage": _FILLED + """SELECT peak_id, count(ca.cell) AS n_in, count(*) - count(ca.cell) AS n_out, count(ca.cell) > 0 AS drains, count(ca.cell) > 0 AND count(ca.cell) < count(*) AS on_divide, count(ca.cell) > 0 AS frontrow
FROM sn JOIN r ON r.row BETWEEN sn.row - 5 AND sn.row + 5 AND r.col BETWEEN sn.col - 5 AND sn.col + 5 LEFT JOIN ca ON ca.cell = r.cell GROUP BY peak_id""",
    "profile_choice": _CHOSEN + "SELECT peak_id, frontrow, rank, blocked, lo, barrier FROM ch",
    "profile_counts": _CHOSEN + "SELECT count(*) AS peaks, count(*) FILTER (frontrow) AS front, count(*) FILTER (NOT frontrow) AS behind FROM ch",
    "divide_test": f"""WITH RECURSIVE {_RASTER}, {_LINE}, {_CELLS}, {_D8}, {_CATCH}, {_POINTS}
SELECT peak_id, count(ca.cell) AS n_in, count(*) - count(ca.cell) AS n_out, count(ca.cell) > 0 AS drains, count(ca.cell) > 0 AND count(ca.cell) < count(*) AS on_divide
FROM pp JOIN r ON r.row BETWEEN pp.row - 5 AND pp.row + 5 AND r.col BETWEEN pp.col - 5 AND pp.col + 5 LEFT JOIN ca ON ca.cell = r.cell GROUP BY peak_id""",
    "rasterize_line": f"WITH {_RASTER}, {_LINE}, {_CELLS} SELECT k, row, col FROM lc, g WHERE row BETWEEN 0 AND nrows - 1 AND col BETWEEN 0 AND 63",
    "route_stations": f"""WITH {_ROUTE}, {_SEGMENTS}, l AS (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len FROM sg), c AS (SELECT *, sum(len) OVER (PARTITION BY osm_id, part ORDER BY seg) AS upto, lead(seg) OVER (PARTITION BY osm_id, part ORDER BY seg) IS NULL AS last FROM l),
p AS (SELECT *, k * 200.0 AS d, (k * 200.0 - (upto - len)) / len AS t FROM (SELECT *, unnest(range(ceil((upto - len) / 200)::BIGINT, ceil(upto / 200)::BIGINT)) AS k FROM c WHERE len > 0))
SELECT osm_id, CAST(part AS INTEGER) AS part, CAST(seg AS INTEGER) AS seg, round(d, 2) AS d, CAST(round(x, 0) AS BIGINT) AS x, CAST(round(y, 0) AS BIGINT) AS y FROM (SELECT osm_id, part, seg, CAST(d AS DOUBLE) AS d, x0 + (x1 - x0) * t AS x, y0 + (y1 - y0) * t AS y FROM p UNION ALL SELECT osm_id, part, seg, upto, x1, y1 FROM c WHERE last)""",
    "profile_samples": f"""WITH {_RASTER}, {_POINTS}, n AS (SELECT peak_id, CAST(col + 0.5 AS DOUBLE) AS c1, CAST(row + 0.5 AS DOUBLE) AS r1, greatest(2, CAST(floor(sqrt((col + 0.5::DOUBLE - 0.5) ** 2 + (row + 0.5::DOUBLE - 0.5) ** 2)) AS BIGINT) + 1) AS n FROM pp),
s AS (SELECT peak_id, i, CASE WHEN i = n - 1 THEN c1 ELSE 0.5 + i * ((c1 - 0.5) / (n - 1)) END AS c, CASE WHEN i = n - 1 THEN r1 ELSE 0.5 + i * ((r1 - 0.5) / (n - 1)) END AS r FROM (SELECT *, unnest(range(0, n)) AS i FROM n))
SELECT peak_id, count(*) AS n, CAST(sum(z) AS BIGINT) AS total, CAST(sum(r.cell * i) AS BIGINT) AS weighted FROM s JOIN r ON r.cell = CAST(trunc(s.r) AS BIGINT) * 64 + CAST(trunc(s.c) AS BIGINT) GROUP BY peak_id""",
    "nearest_name": f"WITH {_NAMES} SELECT peak_id, name FROM pn",
    "cross_check": f"""WITH {_COMPUTED}, {_CORRIDOR}, rk AS (SELECT * FROM pk WHERE lat IS NOT NULL AND lon IS NOT NULL),
m AS (SELECT rk.prom_ft AS a, pc.prom_ft AS b, sqrt((rk.x - pc.x) ** 2 + (rk.y - pc.y) ** 2) AS d FROM rk JOIN pc ON pc.x BETWEEN rk.x - 300 AND rk.x + 300 AND pc.y BETWEEN rk.y - 300 AND rk.y + 300
  WHERE sqrt((rk.x - pc.x) ** 2 + (rk.y - pc.y) ** 2) <= 300 QUALIFY row_number() OVER (PARTITION BY rk.peak_id ORDER BY d, pc.peak_id) = 1),
n AS (SELECT count(*) AS k, median(d) AS e, median(b - a) AS pd, avg(abs(b - a)) AS ad FROM m), t AS (SELECT (SELECT count(*) FROM rk) AS r, (SELECT count(*) FROM pc) AS o)
SELECT r AS reference_peaks, o AS our_peaks, k AS matched, r - k AS unmatched, round(k / r, 4) AS match_rate, round(e, 4) AS median_pos_err_m, round(pd, 4) AS median_prom_diff_ft, round(ad, 4) AS mean_abs_prom_diff_ft FROM n, t""",
    "knn_30": f"""WITH {_CORRIDOR}, {_FEATURES} SELECT osm_id, row_number() OVER (PARTITION BY osm_id ORDER BY sqrt((pk.x - op.x) ** 2 + (pk.y - op.y) ** 2), peak_id) - 1 AS rank, peak_id
FROM op, pk WHERE op.x IS NOT NULL AND pk.x IS NOT NULL AND pk.y IS NOT NULL QUALIFY rank < 30""",
    "point_line_distance": f"""WITH {_COMPUTED}, {_ROUTE}, {_SEGMENTS}, q AS (SELECT DISTINCT x0, y0, x1 - x0 AS vx, y1 - y0 AS vy FROM sg),
t AS (SELECT peak_id, x - x0 AS qx, y - y0 AS qy, vx, vy, CASE WHEN vx * vx + vy * vy = 0 THEN 0 ELSE greatest(0, least(1, ((x - x0) * vx + (y - y0) * vy) / (vx * vx + vy * vy))) END AS t FROM pc, q)
SELECT peak_id, CAST(round(min(sqrt((qx - t * vx) ** 2 + (qy - t * vy) ** 2)), 0) AS BIGINT) AS distance FROM t GROUP BY peak_id""",
    "route_quantiles": f"""WITH {_COMPUTED}, {_ROUTE}, {_SEGMENTS}, q AS (SELECT DISTINCT x0, y0, x1 - x0 AS vx, y1 - y0 AS vy FROM sg),
t AS (SELECT peak_id, x - x0 AS qx, y - y0 AS qy, vx, vy, CASE WHEN vx * vx + vy * vy = 0 THEN 0 ELSE greatest(0, least(1, ((x - x0) * vx + (y - y0) * vy) / (vx * vx + vy * vy))) END AS t FROM pc, q),
d AS (SELECT peak_id, min(sqrt((qx - t * vx) ** 2 + (qy - t * vy) ** 2)) AS d FROM t GROUP BY peak_id)
SELECT round(quantile_cont(d, 0.5), 3) AS median, round(quantile_cont(d, 0.9), 3) AS p90, round(max(d), 3) AS largest FROM d""",
    "prominence_bands": f"""WITH {_COMPUTED}, b(lo, hi) AS (VALUES (250, 500), (500, 1000), (1000, 2000), (2000, 1000000000))
SELECT CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, count(peak_id) AS peaks FROM b LEFT JOIN pc ON prom_ft >= lo AND prom_ft < hi GROUP BY 1, 2""",
    "peak_counts": f"WITH {_COMPUTED} SELECT count(*) AS peaks, count(*) FILTER (NOT frame_limited) AS front, count(*) FILTER (frame_limited) AS behind FROM pc",
    "nearest_to_point": f"WITH {_COMPUTED} SELECT peak_id, lat, lon FROM pc ORDER BY sqrt((lat - 46.8529) ** 2 + (lon + 121.7604) ** 2), peak_id LIMIT 1",
    "top_peaks": f"WITH {_COMPUTED} SELECT peak_id, lat, lon, prom_ft FROM pc ORDER BY prom_ft DESC, peak_id LIMIT 12",
    "ranked_peaks": f"WITH {_CORRIDOR} SELECT list_code, peak_id, row_number() OVER (PARTITION BY list_code ORDER BY prom_ft DESC NULLS LAST, peak_id) - 1 AS place FROM pk",
    "labels": f"""WITH {_NAMES} SELECT peak_id, CASE WHEN name NOT IN ('', 'nan', 'None') THEN name ELSE {_W.format("elev_ft")} || 'ft pk (P' || {_W.format("prom_ft")} || ')' END AS label,
CASE WHEN frontrow THEN 'front' ELSE 'behind' END AS cls, round(greatest(3, least(11, 2 + sqrt(prom_ft) / 12)), 4) AS radius FROM pn""",
    "app_rows": f"""WITH {_NAMES} SELECT peak_id, round_even(lon, 6) AS lon, round_even(lat, 6) AS lat, CAST(round_even(elev_ft, 0) AS BIGINT) AS elev_ft, CAST(round_even(prom_ft, 0) AS BIGINT) AS prom_ft,
CASE WHEN frontrow THEN 'front' ELSE 'behind' END AS cls, name FROM pn""",
    "gpx_waypoints": f"""WITH {_NAMES}, w AS (SELECT *, 'elev ' || {_W.format("elev_ft")} || ' ft, prominence ' || {_W.format("prom_ft")} || ' ft' || CASE WHEN frontrow THEN '' ELSE ', occluded (+0 m barrier)' END AS note,
  replace(replace(replace(CASE WHEN name NOT IN ('', 'nan', 'None') THEN name ELSE {_W.format("elev_ft")} || 'ft pk (P' || {_W.format("prom_ft")} || ')' END, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS label FROM pn WHERE elev_ft IS NOT NULL)
SELECT peak_id, '<wpt lat="' || printf('%.6f', lat) || '" lon="' || printf('%.6f', lon) || '"><ele>' || printf('%.1f', round_even(elev_ft * 0.3048, 1)) || '</ele><name>' || label || '</name><cmt>' || note || '</cmt><desc>' || note || '</desc><sym>Summit</sym></wpt>' AS wpt FROM w""",
    "visible_waypoints": f"""WITH {_NAMES} SELECT peak_id, '<wpt lat="' || printf('%.6f', lat) || '" lon="' || printf('%.6f', lon) || '"><ele>' || printf('%.1f', round_even(round_even(elev_ft, 0) * 0.3048, 1)) || '</ele><name>'
  || replace(replace(CASE WHEN name <> '' THEN name ELSE {_W.format("elev_ft")} || 'ft pk' END, '&', '&amp;'), '<', '&lt;') || '</name><cmt>front, prominence ' || {_W.format("prom_ft")} || ' ft</cmt><sym>Summit</sym></wpt>' AS wpt
FROM pn WHERE prom_ft >= 500 AND frontrow AND elev_ft IS NOT NULL""",
    "unit_texts": f"WITH {_COMPUTED} SELECT peak_id, {_W.format('prom_m / 0.3048')} AS ft, printf('%.6f', lat) AS lat FROM pc",
}
