"""The same results in SQL, written apart from the DataFrame plans and run by another engine."""

from __future__ import annotations

from waymark.functions.geo import EARTH_M, GCJ_A, GCJ_BOUNDS, GCJ_EE, WGS84_A, WGS84_F, edges_of
from waymark.functions.regions import Region
from waymark.plans import queries as Q

PTS = """raw AS (SELECT event_id AS e, event_id // 60 AS t, event_id % 60 AS s FROM events),
pts AS (SELECT CAST(t AS BIGINT) AS track_id, CAST(s AS BIGINT) AS seq,
  make_timestamp(CAST((1704067200 + (t % 28) * 86400 + ((t * 7) % 24) * 3600 + s * 30 + CASE WHEN t % 9 = 4 AND s >= 30 THEN 400 ELSE 0 END) * 1000000 AS BIGINT)) AS ts,
  CAST(116300000 + (t % 4) * 4000 + ((t // 192) % 10) * 40000 + CASE WHEN s < 20 THEN (s - 20) * 400 WHEN s < 40 THEN ((e * 7) % 11) * 10 ELSE (s - 39) * 400 END + CASE WHEN e % 97 = 0 THEN 20000 ELSE 0 END AS DOUBLE) / 1000000.0::DOUBLE AS lon,
  CAST(39950000 + (t % 3) * 3000 + CASE WHEN s < 20 THEN 0 WHEN s < 40 THEN ((e * 5) % 13) * 8 ELSE (s - 39) * 250 END AS DOUBLE) / 1000000.0::DOUBLE AS lat,
  CASE WHEN t % 6 = 5 THEN 0.0::DOUBLE ELSE 40 + ((e * 13) % 50) / 10.0::DOUBLE END AS elevation_m FROM raw)"""


def iso(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"


def hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"(2 * {EARTH_M}::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))"


STEP = f"""step AS (SELECT *, lag(ts) OVER w AS ts0, CASE WHEN lag(ts) OVER w IS NOT NULL THEN {hav("lag(lon) OVER w", "lag(lat) OVER w", "lon", "lat")} END AS d FROM pts WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
spd AS (SELECT *, CASE WHEN epoch_ms(ts) > epoch_ms(ts0) THEN d / ((epoch_ms(ts) - epoch_ms(ts0)) / 1000.0::DOUBLE) END AS v FROM step),
thr AS (SELECT track_id, coalesce(greatest(8.0::DOUBLE, 3 * median(v) FILTER (WHERE v > 0)), 8.0::DOUBLE) AS threshold FROM spd GROUP BY track_id),
flag AS (SELECT s.*, coalesce(v > threshold, false) OR coalesce(lead(v) OVER (PARTITION BY s.track_id ORDER BY seq) > threshold, false) AS is_outlier FROM spd s JOIN thr USING (track_id)),
trk AS (SELECT track_id, 'track-' || track_id AS name, CASE track_id % 3 WHEN 0 THEN 'geolife' WHEN 1 THEN 'gpx' ELSE 'sample' END AS source, substr(sha256('track-' || track_id), 1, 32) AS external_id,
  min(ts) AS start_time, max(ts) AS end_time, CAST(epoch_ms(max(ts)) // 1000 - epoch_ms(min(ts)) // 1000 AS INTEGER) AS duration_s, count(*) AS point_count, sum(coalesce(d, 0)) AS distance_m FROM step GROUP BY track_id)"""

TRACK = f"track_id, name, source, {iso('start_time')} AS start_time, {iso('end_time')} AS end_time, duration_s, point_count, round(distance_m, 3) AS distance_m"
POINT = f"track_id, seq, {iso('ts')} AS recorded_at, lon, lat, elevation_m"
LOCAL = "CAST(hour(ts + INTERVAL 8 HOUR) AS INTEGER)"
CELL = f"CAST(round_even(lon / {Q.CELL}::DOUBLE, 0) AS INTEGER) AS nx, CAST(round_even(lat / {Q.CELL}::DOUBLE, 0) AS INTEGER) AS ny"
START, END = (f"TIMESTAMP '{w.rstrip('Z').replace('T', ' ')}'" for w in Q.WINDOW)


def box(b) -> str:
    return f"lon BETWEEN {b.west}::DOUBLE AND {b.east}::DOUBLE AND lat BETWEEN {b.south}::DOUBLE AND {b.north}::DOUBLE"


def dens(where: str = "true") -> str:
    return f"cel AS (SELECT {CELL}, count(*) AS points, count(DISTINCT track_id) AS tracks FROM pts WHERE {box(Q.BOX)} AND {where} GROUP BY 1, 2), den AS (SELECT nx * {Q.CELL}::DOUBLE AS lon, ny * {Q.CELL}::DOUBLE AS lat, points, tracks FROM cel)"


def density(metric: str, where: str = "true") -> str:
    return f"WITH {PTS}, {dens(where)} SELECT round(lon, 7) AS lon, round(lat, 7) AS lat, points, tracks, {metric} AS value FROM den"


NEAR = f"""near AS (SELECT a.track_id AS a_track, a.seq AS a_seq, b.track_id AS b_track, b.seq AS b_seq FROM pts a JOIN pts b ON {{pair}} AND b.lat BETWEEN a.lat - 0.001 AND a.lat + 0.001 AND b.lon BETWEEN a.lon - 0.001 AND a.lon + 0.001 AND {hav("a.lon", "a.lat", "b.lon", "b.lat")} <= {Q.TOLERANCE_M}),
hit AS (SELECT a_track, b_track, count(DISTINCT a_seq) AS a_hit, count(DISTINCT b_seq) AS b_hit FROM near GROUP BY ALL),
tot AS (SELECT track_id, count(*) AS n FROM pts GROUP BY 1),
sco AS (SELECT h.*, floor(least(100.0::DOUBLE, a_hit * 100.0::DOUBLE / a.n) * 10 + 0.5) / 10 AS forward, floor(least(100.0::DOUBLE, b_hit * 100.0::DOUBLE / b.n) * 10 + 0.5) / 10 AS reverse FROM hit h JOIN tot a ON a.track_id = a_track JOIN tot b ON b.track_id = b_track)"""
ONE = NEAR.format(pair=f"a.track_id = {Q.BASELINE} AND b.track_id <> {Q.BASELINE}")
ALL = NEAR.format(pair="a.track_id < b.track_id")

STAY = f"""gap AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seq) - 1 AS pos, epoch_ms(ts) AS ms FROM pts),
brk AS (SELECT *, coalesce((ms - lag(ms) OVER (PARTITION BY track_id ORDER BY pos)) // 1000 > 300, false) AS br FROM gap),
win AS (SELECT a.track_id, a.pos AS i, k.pos AS k, avg(m.lon ORDER BY m.pos) AS clon, avg(m.lat ORDER BY m.pos) AS clat, bool_or(m.br AND m.pos > a.pos) AS br FROM brk a JOIN brk k ON k.track_id = a.track_id AND k.pos >= a.pos JOIN brk m ON m.track_id = a.track_id AND m.pos BETWEEN a.pos AND k.pos GROUP BY 1, 2, 3),
rad AS (SELECT w.*, (SELECT NULL) AS x, r.rad FROM win w JOIN (SELECT w.track_id, w.i, w.k, max({hav("w.clon", "w.clat", "m.lon", "m.lat")}) AS rad FROM win w JOIN brk m ON m.track_id = w.track_id AND m.pos BETWEEN w.i AND w.k GROUP BY 1, 2, 3) r USING (track_id, i, k)),
bad AS (SELECT *, max(CASE WHEN br OR 2 * rad > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id, i ORDER BY k) AS bad FROM rad),
rea AS (SELECT track_id, i, max(k) AS j FROM bad WHERE bad = 0 OR k = i GROUP BY 1, 2),
nex AS (SELECT r.track_id, i, j, (j > i AND (b.ms - a.ms) // 1000 >= 300) AS hit FROM rea r JOIN brk a ON a.track_id = r.track_id AND a.pos = i JOIN brk b ON b.track_id = r.track_id AND b.pos = j),
walk AS (SELECT track_id, i, j, hit FROM nex WHERE i = 0 UNION ALL SELECT n.track_id, n.i, n.j, n.hit FROM walk w JOIN nex n ON n.track_id = w.track_id AND n.i = CASE WHEN w.hit THEN w.j + 1 ELSE w.i + 1 END),
stay AS (SELECT w.track_id, a.seq AS seq_start, b.seq AS seq_end, a.ts AS start_time, b.ts AS end_time, CAST((b.ms - a.ms) // 1000 AS INTEGER) AS duration_s, r.clon AS center_lon, r.clat AS center_lat, r.rad AS radius_m, CAST(w.j - w.i + 1 AS INTEGER) AS point_count
  FROM walk w JOIN rad r ON r.track_id = w.track_id AND r.i = w.i AND r.k = w.j JOIN brk a ON a.track_id = w.track_id AND a.pos = w.i JOIN brk b ON b.track_id = w.track_id AND b.pos = w.j WHERE w.hit)"""


def spots(where: str = "true", visits: int = 2) -> str:
    return f"""sel AS (SELECT *, row_number() OVER (ORDER BY track_id, seq_start) AS id FROM stay WHERE {where}),
edg AS (SELECT a.id AS u, b.id AS v FROM sel a JOIN sel b ON {hav("a.center_lon", "a.center_lat", "b.center_lon", "b.center_lat")} <= 200),
rch AS (SELECT u, v FROM edg UNION SELECT r.u, e.v FROM rch r JOIN edg e ON e.u = r.v),
com AS (SELECT u AS id, min(v) AS spot FROM rch GROUP BY 1),
agg AS (SELECT spot, avg(center_lon) AS lon, avg(center_lat) AS lat, count(*) AS visit_count, count(DISTINCT track_id) AS track_count, CAST(sum(duration_s) AS BIGINT) AS total_duration_s, min(start_time) AS first_visit, max(end_time) AS last_visit, array_to_string(list_sort(list(DISTINCT track_id)), ',') AS track_ids FROM sel JOIN com USING (id) GROUP BY spot HAVING count(*) >= {visits}),
far AS (SELECT spot, max({hav("a.lon", "a.lat", "center_lon", "center_lat")}) AS radius_m FROM sel JOIN com USING (id) JOIN agg a USING (spot) GROUP BY spot),
spt AS (SELECT CAST(row_number() OVER (ORDER BY track_count DESC, visit_count DESC, total_duration_s DESC, lat, lon) AS INTEGER) AS rank, * FROM agg JOIN far USING (spot))"""


SPOT = f"rank, round(lon, 7) AS center_lon, round(lat, 7) AS center_lat, visit_count, track_count, total_duration_s, round(radius_m, 3) AS radius_m, {iso('first_visit')} AS first_visit, {iso('last_visit')} AS last_visit, track_ids"


def vincenty(rows: str, keep: str, steps: int = 8) -> str:
    """CTEs g0 .. and geo(keep, metres): geodesics between (lon, lat) and (lon2, lat2) of rows, so many steps of the iteration each."""
    f, a = f"{WGS84_F!r}::DOUBLE", f"{WGS84_A!r}::DOUBLE"
    sigma = "sqrt(pow(cu2 * sin(lam), 2) + pow(cu1 * su2 - su1 * cu2 * cos(lam), 2)) AS ss, su1 * su2 + cu1 * cu2 * cos(lam) AS cs"
    angles = "atan2(ss, cs) AS s, cu1 * cu2 * sin(lam) / nullif(ss, 0) AS sa"
    middle = "1 - sa * sa AS ca2, CASE WHEN 1 - sa * sa > 1e-15 THEN cs - 2 * su1 * su2 / (1 - sa * sa) ELSE 0 END AS cm"
    c = f"({f} / 16 * ca2 * (4 + {f} * (4 - 3 * ca2)))"
    of = lambda src: f"(SELECT *, {middle} FROM (SELECT *, {angles} FROM (SELECT *, {sigma} FROM {src})))"
    base = f"{keep}, su1, cu1, su2, cu2, l"
    out = [f"u AS (SELECT {keep}, atan((1 - {f}) * tan(radians(lat))) AS u1, atan((1 - {f}) * tan(radians(lat2))) AS u2, radians(lon2 - lon) AS l FROM {rows})", f"g0 AS (SELECT {keep}, sin(u1) AS su1, cos(u1) AS cu1, sin(u2) AS su2, cos(u2) AS cu2, l, l AS lam FROM u)"]
    for k in range(steps):
        out.append(f"g{k + 1} AS (SELECT {base}, coalesce(l + (1 - {c}) * {f} * sa * (s + {c} * ss * (cm + {c} * cs * (2 * cm * cm - 1))), lam) AS lam FROM {of(f'g{k}')})")
    b = f"({a} * (1 - {f}))"
    out.append(f"gk AS (SELECT *, ca2 * ({a} * {a} - {b} * {b}) / ({b} * {b}) AS k FROM {of(f'g{steps}')})")
    out.append("gab AS (SELECT *, 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k))) AS ba, k / 1024 * (256 + k * (-128 + k * (74 - 47 * k))) AS bb FROM gk)")
    out.append(f"geo AS (SELECT {keep}, coalesce({b} * ba * (s - bb * ss * (cm + bb / 4 * (cs * (2 * cm * cm - 1) - bb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))), 0) AS metres FROM gab)")
    return ",\n".join(out)


#: Corners of the regions of the customers, as offsets (a, b) in micro-degrees, ring by ring.
SHAPES = """CASE kind WHEN 0 THEN [[[0, 0], [2 * w, 0], [2 * w, 2 * w], [0, 2 * w], [0, 0]]]
  WHEN 1 THEN [[[0, 0], [3 * w, 0], [3 * w, 3 * w], [w, w // 3], [0, 3 * w], [0, 0]]]
  WHEN 3 THEN [[[0, 0], [17 * w, w], [5 * w, 4 * w], [0, 0]]]
  WHEN 4 THEN [[[0, 0], [2 * w, 0], [2 * w, 2 * w], [0, 2 * w], [0, 0]], [[w // 2, w // 2], [w, w // 2], [w, w], [w // 2, w], [w // 2, w // 2]], [[w // 2 + 10, w // 2 + 10], [w - 10, w // 2 + 10], [w // 2 + 10, w - 10], [w // 2 + 10, w // 2 + 10]]]
  WHEN 5 THEN [[[0, 0], [2 * w, 2 * w], [2 * w, 0], [0, 2 * w], [0, 0]]]
  WHEN 6 THEN [[[0, 0], [2 * w, 0], [2 * w, 2 * w], [0, 2 * w], [0, 0]], [[5 * w, 0], [6 * w, 0], [6 * w, w], [5 * w, 0]]]
  ELSE [[[0, 0], [2 * w, 0], [2 * w, 2 * w], [0, 2 * w], [0, 0]], [[w // 2, w // 2], [w, w // 2], [w, w], [w // 2, w], [w // 2, w // 2]]] END"""
MANY = f"""reg AS (SELECT CAST(c_custkey AS BIGINT) AS region_id, c_custkey % 8 AS kind, 116290000 + (c_custkey * 7919) % 390000 AS x, 39938000 + (c_custkey * 104729) % 26000 AS y, 300 + (c_custkey * 31) % 40 * 60 AS w FROM customer),
shp AS (SELECT *, unnest({SHAPES}) AS ring FROM reg),
sid AS (SELECT region_id, x, y, ring, unnest(range(1, len(ring))) AS i FROM shp),
edg AS (SELECT region_id, (x + ring[i][1]) / 1000000.0::DOUBLE AS ax, (y + ring[i][2]) / 1000000.0::DOUBLE AS ay, (x + ring[i + 1][1]) / 1000000.0::DOUBLE AS bx, (y + ring[i + 1][2]) / 1000000.0::DOUBLE AS by_ FROM sid),
bbx AS (SELECT region_id, min(least(ax, bx)) AS w, max(greatest(ax, bx)) AS e, min(least(ay, by_)) AS s, max(greatest(ay, by_)) AS n FROM edg GROUP BY 1),
nea AS (SELECT region_id, track_id, seq, lon, lat FROM pts JOIN bbx ON lon BETWEEN w AND e AND lat BETWEEN s AND n),
ins AS (SELECT region_id, track_id, seq FROM nea JOIN edg USING (region_id) GROUP BY ALL HAVING
  bool_or((bx - ax) * (lat - ay) - (by_ - ay) * (lon - ax) = 0 AND lon BETWEEN least(ax, bx) AND greatest(ax, bx) AND lat BETWEEN least(ay, by_) AND greatest(ay, by_))
  OR sum(CASE WHEN (ay > lat) <> (by_ > lat) AND lon < (bx - ax) * (lat - ay) / nullif(by_ - ay, 0) + ax THEN 1 ELSE 0 END) % 2 = 1)"""


def region(r: Region, where: str = "true", tracks: str = "true") -> str:
    """ins: points inside; hits: tracks that cross; mat: matched tracks with counts."""
    values = ", ".join(f"({a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE, {d!r}::DOUBLE)" for a, b, c, d in edges_of(r.rings))
    cross = lambda a, b, c, d, x, y: f"(({c} - {a}) * ({y} - {b}) - ({d} - {b}) * ({x} - {a}))"
    return f"""edge(x1, y1, x2, y2) AS (VALUES {values}),
ray AS (SELECT track_id, seq, any_value(ts) AS ts, bool_or({cross("x1", "y1", "x2", "y2", "lon", "lat")} = 0 AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2)) AS on_edge,
  sum(CASE WHEN y1 <> y2 AND (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1 THEN 1 ELSE 0 END) AS crossings FROM pts, edge GROUP BY 1, 2),
ins AS (SELECT track_id, seq, ts FROM ray WHERE on_edge OR crossings % 2 = 1),
seg AS (SELECT track_id, lag(lon) OVER w AS a, lag(lat) OVER w AS b, lon AS c, lat AS d FROM pts WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
cut AS (SELECT DISTINCT track_id FROM seg, edge WHERE a IS NOT NULL AND greatest(a, c) >= least(x1, x2) AND least(a, c) <= greatest(x1, x2) AND greatest(b, d) >= least(y1, y2) AND least(b, d) <= greatest(y1, y2)
  AND {cross("x1", "y1", "x2", "y2", "a", "b")} * {cross("x1", "y1", "x2", "y2", "c", "d")} <= 0 AND {cross("a", "b", "c", "d", "x1", "y1")} * {cross("a", "b", "c", "d", "x2", "y2")} <= 0),
hits AS (SELECT track_id FROM ins UNION SELECT track_id FROM cut),
cnt AS (SELECT track_id, count(*) AS n FROM ins WHERE {where} GROUP BY 1),
mat AS (SELECT t.*, coalesce(n, 0) AS inside_count FROM trk t JOIN hits USING (track_id) LEFT JOIN cnt USING (track_id) WHERE {tracks})"""


def within(r: Region, where: str = "true", tracks: str = "true") -> str:
    return f"WITH {PTS}, {STEP}, {region(r, where, tracks)} SELECT track_id, source, inside_count FROM mat"


def _waves(v: str, *terms: tuple[float, str]) -> str:
    return "(" + " + ".join(f"{k}::DOUBLE * sin({v} * {w})" for k, w in terms) + ") * 2.0::DOUBLE / 3.0::DOUBLE"


def gcj(sign: str = "+", source: str = f"WITH {PTS}", table: str = "pts", keys: str = "track_id, seq") -> str:
    w, s, e, n = GCJ_BOUNDS
    ripple = _waves("x", (20.0, "6 * pi()"), (20.0, "2 * pi()"))
    lat = f"-100.0::DOUBLE + 2 * x + 3 * y + 0.2::DOUBLE * y * y + 0.1::DOUBLE * x * y + 0.2::DOUBLE * sqrt(abs(x)) + {ripple} + {_waves('y', (20.0, 'pi()'), (40.0, 'pi() / 3'))} + {_waves('y', (160.0, 'pi() / 12'), (320.0, 'pi() / 30'))}"
    lon = f"300.0::DOUBLE + x + 2 * y + 0.1::DOUBLE * x * x + 0.1::DOUBLE * x * y + 0.1::DOUBLE * sqrt(abs(x)) + {ripple} + {_waves('x', (20.0, 'pi()'), (40.0, 'pi() / 3'))} + {_waves('x', (150.0, 'pi() / 12'), (300.0, 'pi() / 30'))}"
    inside = f"lon > {w} AND lon < {e} AND lat > {s} AND lat < {n}"
    return f"""{source}, xy AS (SELECT *, lon - 105 AS x, lat - 35 AS y, 1 - {GCJ_EE}::DOUBLE * pow(sin(radians(lat)), 2) AS m FROM {table}),
raw2 AS (SELECT *, {lat} AS rlat, {lon} AS rlon FROM xy)
SELECT {keys}, round(lon {sign} CASE WHEN {inside} THEN rlon * 180 / ({GCJ_A}::DOUBLE / sqrt(m) * cos(radians(lat)) * pi()) ELSE 0 END, 7) AS lon, round(lat {sign} CASE WHEN {inside} THEN rlat * 180 / (({GCJ_A}::DOUBLE * (1 - {GCJ_EE}::DOUBLE)) / (m * sqrt(m)) * pi()) ELSE 0 END, 7) AS lat FROM raw2"""


def sample_track() -> str:
    legs = list(zip(Q.ROUTE, Q.ROUTE[1:], strict=False))
    lengths = [((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2) ** 0.5 for a, b in legs]
    rows, at = [], 0.0
    for (a, b), n in zip(legs, lengths, strict=True):
        rows.append(f"({at!r}::DOUBLE, {n!r}::DOUBLE, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)")
        at += n
    return f"""WITH leg(d0, n, x0, y0, x1, y1) AS (VALUES {", ".join(rows)}), s AS (SELECT range AS id, range / 120.0::DOUBLE * {at!r}::DOUBLE AS d FROM range(121)),
j AS (SELECT s.*, l.*, row_number() OVER (PARTITION BY id ORDER BY l.d0 DESC) AS k FROM s JOIN leg l ON l.d0 <= s.d OR l.d0 = 0)
SELECT CAST(id AS BIGINT) AS seq, strftime(make_timestamp((1788823800 + id * 25) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS recorded_at, round(x0 + (x1 - x0) * least(1.0::DOUBLE, (d - d0) / n), 7) AS lon, round(y0 + (y1 - y0) * least(1.0::DOUBLE, (d - d0) / n), 7) AS lat, round(40 + 8 * sin(id / 20.0::DOUBLE), 6) AS elevation_m FROM j WHERE k = 1"""


def names(what: str) -> str:
    cases = " ".join("WHEN {} THEN {}".format(i, "'" + n.replace("'", "''") + "'") for i, n in enumerate(Q.NAMES)).replace("\t", "' || chr(9) || '").replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '")
    raw = f"raw_n AS (SELECT track_id, CASE track_id % {len(Q.NAMES)} {cases} END AS raw FROM pts WHERE seq = 0)"
    return f"WITH {PTS}, {raw} SELECT track_id, {what} FROM raw_n"


def _uniform(i: str, k: int) -> str:
    return f"((({i} * 48271 + {k * 7919 + 11}) * 16807 % 2147483647) / 2147483647.0::DOUBLE)"


RANDOM = f"""WITH r AS (SELECT range AS i FROM range(300000)),
q AS (SELECT 116.2::DOUBLE + {_uniform("i", 1)} * 0.4::DOUBLE AS lon, 39.8::DOUBLE + {_uniform("i", 2)} * 0.3::DOUBLE AS lat, make_timestamp(CAST((1704067200 + floor({_uniform("i", 3)} * 2592000)) * 1000000 AS BIGINT)) AS ts FROM r)
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS points FROM q WHERE {hav("116.4::DOUBLE", "39.9::DOUBLE", "lon", "lat")} <= 1000 GROUP BY 1"""
DEMO = f"""WITH r AS (SELECT range AS i, range % 14 AS t, range // 14 AS s FROM range(1680)),
a AS (SELECT *, (t // 2) % 4 AS place, CASE WHEN s < 60 THEN s - 60 WHEN s < 90 THEN 0 ELSE s - 89 END AS away, s >= 60 AND s < 90 AS still FROM r)
SELECT CAST(t AS BIGINT) AS track_id, CAST(s AS BIGINT) AS seq, {iso("make_timestamp(CAST((1788220800 + t * 25200 + s * 25) * 1000000 AS BIGINT))")} AS recorded_at,
  round(116.35::DOUBLE + place * 0.02::DOUBLE + away * (0.0002::DOUBLE + t * 0.00001::DOUBLE) + CASE WHEN still THEN ({_uniform("i", 4)} - 0.5::DOUBLE) * 0.0001::DOUBLE ELSE 0 END, 6) AS lon,
  round(39.9::DOUBLE + place * 0.015::DOUBLE + away * 0.0001::DOUBLE + CASE WHEN still THEN ({_uniform("i", 5)} - 0.5::DOUBLE) * 0.0001::DOUBLE ELSE 0 END, 6) AS lat,
  CASE WHEN t % 3 <> 2 THEN round(40 + s / 10.0::DOUBLE, 1) END AS elevation_m FROM a"""


def oracle_sql() -> dict[str, str]:
    p, ps = f"WITH {PTS}", f"WITH {PTS}, {STEP}"
    rec = f"WITH RECURSIVE {PTS}, {STAY}"
    plt_ok = "seq % 17 <> 3 AND seq % 19 <> 4"
    name = "trim(regexp_replace(raw, '[\\r\\n\\t]+', ' ', 'g'))"
    safe = "regexp_replace(raw, '[\\\\/:*?\"<>|\\s]+', '_', 'g')"
    half = Q.CELL / 2
    return {
        "plt_parse": f"{p} SELECT track_id, seq, lat, lon, round(CASE WHEN seq % 5 = 0 THEN NULL ELSE seq * 10 * 0.3048::DOUBLE END, 4) AS elevation_m, {iso('ts')} AS recorded_at FROM pts WHERE {plt_ok}",
        "gpx_parse": f"{p} SELECT track_id, 'track ' || track_id AS name, seq, lat, lon, CASE WHEN seq % 5 = 0 THEN NULL ELSE seq * 2 + 0.5::DOUBLE END AS elevation_m, {iso('ts')} AS recorded_at FROM pts WHERE seq % 17 <> 3 AND seq % 11 <> 2 AND seq % 13 NOT IN (5, 6)",
        "plt_format": f"{p} SELECT track_id, seq, lat, lon, round(CASE WHEN seq % 5 = 0 THEN NULL ELSE seq * 10 * 0.3048::DOUBLE END, 4) AS elevation_m, {iso('ts')} AS recorded_at FROM pts WHERE {plt_ok}",
        "gpx_format": f"{p} SELECT track_id, seq, lat, lon, CASE WHEN seq % 5 = 0 THEN NULL ELSE seq * 2 + 0.5::DOUBLE END AS elevation_m, {iso('ts')} AS recorded_at FROM pts WHERE seq % 17 <> 3 AND seq % 11 <> 2 AND seq % 13 NOT IN (5, 6)",
        "sample_track": sample_track(),
        "content_hash": f"{p} SELECT track_id, substr(sha256('content of ' || track_id), 1, 32) AS hash FROM pts WHERE seq = 0",
        "geojson_export": f"{p} SELECT track_id, 'LineString' AS kind, 'track-' || track_id AS name, count(*) AS points, arg_min(lat, seq) AS first_lat, {iso('min(ts)')} AS first_time FROM pts GROUP BY track_id",
        "track_list": f"{ps} SELECT {TRACK} FROM (SELECT * FROM trk ORDER BY start_time DESC, track_id DESC LIMIT 50)",
        "track_list_source": f"{ps} SELECT {TRACK} FROM (SELECT * FROM trk WHERE source = 'gpx' ORDER BY start_time DESC, track_id DESC LIMIT 50)",
        "track_count_by_source": f"{ps} SELECT source, count(*) AS tracks FROM trk GROUP BY source",
        "track_ids": f"{p} SELECT DISTINCT track_id FROM pts",
        "track_detail": f"{p} SELECT {POINT} FROM pts WHERE track_id = {Q.BASELINE}",
        "points_of_tracks": f"{p} SELECT {POINT} FROM pts WHERE track_id IN ({', '.join(map(str, Q.IDS))})",
        "find_by_external_id": f"{ps} SELECT track_id, name, external_id FROM trk WHERE external_id = substr(sha256('track-3'), 1, 32)",
        "find_by_name": f"{ps} SELECT track_id, name, source FROM trk WHERE name = 'track-7'",
        "bbox_filter": f"{p} SELECT {POINT} FROM pts WHERE {box(Q.SMALL_BOX)}",
        "layout_box": f"{p} SELECT {POINT} FROM pts WHERE {box(Q.SMALL_BOX)}",
        "hour_filter": f"{p} SELECT track_id, seq, {LOCAL} AS hour FROM pts WHERE {LOCAL} BETWEEN 7 AND 9",
        "date_filter": f"{p} SELECT {POINT} FROM pts WHERE ts BETWEEN {START} AND {END}",
        "track_time_overlap": f"{ps} SELECT {TRACK} FROM trk WHERE start_time <= {END} AND end_time >= {START}",
        "planar_dwithin": f"{p} SELECT track_id, seq, lon, lat FROM pts WHERE (lon - 116.3::DOUBLE) * (lon - 116.3::DOUBLE) + (lat - 39.95::DOUBLE) * (lat - 39.95::DOUBLE) <= {0.003 * 0.003!r}::DOUBLE",
        "name_normalize": names(f"CASE WHEN {name} <> '' AND length({name}) <= 200 THEN {name} END AS name"),
        "safe_file_name": names(f"CASE WHEN regexp_matches(raw, '^\\s*$') OR {safe} IN ('.', '..') THEN 'unnamed' ELSE left({safe}, 80) END AS file_name"),
        "similarity_forward": f"{p}, {ONE} SELECT b_track AS track_id, a_hit AS hits FROM hit",
        "similarity_reverse": f"{p}, {ONE} SELECT b_track AS track_id, b_hit AS hits FROM hit",
        "similarity_scores": f"{p}, {ONE} SELECT *, least(forward, reverse) AS similarity FROM sco",
        "similarity_all_pairs": f"{p}, {ALL} SELECT *, least(forward, reverse) AS similarity FROM sco",
        "similarity_topk": f"{ps}, {ONE}, top AS (SELECT *, least(forward, reverse) AS similarity FROM sco ORDER BY similarity DESC, b_track LIMIT 10) SELECT b_track AS track_id, name, source, round(distance_m, 3) AS distance_m, forward, reverse, similarity, CAST(abs(date_diff('day', CAST((SELECT start_time FROM trk WHERE track_id = {Q.BASELINE}) AS DATE), CAST(start_time AS DATE))) AS INTEGER) AS days_away, (SELECT count(*) FROM sco) AS compared FROM top JOIN trk ON trk.track_id = b_track",
        "similarity_min": f"{p}, {ONE} SELECT b_track, least(forward, reverse) AS similarity FROM sco WHERE least(forward, reverse) >= 50",
        "similarity_compared": f"{p}, {ONE} SELECT CAST({Q.BASELINE} AS BIGINT) AS track_id, count(*) AS compared FROM sco",
        "semi_join_ids": f"{ps} SELECT track_id, name FROM trk WHERE track_id IN (SELECT track_id FROM trk WHERE source = 'gpx')",
        "grid_method_diff": f"{p}, a AS (SELECT {CELL}, count(*) AS n FROM pts GROUP BY 1, 2), b AS (SELECT CAST(round_even(lon * {1 / Q.CELL!r}::DOUBLE, 0) AS INTEGER) AS nx, CAST(round_even(lat * {1 / Q.CELL!r}::DOUBLE, 0) AS INTEGER) AS ny, count(*) AS m FROM pts GROUP BY 1, 2) SELECT count(*) AS cells, count(*) FILTER (WHERE n IS DISTINCT FROM m) AS differing FROM a FULL JOIN b USING (nx, ny)",
        "delete_cascade": f"{p} SELECT track_id, count(*) AS points FROM pts WHERE track_id NOT IN (SELECT track_id FROM pts WHERE seq = 59 AND track_id % 3 = 1) GROUP BY 1",
        "density_tracks": density("tracks"),
        "density_points": density("points"),
        "density_morning": density("points", f"{LOCAL} BETWEEN 7 AND 9"),
        "density_summary": f"{p}, {dens()} SELECT count(*) AS cells, CAST(sum(points) AS BIGINT) AS points, max(tracks) AS max_tracks FROM den",
        "points_per_track": f"{p} SELECT track_id, count(*) AS points FROM pts GROUP BY 1",
        "within_point_counts": f"{ps}, {region(Q.POLYGON)} SELECT track_id, n AS inside_count FROM cnt",
        "within_stats": f"{ps}, {region(Q.POLYGON)} SELECT coalesce(source, 'all') AS source, count(*) AS track_count, round(sum(coalesce(distance_m, 0)), 2) AS distance_m, {iso('min(start_time)')} AS start_time, {iso('max(end_time)')} AS end_time FROM mat GROUP BY ROLLUP (source)",
        "track_summary": f"{ps} SELECT {TRACK} FROM trk",
        "make_line": f"{p} SELECT track_id, CAST(count(*) AS INTEGER) AS n_points, string_agg(CAST(round(lon * 1000000) AS BIGINT) || ',' || CAST(round(lat * 1000000) AS BIGINT), ' ' ORDER BY seq) AS line FROM pts GROUP BY 1",
        "speed_threshold": f"{ps} SELECT track_id, round(threshold, 3) AS threshold FROM thr",
        "elevation_normalize": f"{p}, k AS (SELECT track_id, count(DISTINCT elevation_m) <= 1 AND (count(elevation_m) = count(*) OR count(elevation_m) = 0) AS same FROM pts GROUP BY 1) SELECT track_id, seq, CASE WHEN NOT same THEN elevation_m END AS elevation_m FROM pts JOIN k USING (track_id)",
        "avg_speed_kmh": f"{ps} SELECT track_id, round(distance_m / nullif(duration_s, 0) * 3.6::DOUBLE, 4) AS kmh FROM trk",
        "outlier_counts": f"{ps} SELECT track_id, count(*) FILTER (WHERE is_outlier) AS outliers FROM flag GROUP BY 1",
        "point_speed": f"{ps} SELECT track_id, seq, round(v, 3) AS speed_mps FROM spd",
        "clean_sequence": f"{p} SELECT track_id, seq AS old, row_number() OVER (PARTITION BY track_id ORDER BY date_trunc('minute', ts), 59 - seq) - 1 AS seq FROM pts",
        "outlier_flags": f"{ps} SELECT track_id, seq, is_outlier FROM flag",
        "value_at": f"""{p}, q AS (SELECT *, epoch_ms(ts) AS ms, (1704067200 + (track_id % 28) * 86400 + ((track_id * 7) % 24) * 3600 + 431) * 1000 AS a FROM pts),
b AS (SELECT track_id, any_value(a) AS a, max(ms) FILTER (WHERE ms <= a) AS m0, arg_max(elevation_m, ms) FILTER (WHERE ms <= a) AS v0, min(ms) FILTER (WHERE ms >= a) AS m1, arg_min(elevation_m, ms) FILTER (WHERE ms >= a) AS v1 FROM q GROUP BY 1)
SELECT track_id, round(CASE WHEN m0 IS NULL THEN v1 WHEN m1 IS NULL OR m0 = m1 THEN v0 ELSE v0 + (v1 - v0) * ((a - m0) / (m1 - m0)::DOUBLE) END, 6) AS value FROM b""",
        "trip_sessions": f"{p}, g AS (SELECT *, CASE WHEN epoch_ms(ts) - lag(epoch_ms(ts)) OVER (PARTITION BY track_id ORDER BY ts) > 300000 THEN 1 ELSE 0 END AS cut FROM pts), t AS (SELECT *, sum(cut) OVER (PARTITION BY track_id ORDER BY ts) AS trip FROM g) SELECT track_id, {iso('min(ts)')} AS trip_start, {iso('max(ts) + INTERVAL 300 SECOND')} AS trip_end, count(*) AS points FROM t GROUP BY track_id, trip",
        "within_items": f"{ps}, {region(Q.POLYGON)} SELECT track_id, name, inside_count FROM (SELECT * FROM mat ORDER BY inside_count DESC, track_id LIMIT 20)",
        "within_response": f"{ps}, {region(Q.POLYGON)} SELECT count(*) AS total_hits, count(*) > 20 AS truncated, CAST(coalesce(sum(inside_count), 0) AS BIGINT) AS inside_points, '{Q.POLYGON.geometry}' AS geometry FROM mat",
        "hotspots_resorted": f"{rec}, {spots()} SELECT rank, track_count, visit_count, total_duration_s FROM spt",
        "random_points_near": RANDOM,
        "demo_points": DEMO,
        "cells_except": f"{p}, c AS (SELECT {CELL}, {LOCAL} BETWEEN 7 AND 9 AS am FROM pts) SELECT *, 'morning' AS side FROM (SELECT nx, ny FROM c WHERE am EXCEPT SELECT nx, ny FROM c WHERE NOT am) UNION ALL SELECT *, 'other' AS side FROM (SELECT nx, ny FROM c WHERE NOT am EXCEPT SELECT nx, ny FROM c WHERE am)",
        "haversine": f"{p} SELECT track_id, seq, round({hav('116.3::DOUBLE', '39.95::DOUBLE', 'lon', 'lat')}, 3) AS metres FROM pts",
        "line_stats": f"{p} SELECT track_id, CAST(count(*) AS INTEGER) AS n_points, min(lat) AS min_lat, max(lat) AS max_lat, arg_min(lon, seq) AS start_lon, arg_min(lat, seq) AS start_lat, arg_max(lon, seq) AS end_lon, arg_max(lat, seq) AS end_lat FROM pts GROUP BY 1",
        "distance_three_ways": f"{p} SELECT a.track_id, round(sqrt((b.lon - a.lon) * (b.lon - a.lon) + (b.lat - a.lat) * (b.lat - a.lat)), 9) AS planar_deg, round({hav('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 3) AS sphere_m FROM pts a JOIN pts b ON a.track_id = b.track_id AND a.seq = 0 AND b.seq = 59",
        "gcj02_shift": gcj(),
        "gcj02_back": gcj("-"),
        "gcj02_cells": gcj("+", f"{p}, {dens()}", "den", "points"),
        "density_ratio": f"{p}, {dens()} SELECT round(lon, 7) AS lon, round(lat, 7) AS lat, round(least(1.0::DOUBLE, ln(1 + tracks::DOUBLE) / ln(65::DOUBLE)), 6) AS ratio FROM den",
        "cell_rect": f"{p}, {dens()} SELECT round(lon - {half}::DOUBLE, 7) AS west, round(lat - {half}::DOUBLE, 7) AS south, round(lon + {half}::DOUBLE, 7) AS east, round(lat + {half}::DOUBLE, 7) AS north FROM den",
        "playback_stats": f"{p}, a AS (SELECT track_id, count(*) >= 2 AND max(ts) > min(ts) AS can_play, (epoch_ms(max(ts)) - epoch_ms(min(ts))) / 1000.0::DOUBLE AS span_s FROM pts GROUP BY 1) SELECT track_id, can_play, round(span_s, 3) AS span_s, round(CASE WHEN can_play THEN span_s / 20 ELSE 1 END, 4) AS multiplier FROM a",
        "clean_track": f"{ps}, k AS (SELECT track_id, count(*) AS n, count(DISTINCT elevation_m) <= 1 AND (count(elevation_m) = count(*) OR count(elevation_m) = 0) AS same FROM pts GROUP BY 1) SELECT track_id, seq, lon, lat, CASE WHEN NOT same THEN elevation_m END AS elevation_m, round(v, 3) AS speed_mps, is_outlier FROM flag JOIN k USING (track_id) WHERE n >= 2",
        "stay_points": f"{rec} SELECT track_id, seq_start, seq_end, {iso('start_time')} AS start_time, {iso('end_time')} AS end_time, duration_s, round(center_lon, 7) AS center_lon, round(center_lat, 7) AS center_lat, round(radius_m, 3) AS radius_m, point_count FROM stay",
        "stay_count_by_track": f"{rec} SELECT track_id, count(*) AS stays FROM stay GROUP BY 1",
        "hotspots": f"{rec}, {spots()} SELECT {SPOT} FROM spt",
        "hotspots_window": f"{rec}, {spots(f'start_time >= {START} AND end_time <= {END}', 1)} SELECT {SPOT} FROM spt",
        "hotspot_isolated": f"{rec}, {spots()} SELECT (SELECT count(*) FROM stay) AS scanned_stays, count(*) AS hotspots, CAST(coalesce(sum(visit_count), 0) AS BIGINT) AS visits, CAST((SELECT count(*) FROM stay) - coalesce(sum(visit_count), 0) AS BIGINT) AS isolated FROM spt",
        "within_rect": within(Q.RECT),
        "within_polygon": within(Q.POLYGON),
        "within_multipolygon": within(Q.MULTI),
        "within_hole": within(Q.HOLE),
        "within_buffer": within(Q.BUFFER),
        "ellipsoid_steps": f"""WITH {PTS}, stp AS (SELECT a.track_id, a.seq, a.lon, a.lat, b.lon AS lon2, b.lat AS lat2 FROM pts a JOIN pts b ON b.track_id = a.track_id AND b.seq = a.seq + 1),
{vincenty("stp", "track_id, seq, lon, lat, lon2, lat2")} SELECT track_id, seq, round(metres, 4) AS ellipsoid_m, round(metres - {hav("lon", "lat", "lon2", "lat2")}, 4) AS longer_m FROM geo""",
        "similarity_ellipsoid": f"""WITH {PTS}, can AS (SELECT a.track_id AS a_track, a.seq AS a_seq, b.track_id AS b_track, b.seq AS b_seq, a.lon, a.lat, b.lon AS lon2, b.lat AS lat2 FROM pts a JOIN pts b ON a.track_id = {Q.BASELINE} AND b.track_id <> {Q.BASELINE} AND b.lat BETWEEN a.lat - 0.001 AND a.lat + 0.001 AND b.lon BETWEEN a.lon - 0.001 AND a.lon + 0.001),
{vincenty("can", "a_track, a_seq, b_track, b_seq")},
hit AS (SELECT a_track, b_track, count(DISTINCT a_seq) AS a_hit, count(DISTINCT b_seq) AS b_hit FROM geo WHERE metres <= {Q.TOLERANCE_M} GROUP BY ALL),
tot AS (SELECT track_id, count(*) AS n FROM pts GROUP BY 1)
SELECT a_track, b_track, a_hit, b_hit, least(floor(least(100.0::DOUBLE, a_hit * 100.0::DOUBLE / a.n) * 10 + 0.5) / 10, floor(least(100.0::DOUBLE, b_hit * 100.0::DOUBLE / b.n) * 10 + 0.5) / 10) AS similarity FROM hit JOIN tot a ON a.track_id = a_track JOIN tot b ON b.track_id = b_track""",
        "line_interpolate": f"""WITH {PTS}, stp AS (SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0 FROM pts WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
len AS (SELECT *, coalesce(sqrt((lon - lon0) * (lon - lon0) + (lat - lat0) * (lat - lat0)), 0) AS d FROM stp),
cum AS (SELECT *, sum(d) OVER (PARTITION BY track_id ORDER BY seq) AS e, sum(d) OVER (PARTITION BY track_id) AS whole FROM len),
ask AS (SELECT *, unnest([0.0, 0.1, 0.5, 0.75, 1.0]::DOUBLE[]) AS fraction FROM cum),
pic AS (SELECT track_id, fraction, min(seq) AS seq FROM ask WHERE e >= fraction * whole - 1e-15 GROUP BY 1, 2)
SELECT track_id, fraction, round(coalesce(lon0 + (lon - lon0) * ((fraction * whole - (e - d)) / nullif(d, 0)), lon), 7) AS lon, round(coalesce(lat0 + (lat - lat0) * ((fraction * whole - (e - d)) / nullif(d, 0)), lat), 7) AS lat FROM pic JOIN ask USING (track_id, fraction, seq)""",
        "within_regions": f"WITH {PTS}, {MANY} SELECT region_id, count(*) AS points, count(DISTINCT track_id) AS tracks FROM ins GROUP BY 1",
        "region_validity": "SELECT CAST(c_custkey AS BIGINT) AS region_id, c_custkey % 8 < 5 AS valid FROM customer",
        "within_time_window": within(Q.POLYGON, f"ts BETWEEN {START} AND {END}", f"start_time <= {END} AND end_time >= {START}"),
        "import_plan": f"""{ps}, inc AS (SELECT 'file-' || track_id AS file, CASE WHEN track_id % 4 = 0 THEN name ELSE 'new-' || track_id END AS name, source, CASE WHEN track_id % 3 = 0 THEN external_id ELSE 'new-' || track_id END AS external_id,
  track_id % 5 >= 3 AS rep, CASE WHEN track_id % 7 <> 6 THEN track_id + track_id % 2 END AS replace_id, track_id % 8 = 0 AS allow FROM trk),
m AS (SELECT i.*, h.track_id AS hid, n.track_id AS nid, r.source AS rsrc FROM inc i LEFT JOIN trk h ON h.external_id = i.external_id LEFT JOIN trk n ON n.name = i.name LEFT JOIN trk r ON r.track_id = i.replace_id),
a AS (SELECT *, CASE WHEN hid IS NOT NULL AND NOT rep THEN 'skip' WHEN hid IS NOT NULL AND hid IS DISTINCT FROM replace_id THEN 'conflict_content' WHEN NOT rep AND nid IS NOT NULL AND NOT allow THEN 'conflict_name' WHEN rep AND (replace_id IS NULL OR rsrc IS NULL OR rsrc <> source) THEN 'error' WHEN rep THEN 'replace' ELSE 'insert' END AS action FROM m)
SELECT file, action, CASE WHEN action IN ('skip', 'conflict_content') THEN hid WHEN action = 'conflict_name' THEN nid WHEN action = 'replace' THEN replace_id END AS track_id FROM a""",
        "name_conflicts": f"{p}, n AS (SELECT track_id, 'name-' || (track_id % 50) AS name FROM pts WHERE seq = 0) SELECT a.track_id, a.name, min(b.track_id) AS other_id FROM n a JOIN n b ON a.name = b.name AND a.track_id <> b.track_id GROUP BY 1, 2",
    }
