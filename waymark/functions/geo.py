"""Spherical and planar geometry as Column expressions, and the same on plain numbers."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean earth radius in metres (fixed value).
EARTH_M = 6371008.8
#: Metres in a degree of latitude and in a degree of longitude at the equator (fixed values).
LAT_M, LON_M = 110574.0, 111320.0
ZONE = "Asia/Shanghai"

Ring = Sequence[tuple[float, float]]


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres; null where a coordinate is null (least() would pass over it)."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * EARTH_M) * F.asin(F.when(a > 1, 1.0).otherwise(F.sqrt(a)))


def haversine_m(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    """Great-circle metres between two points on the driver or in a task."""
    dlat, dlon = math.radians(lat2 - lat1) / 2, math.radians(lon2 - lon1) / 2
    a = math.sin(dlat) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(dlon) ** 2
    return 2 * EARTH_M * math.asin(min(1.0, math.sqrt(a)))


#: Fixed values of the WGS84 ellipsoid: half its long axis in metres, and its flattening.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
#: Steps of the longitude's iteration at most, and the change in radians at which it has settled (under a tenth of a millimetre).
GEODESIC_STEPS, GEODESIC_SETTLED = 20, 1e-11


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres along the WGS84 ellipsoid by Vincenty's inverse formula.

    The difference of longitudes on the auxiliary sphere is iterated until it settles; places nearly
    opposite each other, for which it does not, give null, as a null coordinate does.
    """
    f, a, b = WGS84_F, WGS84_A, WGS84_A * (1 - WGS84_F)
    reduced = lambda lat: F.atan(F.lit(1 - f) * F.tan(F.radians(lat)))
    turn = F.radians(lon2 - lon1)
    turn = F.atan2(F.sin(turn), F.cos(turn))  # the shorter way round

    def arc(p: Column, lam: Column, use: Callable[[Column], Column]) -> Column:
        """use() of the arc and angles that belong to a difference of longitudes, each bound once."""
        sin_s = F.sqrt(F.pow(p["c2"] * F.sin(lam), 2) + F.pow(p["c1"] * p["s2"] - p["s1"] * p["c2"] * F.cos(lam), 2))
        cos_s = p["s1"] * p["s2"] + p["c1"] * p["c2"] * F.cos(lam)
        sin_a = lambda t: p["c1"] * p["c2"] * F.sin(lam) / t["sin"]

        def with_angle(t: Column) -> Column:
            cos2a = 1 - F.pow(sin_a(t), 2)
            middle = lambda u: F.when(u["cos2a"] > 1e-15, u["cos"] - 2 * p["s1"] * p["s2"] / u["cos2a"]).otherwise(0.0)
            angles = {"sin": t["sin"], "cos": t["cos"], "s": F.atan2(t["sin"], t["cos"]), "sina": sin_a(t), "cos2a": cos2a}
            return _bound(angles, lambda u: _bound({**{k: u[k] for k in angles}, "m": middle(u)}, use))

        return _bound({"sin": sin_s, "cos": cos_s}, lambda t: F.when(t["sin"] > 0, with_angle(t)))

    def longitude(p: Column, lam: Column) -> Column:
        def moved(u: Column) -> Column:
            c = f / 16 * u["cos2a"] * (4 + f * (4 - 3 * u["cos2a"]))
            return p["l"] + (1 - c) * f * u["sina"] * (u["s"] + c * u["sin"] * (u["m"] + c * u["cos"] * (2 * u["m"] * u["m"] - 1)))

        return arc(p, lam, moved)

    def metres(p: Column, lam: Column) -> Column:
        def length(u: Column) -> Column:
            k = u["cos2a"] * ((a * a - b * b) / (b * b))
            big = 1 + k / 16384 * (4096 + k * (k * (320 - 175 * k) - 768))
            small = k / 1024 * (256 + k * (k * (74 - 47 * k) - 128))
            inner = u["cos"] * (2 * u["m"] * u["m"] - 1) - small / 6 * u["m"] * (4 * u["sin"] * u["sin"] - 3) * (4 * u["m"] * u["m"] - 3)
            return b * big * (u["s"] - small * u["sin"] * (u["m"] + small / 4 * inner))

        return arc(p, lam, length)

    def solve(p: Column) -> Column:
        def step(state: Column, _: Column) -> Column:
            new = F.coalesce(longitude(p, state["lam"]), state["lam"])
            return F.when(state["done"], state).otherwise(_bound({"new": new}, lambda n: F.struct(n["new"].alias("lam"), (F.abs(n["new"] - state["lam"]) <= GEODESIC_SETTLED).alias("done"))))

        begin = F.struct(p["l"].alias("lam"), F.lit(False).alias("done"))
        found = F.aggregate(F.sequence(F.lit(1), F.lit(GEODESIC_STEPS)), begin, step)
        return _bound({"r": found}, lambda t: F.when(t["r"]["done"], F.coalesce(metres(p, t["r"]["lam"]), F.lit(0.0))))

    u1, u2 = reduced(lat1), reduced(lat2)
    placed = {"s1": F.sin(u1), "c1": F.cos(u1), "s2": F.sin(u2), "c2": F.cos(u2), "l": turn}
    return F.when((lon1 == lon2) & (lat1 == lat2), 0.0).otherwise(F.when(lon1.isNotNull() & lon2.isNotNull() & lat1.isNotNull() & lat2.isNotNull(), _bound(placed, solve)))


def degrees_for(tolerance_m: float, max_abs_lat: float) -> float:
    """Degrees that cover tolerance_m in both directions at any latitude up to max_abs_lat."""
    return tolerance_m / min(LAT_M, LON_M * max(math.cos(math.radians(max_abs_lat)), 0.01)) * 1.05


def utc(ts: Column) -> Column:
    """A timestamp's wall clock in UTC, whatever the session's zone is."""
    return F.timestamp_add("SECOND", F.unix_seconds(ts), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def utc_date(ts: Column) -> Column:
    return utc(ts).cast("date")


def local_hour(ts: Column, zone: str = ZONE) -> Column:
    return F.hour(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc(ts)))


def iso(ts: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ssZ."""
    return F.concat(F.translate(utc(ts).cast("string"), " ", "T"), F.lit("Z"))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent within 0 to 100, to one decimal, half up; 0 of nothing."""
    value = F.when(whole > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), part * 100.0 / whole))).otherwise(0.0)
    return F.floor(value * 10 + 0.5) / 10


def edges_of(rings: Sequence[Ring]) -> list[tuple[float, float, float, float]]:
    return [(*a, *b) for ring in rings for a, b in zip(ring, ring[1:], strict=False)]


def bounds_of(rings: Sequence[Ring]) -> tuple[float, float, float, float]:
    xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
    return min(xs), min(ys), max(xs), max(ys)


def _sum(parts: list):
    while len(parts) > 1:
        parts = [parts[i] + parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def _cross(ax, ay, bx, by, px, py):
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def _edge_array(rings: Sequence[Ring]) -> Column:
    """The edges as one array literal, so that a region's size does not lengthen the plan's code."""
    return F.expr("array(" + ", ".join(f"named_struct('ax', {a!r}D, 'ay', {b!r}D, 'bx', {c!r}D, 'by', {d!r}D)" for a, b, c, d in edges_of(rings)) + ")")


def _bound(values: dict[str, Column], f: Callable[[Column], Column]) -> Column:
    """f of a struct of the values: each is computed once, however often f and its lambdas use it."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), f), 1)


def inside(lon: Column, lat: Column, rings: Sequence[Ring]) -> Column:
    """Whether a point lies in the even-odd area of the rings or on an edge (planar degrees).

    The bounding box comes first, so that Parquet statistics can skip what is far away.
    """
    west, south, east, north = bounds_of(rings)
    edges = _edge_array(rings)

    def test(p: Column) -> Column:
        x, y = p["x"], p["y"]

        def on(e: Column) -> Column:
            box = x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))
            return box & (_cross(e["ax"], e["ay"], e["bx"], e["by"], x, y) == 0)

        def crossed(n: Column, e: Column) -> Column:
            straddles = (e["ay"] > y) != (e["by"] > y)  # never of a level edge
            return n + F.when(straddles & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"]), 1).otherwise(0)

        return F.exists(edges, on) | (F.aggregate(edges, F.lit(0), crossed) % 2 == 1)

    return lon.between(west, east) & lat.between(south, north) & _bound({"x": lon, "y": lat}, test)


def crosses(x1: Column, y1: Column, x2: Column, y2: Column, rings: Sequence[Ring]) -> Column:
    """Whether a segment meets any edge of the rings, touching included."""
    west, south, east, north = bounds_of(rings)
    edges = _edge_array(rings)

    def test(s: Column) -> Column:
        a, b, c, d = s["x1"], s["y1"], s["x2"], s["y2"]

        def meets(e: Column) -> Column:
            boxes = (F.greatest(a, c) >= F.least(e["ax"], e["bx"])) & (F.least(a, c) <= F.greatest(e["ax"], e["bx"])) & (F.greatest(b, d) >= F.least(e["ay"], e["by"])) & (F.least(b, d) <= F.greatest(e["ay"], e["by"]))
            edge = (e["ax"], e["ay"], e["bx"], e["by"])
            apart = _cross(*edge, a, b) * _cross(*edge, c, d) <= 0
            return boxes & apart & (_cross(a, b, c, d, e["ax"], e["ay"]) * _cross(a, b, c, d, e["bx"], e["by"]) <= 0)

        return F.exists(edges, meets)

    near = (F.greatest(x1, x2) >= west) & (F.least(x1, x2) <= east) & (F.greatest(y1, y2) >= south) & (F.least(y1, y2) <= north)
    return near & _bound({"x1": x1, "y1": y1, "x2": x2, "y2": y2}, test)


# The published GCJ-02 ellipsoid and its bounds.
GCJ_A, GCJ_EE = 6378245.0, 0.00669342162296594323
GCJ_BOUNDS = (73.66, 3.86, 135.05, 53.55)


def _gcj02_degrees(lon, lat, m):
    """(d_lon, d_lat) by the published formula; m has sin, cos, sqrt, absolute and radians for numbers or for Columns."""
    x, y, pi = lon - 105.0, lat - 35.0, math.pi

    def waves(v, *terms: tuple[float, float]):
        return _sum([m.sin(v * w) * k for k, w in terms]) * 2.0 / 3.0

    ripple = waves(x, (20.0, 6.0 * pi), (20.0, 2.0 * pi))
    d_lat = -100.0 + 2.0 * x + 3.0 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * m.sqrt(m.absolute(x)) + ripple
    d_lat = d_lat + waves(y, (20.0, pi), (40.0, pi / 3)) + waves(y, (160.0, pi / 12), (320.0, pi / 30))
    d_lon = 300.0 + x + 2.0 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * m.sqrt(m.absolute(x)) + ripple
    d_lon = d_lon + waves(x, (20.0, pi), (40.0, pi / 3)) + waves(x, (150.0, pi / 12), (300.0, pi / 30))
    phi = m.radians(lat)
    magic = 1 - m.sin(phi) * m.sin(phi) * GCJ_EE
    root = m.sqrt(magic)
    return d_lon * 180.0 / (GCJ_A / root * m.cos(phi) * pi), d_lat * 180.0 / (GCJ_A * (1 - GCJ_EE) / (magic * root) * pi)


class _ColumnMath:
    sin, cos, sqrt, absolute, radians = F.sin, F.cos, F.sqrt, F.abs, F.radians


class _NumberMath:
    sin, cos, sqrt, absolute, radians = math.sin, math.cos, math.sqrt, abs, math.radians


def gcj02_offset(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(d_lon, d_lat) that the Chinese datum adds to WGS84; zero outside its bounds."""
    west, south, east, north = GCJ_BOUNDS
    within = (lon > west) & (lon < east) & (lat > south) & (lat < north)
    d_lon, d_lat = _gcj02_degrees(lon, lat, _ColumnMath)
    return F.when(within, d_lon).otherwise(0.0), F.when(within, d_lat).otherwise(0.0)


def gcj02_offset_at(lon: float, lat: float) -> tuple[float, float]:
    """gcj02_offset() of one place, as numbers."""
    west, south, east, north = GCJ_BOUNDS
    return _gcj02_degrees(lon, lat, _NumberMath) if west < lon < east and south < lat < north else (0.0, 0.0)


def to_gcj02(lon: Column, lat: Column) -> tuple[Column, Column]:
    d_lon, d_lat = gcj02_offset(lon, lat)
    return lon + d_lon, lat + d_lat


def from_gcj02(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Approximate inverse: takes off the offset found at the shifted point (a few metres off)."""
    d_lon, d_lat = gcj02_offset(lon, lat)
    return lon - d_lon, lat - d_lat


def shifted(rows: DataFrame, lon: str = "lon", lat: str = "lat", to_display: bool = True) -> DataFrame:
    """rows with two columns shifted between the datums, such as points, cells or, by other names, hotspots; null places stay null."""
    move = to_gcj02 if to_display else from_gcj02
    new_lon, new_lat = move(F.col(lon), F.col(lat))
    return rows.withColumns({lon: new_lon, lat: new_lat})


def shift_place(lon: float, lat: float, to_display: bool = True) -> tuple[float, float]:
    d_lon, d_lat = gcj02_offset_at(lon, lat)
    return (lon + d_lon, lat + d_lat) if to_display else (lon - d_lon, lat - d_lat)


def shift_geometry(geometry: dict, to_display: bool = True) -> dict:
    """A GeoJSON Polygon or MultiPolygon with each place shifted; other geometries as they are."""
    ring = lambda r: [list(shift_place(p[0], p[1], to_display)) for p in r]
    if geometry.get("type") == "Polygon":
        return {**geometry, "coordinates": [ring(r) for r in geometry["coordinates"]]}
    if geometry.get("type") == "MultiPolygon":
        return {**geometry, "coordinates": [[ring(r) for r in p] for p in geometry["coordinates"]]}
    return geometry
