"""Regions, boxes, grids and limits: checked on the driver before any plan is made."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from decimal import Decimal

from waymark.functions.geo import EARTH_M, gcj02_offset_at
from waymark.functions.topology import fault

#: Grid sizes in degrees that a caller may ask for (fixed values), coarse to fine.
LADDER = (5.0, 2.0, 1.0, 0.5, 0.2, 0.1, 0.05, 0.02, 0.01, 0.005, 0.002, 0.001, 0.0005, 0.0002, 0.0001)
MAX_CELLS, TARGET_COLUMNS = 20_000, 80
MAX_VERTICES, MAX_BUFFER_M, BUFFER_POINTS = 2_000, 50_000.0, 32
MAX_TOLERANCE_M, MAX_LIMIT, MAX_NAME = 1_000.0, 500, 200


@dataclass(frozen=True)
class Bbox:
    west: float
    south: float
    east: float
    north: float


@dataclass(frozen=True)
class Region:
    rings: tuple[tuple[tuple[float, float], ...], ...]
    buffered: bool
    vertex_count: int
    #: The GeoJSON of the area that is searched: of a buffered point, its circle.
    geometry: str = ""


def parse_bbox(text: str) -> Bbox:
    """'west,south,east,north' in degrees; ValueError for anything else."""
    try:
        w, s, e, n = (float(x) for x in (text or "").split(","))
    except ValueError:
        raise ValueError("a box needs four numbers: west,south,east,north") from None
    if not all(map(math.isfinite, (w, s, e, n))):
        raise ValueError("a box needs finite numbers")
    if not (-180 <= w <= 180 and -180 <= e <= 180 and -90 <= s <= 90 and -90 <= n <= 90):
        raise ValueError("the box leaves the range of longitudes or latitudes")
    if w >= e or s >= n:
        raise ValueError("west must be less than east, and south than north")
    return Bbox(w, s, e, n)


def check_cell_size(size: float) -> float:
    if size not in LADDER:
        raise ValueError(f"cell size {size} is not one of {LADDER}")
    return size


def pick_cell_size(box: Bbox) -> float:
    """The smallest ladder size that keeps the box within TARGET_COLUMNS columns, else the coarsest."""
    fitting = [c for c in LADDER if c >= (box.east - box.west) / TARGET_COLUMNS]
    return min(fitting) if fitting else LADDER[0]


def estimate_cells(box: Bbox, size: float) -> int:
    return math.ceil((box.east - box.west) / size) * math.ceil((box.north - box.south) / size)


def most_cells(box: Bbox, size: float) -> int:
    """A bound that holds: centred cells can touch one more row and column on either side."""
    return (math.ceil((box.east - box.west) / size) + 2) * (math.ceil((box.north - box.south) / size) + 2)


def check_cells(box: Bbox, size: float) -> None:
    if estimate_cells(box, size) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells; take a coarser size or a smaller box")


def check_hours(hour_from: int | None, hour_to: int | None) -> tuple[int, int] | None:
    if (hour_from is None) != (hour_to is None):
        raise ValueError("give both hours or none")
    if hour_from is None or hour_to is None:
        return None
    if not 0 <= hour_from <= hour_to <= 23:
        raise ValueError("hours must satisfy 0 <= from <= to <= 23")
    return hour_from, hour_to


def check_metric(metric: str | None) -> str:
    metric = metric or "tracks"
    if metric not in ("tracks", "points"):
        raise ValueError("metric is tracks or points")
    return metric


def check_tolerance(tolerance_m: float) -> float:
    if not (math.isfinite(tolerance_m) and 1 <= tolerance_m <= MAX_TOLERANCE_M):
        raise ValueError(f"tolerance must lie between 1 and {MAX_TOLERANCE_M} m")
    return tolerance_m


def check_limit(limit: int, most: int = MAX_LIMIT) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must lie between 1 and {most}")
    return limit


def check_hotspot(radius_m: float, min_visits: int) -> None:
    if not (math.isfinite(radius_m) and radius_m > 0):
        raise ValueError("the radius must be a finite number above 0")
    if min_visits < 1:
        raise ValueError("min_visits must be at least 1")


def instant(text: str) -> int:
    """Microseconds since 1970 of an ISO time with its offset; ValueError for others, which name no instant."""
    when = datetime.fromisoformat(text)
    if when.tzinfo is None:
        raise ValueError(f"{text!r} has no offset from UTC")
    return (when - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def check_window(start: str | None, end: str | None) -> None:
    """ISO times with their offsets, or none; the start must not lie after the end."""
    ends = [instant(t) for t in (start, end) if t is not None]
    if len(ends) == 2 and ends[0] > ends[1]:
        raise ValueError("the window's start lies after its end")


def check_name(raw: str | None, most: int = MAX_NAME) -> str:
    """A track name on one line, trimmed; ValueError if empty or too long."""
    name = " ".join(part for part in (raw or "").replace("\r", "\n").replace("\t", "\n").split("\n") if part).strip() if raw else ""
    if not name:
        raise ValueError("a name must not be empty")
    if len(name) > most:
        raise ValueError(f"a name has at most {most} characters")
    return name


def _ring(raw: object) -> tuple[tuple[float, float], ...]:
    if not isinstance(raw, list) or len(raw) < 4:
        raise ValueError("a ring needs at least four points")
    ring = []
    for p in raw:
        if not isinstance(p, list) or len(p) < 2 or not all(isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x) for x in p[:2]):
            raise ValueError("a ring's points are pairs of finite numbers")
        if not (-180 <= p[0] <= 180 and -90 <= p[1] <= 90):
            raise ValueError("a point leaves the range of longitudes or latitudes")
        ring.append((float(p[0]), float(p[1])))
    if ring[0] != ring[-1]:
        raise ValueError("a ring must end where it begins")
    return tuple(ring)


def buffer_ring(lon: float, lat: float, radius_m: float, points: int = BUFFER_POINTS) -> tuple[tuple[float, float], ...]:
    """A closed ring of points at radius_m from a point, on the sphere."""
    d, phi, lam = radius_m / EARTH_M, math.radians(lat), math.radians(lon)
    ring = []
    for k in range(points):
        bearing = 2 * math.pi * k / points
        phi2 = math.asin(math.sin(phi) * math.cos(d) + math.cos(phi) * math.sin(d) * math.cos(bearing))
        lam2 = lam + math.atan2(math.sin(bearing) * math.sin(d) * math.cos(phi), math.cos(d) - math.sin(phi) * math.sin(phi2))
        ring.append((math.degrees(lam2), math.degrees(phi2)))
    return (*ring, ring[0])


def parse_region(geometry: str | dict, buffer_m: float | None = None) -> Region:
    """A GeoJSON Polygon, MultiPolygon, or Point with buffer_m; one missing nesting level is tolerated."""
    node = json.loads(geometry) if isinstance(geometry, str) else geometry
    kind, raw = (node or {}).get("type"), (node or {}).get("coordinates")
    if kind == "Point":
        if buffer_m is None or not math.isfinite(buffer_m) or not 0 < buffer_m <= MAX_BUFFER_M:
            raise ValueError(f"a point needs a buffer above 0 and up to {MAX_BUFFER_M} m")
        if not isinstance(raw, list) or len(raw) < 2:
            raise ValueError("a point needs two numbers")
        (lon, lat), *_ = _ring([raw[:2]] * 4)
        rings: list = [buffer_ring(lon, lat, buffer_m)]
        parts = [rings]
    elif kind in ("Polygon", "MultiPolygon"):
        if not isinstance(raw, list) or not raw:
            raise ValueError("a polygon needs rings")

        def depth(x: object) -> int:
            return 1 + depth(x[0]) if isinstance(x, list) and x else 0

        wanted, found = (3 if kind == "Polygon" else 4), depth(raw)
        if found == wanted - 1:
            raw = [raw]
        elif found != wanted:
            raise ValueError("the coordinates are nested wrongly")
        parts = [[_ring(r) for r in polygon] for polygon in ([raw] if kind == "Polygon" else raw)]
        rings = [r for part in parts for r in part]
    else:
        raise ValueError("a region is a Polygon, a MultiPolygon or a Point with a buffer")
    count = sum(map(len, rings))
    if count > MAX_VERTICES:
        raise ValueError(f"more than {MAX_VERTICES} vertices")
    shown = {"type": "Polygon", "coordinates": rings} if kind == "Point" else {"type": kind, "coordinates": [[_ring(r) for r in p] for p in raw] if kind == "MultiPolygon" else rings}
    if why := fault(parts):
        raise ValueError(f"the region is invalid: {why}")
    return Region(tuple(rings), kind == "Point", count, json.dumps(shown))


def rectangle(a: tuple[float, float], b: tuple[float, float]) -> dict:
    """GeoJSON of the box between two corners in any order."""
    w, e, s, n = min(a[0], b[0]), max(a[0], b[0]), min(a[1], b[1]), max(a[1], b[1])
    return {"type": "Polygon", "coordinates": [[[w, s], [e, s], [e, n], [w, n], [w, s]]]}


def polygon(points: list[tuple[float, float]]) -> dict | None:
    """GeoJSON of a polygon, closed if need be; None below three points."""
    if len(points) < 3:
        return None
    ring = [list(p) for p in points]
    return {"type": "Polygon", "coordinates": [ring if ring[0] == ring[-1] else [*ring, ring[0]]]}


def point(lon: float, lat: float) -> dict:
    return {"type": "Point", "coordinates": [lon, lat]}


def shift_box(box: Bbox, to_display: bool = True) -> Bbox:
    """A box moved between the datums by the offset of its centre."""
    d_lon, d_lat = gcj02_offset_at((box.west + box.east) / 2, (box.south + box.north) / 2)
    sign = 1 if to_display else -1
    return Bbox(box.west + sign * d_lon, box.south + sign * d_lat, box.east + sign * d_lon, box.north + sign * d_lat)


def plain(value: float) -> str:
    """A number without an exponent or trailing zeros."""
    text = format(Decimal(repr(float(value))) + 0, "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def wkt(geometry: dict) -> str:
    """The WKT of a GeoJSON Point, Polygon or MultiPolygon."""
    place = lambda p: f"{plain(p[0])} {plain(p[1])}"
    rings = lambda polygon: "(" + ",".join("(" + ",".join(map(place, r)) + ")" for r in polygon) + ")"
    kind, at = geometry["type"], geometry["coordinates"]
    if kind == "Point":
        return f"POINT({place(at)})"
    if kind == "Polygon":
        return f"POLYGON{rings(at)}"
    if kind == "MultiPolygon":
        return "MULTIPOLYGON(" + ",".join(map(rings, at)) + ")"
    raise ValueError(f"no WKT for {kind}")
