"""Checks on the driver, and geometry expressions against plain loops."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.functions import regions as R
from waymark.functions.geo import bounds_of, crosses, degrees_for, edges_of, from_gcj02, haversine, haversine_m, inside, percent, to_gcj02
from waymark.operators import regions_join

SQUARE = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
HOLE = [[1.0, 1.0], [3.0, 1.0], [3.0, 3.0], [1.0, 3.0], [1.0, 1.0]]
degrees = st.tuples(st.floats(-179, 179), st.floats(-85, 85))


@pytest.mark.parametrize("text", ["", "1,2,3", "1,2,3,x", "nan,0,1,1", "5,0,1,1", "0,3,1,1", "-181,0,1,1", "0,-91,1,1", "0,0,1,inf", None])
def test_bad_boxes(text):
    with pytest.raises(ValueError):
        R.parse_bbox(text)


def test_box_ladder_and_cells():
    assert R.parse_bbox(" 1, 2,3,4 ") == R.Bbox(1, 2, 3, 4)
    assert R.pick_cell_size(R.Bbox(0, 0, 0.4, 1)) == 0.005
    assert R.pick_cell_size(R.Bbox(-180, -90, 180, 90)) == 5.0
    with pytest.raises(ValueError):
        R.check_cell_size(0.003)
    with pytest.raises(ValueError):
        R.check_cells(R.Bbox(0, 0, 1, 1), 0.0001)
    box = R.Bbox(0.001, 0.001, 0.011, 0.011)
    assert R.estimate_cells(box, 0.002) == 25 and R.most_cells(box, 0.002) == 49


@pytest.mark.parametrize(("low", "high"), [(1, None), (None, 1), (-1, 3), (5, 4), (3, 24)])
def test_bad_hours(low, high):
    with pytest.raises(ValueError):
        R.check_hours(low, high)


def test_limits_and_names():
    assert R.check_hours(None, None) is None and R.check_hours(0, 23) == (0, 23)
    assert R.check_metric(None) == "tracks"
    for call in (lambda: R.check_metric("x"), lambda: R.check_tolerance(0.5), lambda: R.check_tolerance(math.nan), lambda: R.check_limit(0), lambda: R.check_limit(501), lambda: R.check_hotspot(0, 1), lambda: R.check_hotspot(1, 0), lambda: R.check_hotspot(math.inf, 1), lambda: R.check_name(" \t\n"), lambda: R.check_name(None), lambda: R.check_name("x" * 201)):
        with pytest.raises(ValueError):
            call()
    assert R.check_name("  a\tb\r\nc ") == "a b c"


@pytest.mark.parametrize(
    ("geometry", "buffer_m"),
    [
        ({"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, None),
        ({"type": "Polygon", "coordinates": []}, None),
        ({"type": "Polygon", "coordinates": [SQUARE[:3]]}, None),
        ({"type": "Polygon", "coordinates": [SQUARE[:4]]}, None),
        ({"type": "Polygon", "coordinates": [[[0, 0], [math.nan, 0], [1, 1], [0, 0]]]}, None),
        ({"type": "Polygon", "coordinates": [[[0, 0], [190, 0], [1, 1], [0, 0]]]}, None),
        ({"type": "Polygon", "coordinates": [[[0, 0], [2, 2], [2, 0], [0, 2], [0, 0]]]}, None),  # a bow tie
        ({"type": "Polygon", "coordinates": [[[0, 0], [1, 1], [2, 2], [0, 0]]]}, None),  # no area
        ({"type": "Polygon", "coordinates": [[[k / 1000, (k % 2) / 10] for k in range(2000)] + [[0, 0]]]}, None),
        ({"type": "Point", "coordinates": [0, 0]}, None),
        ({"type": "Point", "coordinates": [0, 0]}, 0),
        ({"type": "Point", "coordinates": [0, 0]}, 50_001),
        (None, None),
    ],
)
def test_bad_regions(geometry, buffer_m):
    with pytest.raises(ValueError):
        R.parse_region(geometry, buffer_m)


def test_regions():
    assert R.parse_region({"type": "Polygon", "coordinates": [SQUARE, HOLE]}).vertex_count == 10
    assert R.parse_region({"type": "Polygon", "coordinates": SQUARE}).rings == R.parse_region({"type": "Polygon", "coordinates": [SQUARE]}).rings
    shifted = [[x + 10, y] for x, y in SQUARE]
    assert R.parse_region('{"type": "MultiPolygon", "coordinates": [[%s], [%s]]}' % (SQUARE, shifted)).vertex_count == 10
    assert R.rectangle((3, 4), (1, 2))["coordinates"][0][0] == [1, 2]
    assert R.polygon([(0, 0), (1, 1)]) is None and len(R.polygon([(0, 0), (1, 1), (1, 0)])["coordinates"][0]) == 4


def test_buffer_ring():
    ring = R.parse_region(R.point(116.3, 39.95), 1000.0).rings[0]
    assert len(ring) == 33 and all(abs(haversine_m(116.3, 39.95, *p) - 1000) < 1 for p in ring)
    scale = math.cos(math.radians(39.95)) * (math.pi * 6371008.8 / 180) ** 2
    area = abs(sum(a * d - c * b for a, b, c, d in edges_of([ring]))) / 2 * scale
    assert abs(area / (math.pi * 1e6) - 1) < 0.05


@given(degrees, degrees)
@settings(max_examples=200, deadline=None)
def test_haversine_is_symmetric(a, b):
    assert haversine_m(*a, *b) == pytest.approx(haversine_m(*b, *a), abs=1e-6)
    assert 0 <= haversine_m(*a, *b) <= 20_015_200


def test_degrees_cover_the_tolerance():
    for lat in (0, 40, 60, 85, 90):
        assert math.isfinite(degrees_for(50, lat)) and degrees_for(100, lat) == pytest.approx(2 * degrees_for(50, lat))
    for lat in (0, 40, 60):
        d = degrees_for(50, lat)
        assert haversine_m(10, lat, 10 + d, lat) >= 50 and haversine_m(10, lat, 10, lat + d) >= 50


def test_percent(spark):
    rows = spark.createDataFrame([(191, 279, 68.5), (289, 681, 42.4), (0, 0, 0.0), (250, 244, 100.0)], "a long, b long, want double")
    assert all(r.got == r.want for r in rows.select("want", percent(F.col("a"), F.col("b")).alias("got")).collect())


def test_gcj02(spark):
    lon, lat = to_gcj02(F.col("lon"), F.col("lat"))
    back = from_gcj02(lon, lat)
    rows = spark.createDataFrame([(116.397, 39.909), (-74.0, 40.7)], "lon double, lat double")
    got = rows.select("lon", "lat", (lon - F.col("lon")).alias("dx"), (lat - F.col("lat")).alias("dy"), haversine(F.col("lon"), F.col("lat"), *back).alias("off")).collect()
    assert got[0].dx == pytest.approx(0.006244, abs=1e-5) and got[0].dy == pytest.approx(0.001403, abs=1e-5) and got[0].off < 5
    assert (got[1].dx, got[1].dy, got[1].off) == (0, 0, 0)


def _inside(x, y, rings):
    odd = False
    for ax, ay, bx, by in edges_of(rings):
        if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def test_inside_against_a_loop(spark):
    region = R.parse_region({"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [5, 2], [4, 4], [2, 3], [0, 4], [0, 0]], HOLE]})
    grid = [(i / 4, j / 4) for i in range(-2, 23) for j in range(-2, 19)]
    got = spark.createDataFrame(grid, "x double, y double").select("x", "y", inside(F.col("x"), F.col("y"), region.rings).alias("z")).collect()
    assert all(r.z == _inside(r.x, r.y, region.rings) for r in got)
    assert {r.z for r in got if (r.x, r.y) in [(0, 0), (1, 1), (3, 2), (4, 2)]} == {True}
    assert not any(r.z for r in got if (r.x, r.y) == (2, 2))


def test_segments_meet_edges(spark):
    rings = R.parse_region({"type": "Polygon", "coordinates": [SQUARE]}).rings
    cases = [((-1, 2, 5, 2), True), ((-1, -1, 5, -1), False), ((-1, 0, 0, 0), True), ((1, 1, 2, 2), False), ((4, -2, 4, -1), False), ((3, 5, 5, 3), True), ((3, 5.1, 5.1, 3), False), ((1, 0, 2, 0), True)]
    rows = spark.createDataFrame([(*map(float, s), want) for s, want in cases], "a double, b double, c double, d double, want boolean")
    got = rows.select("want", crosses(F.col("a"), F.col("b"), F.col("c"), F.col("d"), rings).alias("z")).collect()
    assert all(r.z == r.want for r in got)
    assert bounds_of(rings) == (0, 0, 4, 4)


def test_validity_is_checked_by_tasks_of_a_bounded_number_of_regions(spark, monkeypatch):
    monkeypatch.setattr(regions_join, "TASK_REGIONS", 10)
    square = '{"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}'
    table = spark.range(95).select(F.col("id").alias("region_id"), F.when(F.col("id") % 5 > 0, square).alias("geometry")).coalesce(1)
    found = regions_join.validity(table)
    assert found.rdd.getNumPartitions() == 10 and {r.region_id: r.valid for r in found.collect()} == {i: i % 5 > 0 for i in range(95)}
