"""Validity of polygons, windows of time, and containment in many regions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.functions import regions as R
from waymark.functions.topology import fault, locate, meeting, orientation
from waymark.operators import density, hotspots, regions_join, within


def square(x, y, side):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]


BIG = square(0, 0, 10)
OVERLAP, CROSS, TOUCH = "polygons overlap", "edges cross or overlap", "a ring touches itself"
CASES = {
    "a square": ([[BIG]], None),
    "a hole": ([[BIG, square(2, 2, 2)]], None),
    "a hole outside its shell": ([[BIG, square(20, 2, 2)]], "a hole lies outside its shell"),
    "one polygon within another": ([[BIG], [square(2, 2, 2)]], OVERLAP),
    "an island in a hole": ([[BIG, square(2, 2, 6)], [square(3, 3, 2)]], None),
    "an island in the hole of an island": ([[BIG, square(1, 1, 8)], [square(2, 2, 6), square(3, 3, 4)], [square(4, 4, 2)]], None),
    "an island that touches its hole": ([[BIG, square(2, 2, 6)], [[(2, 2), (4, 3), (3, 4), (2, 2)]]], None),
    "corners touch": ([[square(0, 0, 1)], [square(1, 1, 1)]], None),
    "a shared edge": ([[square(0, 0, 1)], [square(1, 0, 1)]], CROSS),
    "a bow tie": ([[[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]]], CROSS),
    "a ring that touches itself": ([[[(0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 0)]]], TOUCH),
    "a spike": ([[[(0, 0), (4, 0), (4, 4), (4, 6), (4, 4), (0, 4), (0, 0)]]], TOUCH),
    "no area": ([[[(0, 0), (1, 1), (2, 2), (0, 0)]]], "a ring has no area"),
    "a hole that touches its shell once": ([[BIG, [(0, 0), (3, 1), (1, 3), (0, 0)]]], None),
    "a hole that touches its shell twice": ([[BIG, [(0, 5), (5, 0), (5, 5), (0, 5)]]], "the interior falls apart"),
    "holes that touch": ([[BIG, square(2, 2, 2), square(4, 4, 2)]], None),
    "holes that touch in a circle": ([[BIG, square(2, 2, 2), square(4, 4, 2), [(4, 2), (6, 4), (7, 1), (4, 2)]]], "the interior falls apart"),
    "a hole in a hole": ([[BIG, square(2, 2, 5), square(3, 3, 2)]], "holes overlap"),
    "a hole twice": ([[BIG, square(2, 2, 5), square(2, 2, 5)]], CROSS),
    "rings that cross at vertices": ([[square(0, 0, 4)], [[(2, -2), (4, 0), (2, 2), (0, 0), (2, -2)]]], OVERLAP),
    "a chord between two vertices": ([[BIG], [[(0, 0), (10, 10), (5, 5.5), (0, 0)]]], OVERLAP),
    "repeated points": ([[[(0, 0), (0, 0), (4, 0), (4, 4), (4, 4), (0, 4), (0, 0)]]], None),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("turned", [False, True])
def test_validity(name, turned):
    polygons, want = CASES[name]
    assert fault([[ring[::-1] if turned else ring for ring in polygon] for polygon in polygons]) == want
    geometry = {"type": "MultiPolygon", "coordinates": [[[list(p) for p in ring] for ring in polygon] for polygon in polygons]}
    if want:
        with pytest.raises(ValueError, match=want):
            R.parse_region(geometry)
    else:
        assert len(R.parse_region(geometry).rings) == sum(map(len, polygons))


def test_orientation_is_exact():
    a, b = (116.3, 39.9), (116.30000000000001, 39.90000000000001)
    assert orientation(a, b, a) == orientation(a, b, b) == 0
    third = (math.nextafter(b[0], 0), b[1])
    assert orientation(a, b, third) == 1 and orientation(b, a, third) == -1
    assert meeting((0, 0), (2, 0), (1, 0), (1, 5)) == (1, 0) and meeting((0, 0), (2, 0), (3, 0), (4, 0)) is None and meeting((0, 0), (2, 0), (2, 0), (4, 0)) == (2, 0)
    assert meeting((0, 0), (2, 0), (1, 0), (4, 0)) == "overlap" and meeting((0, 0), (2, 2), (0, 2), (2, 0)) == "cross"


@pytest.mark.parametrize("zone", ["UTC", "Asia/Shanghai", "America/New_York"])
def test_windows_name_instants_whatever_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        at = spark.createDataFrame([(1, 1704067200), (2, 1704067201), (3, 1704096000)], "track_id long, s long").withColumn("recorded_at", F.timestamp_seconds("s"))
        both = at.withColumns({"start_time": F.col("recorded_at"), "end_time": F.col("recorded_at")})
        ids = lambda df: sorted(r.track_id for r in df.collect())
        for start, end in (("2024-01-01T00:00:01Z", "2024-01-01T07:59:59Z"), ("2024-01-01T08:00:01+08:00", "2023-12-31T23:00:00-08:00")):
            assert ids(density.in_window(at, start, end)) == ids(within.overlapping(both, start, end)) == ids(hotspots.within_time(both, start, end)) == [2]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_times_without_an_offset_are_refused(spark):
    at = spark.range(1).select(F.timestamp_seconds(F.lit(0)).alias("recorded_at"), F.timestamp_seconds(F.lit(0)).alias("start_time"), F.timestamp_seconds(F.lit(0)).alias("end_time"))
    for call in (density.in_window, within.overlapping, hotspots.within_time):
        for window in (("2024-01-01 00:00:00", None), (None, "2024-01-01T00:00:00"), ("2024-01-01", "2024-01-02T00:00:00Z")):
            with pytest.raises(ValueError, match="offset"):
                call(at, *window)
    with pytest.raises(ValueError, match="offset"):
        R.check_window("2024-01-01T00:00:00", "2024-01-02T00:00:00Z")
    with pytest.raises(ValueError, match="after"):
        R.check_window("2024-01-02T08:00:01+08:00", "2024-01-02T00:00:00Z")


REGIONS = "region_id long, rings array<array<struct<x:double,y:double>>>"


def test_many_regions_against_a_test_of_every_ring(spark):
    rng = random.Random(5)
    regions = []
    for k in range(60):
        x, y, size = rng.uniform(-1, 1), rng.uniform(-1, 1), 10 ** rng.uniform(-3.5, 0.5)
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randint(3, 40)))
        ring = [(x + size * rng.uniform(0.2, 1) * math.cos(t), y + size * rng.uniform(0.2, 1) * math.sin(t)) for t in turns]
        rings = [[*ring, ring[0]]]
        if k % 3 == 0:
            rings += [square(x, y, size / 4), square(x + size / 16, y + size / 16, size / 8)]
        regions.append((k, rings))
    # Edges and corners on the borders of cells, level and upright edges, crossing rings, and nothing.
    regions += [(100, [square(0, 0, 0.0512)]), (101, [square(-0.0256, 0.0128, 0.0256)]), (102, [[(0, 0), (1, 1), (1, 0), (0, 1), (0, 0)]]), (103, []), (104, None), (105, [square(0.1, 0.1, 0)])]
    points = [(i, rng.uniform(-1.2, 1.2), rng.uniform(-1.2, 1.2)) for i in range(1500)]
    points += [(2000 + i, x, y) for i, (x, y) in enumerate(p for _, rings in regions for r in rings or [] for p in [*r, ((r[0][0] + r[1][0]) / 2, r[0][1])])]
    points += [(9000 + 20 * i + j, i * 0.0064, j * 0.0064) for i in range(20) for j in range(20)] + [(1, None, 0.0), (2, 0.0, None)]
    real = lambda v: v if v is None else float(v)
    points = [(i, real(x), real(y)) for i, x, y in points]
    regions = [(k, rings and [[(float(x), float(y)) for x, y in r] for r in rings]) for k, rings in regions]
    want = set()
    for i, x, y in points:
        if x is None or y is None:
            continue
        for k, rings in regions:
            sides = [locate((x, y), r) for r in rings or []]
            if 0 in sides or sum(s > 0 for s in sides) % 2:
                want.add((i, k))
    table = spark.createDataFrame(points, "track_id long, lon double, lat double").repartition(4).withColumns({"level": F.lit(7), "edges": F.lit("x"), "region_id": F.lit("y")})
    got = [(r.track_id, r.region_id) for r in regions_join.contained(table, spark.createDataFrame(regions, REGIONS)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 2000
    counts = {r.region_id: (r.points, r.tracks) for r in regions_join.region_counts(table, spark.createDataFrame(regions, REGIONS)).collect()}
    assert counts[100][0] == sum(k == 100 for _, k in want)
    empty = spark.createDataFrame([], REGIONS)
    assert regions_join.contained(table, empty).count() == 0 and regions_join.contained(table.limit(0), spark.createDataFrame(regions, REGIONS)).count() == 0


def test_inner_cells_hold_no_edges(spark):
    index = regions_join.grid_index(spark.createDataFrame([(1, [square(0.00001, 0.00001, 0.5)])], REGIONS))
    rows = index.collect()
    assert 64 <= len(rows) <= 400 and sum(r.full for r in rows) > len(rows) / 3
    assert all((r.edges is None) == r.full for r in rows) and max(len(r.edges) for r in rows if r.edges) <= 3


def test_validity_of_a_table(spark):
    rows = [(i, R.json.dumps({"type": "MultiPolygon", "coordinates": polygons})) for i, (polygons, _) in enumerate(CASES.values())] + [(100, None), (101, "{"), (102, '{"type": "Point", "coordinates": [0, 0]}')]
    got = {r.region_id: r for r in regions_join.validity(spark.createDataFrame(rows, "region_id long, geometry string")).collect()}
    assert [got[i].valid for i in range(len(CASES))] == [want is None for _, want in CASES.values()]
    assert not any(got[i].valid for i in (100, 101, 102)) and all((r.reason is None) == r.valid for r in got.values())


def test_regions_meet_places_and_words_of_tracks(spark):
    """A hundred and thirty tracks on one way, each there twice, and one without a number: rows are those of places and words, counts those of points and tracks."""
    rows = [(t if t else None, 0.5 + i / 10, 0.5) for t in range(130) for i in (0, 1, 2, 0)] + [(7, 5.0, 5.0), (8, None, 1.0)]
    table = spark.createDataFrame(rows, "track_id long, lon double, lat double")
    seen = regions_join.by_place(table)
    assert seen.count() <= 3 * 4 + 1 and seen.agg(F.sum("n")).first()[0] == 521
    regions = spark.createDataFrame([(1, [square(0.0, 0.0, 1.0)]), (2, [square(0.55, 0.0, 1.0)]), (3, [square(4.0, 4.0, 3.0)]), (4, [square(20.0, 20.0, 1.0)])], REGIONS)
    got = {r.region_id: (r.points, r.tracks) for r in regions_join.region_counts(table, regions).collect()}
    plain = {r.region_id: (r.points, r.tracks) for r in regions_join.contained(table, regions).groupBy("region_id").agg(F.count("*").alias("points"), F.countDistinct(F.coalesce("track_id", F.lit(-1))).alias("tracks")).collect()}
    assert got == plain == {1: (520, 130), 2: (260, 130), 3: (1, 1)}


def test_regions_of_one_shape_are_counted_once(spark, monkeypatch):
    """Copies of regions add no rows to the index, tracks of several wide words are counted whole, and rows of one id are one region."""
    wrote = {}

    def counted(df, name, real=regions_join.materialize):
        out = real(df, name)
        wrote.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(regions_join, "materialize", counted)
    rows = [(t, 0.05 * ((t + i) % 20), 0.5) for t in range(1300) for i in (0, 3)]
    table = spark.createDataFrame(rows, "track_id long, lon double, lat double")
    shapes = [[square(0.0, 0.0, 1.0)], [square(0.3, 0.4, 0.33)], [square(0.0, 0.0, 1.0), square(0.25, 0.25, 0.5)], [square(30.0, 30.0, 1.0)]]
    parted = [(900, [square(0.0, 0.0, 1.0)]), (900, [square(0.25, 0.25, 0.5)]), (901, None), (None, shapes[0])]
    for copies in (1, 25):
        regions = spark.createDataFrame([(4 * c + k, r) for c in range(copies) for k, r in enumerate(shapes)] + parted, REGIONS)
        got = {r.region_id: (r.points, r.tracks) for r in regions_join.region_counts(table, regions).collect()}
        plain = {r.region_id: (r.points, r.tracks) for r in regions_join.contained(table, regions).where("region_id is not null").groupBy("region_id").agg(F.count("*").alias("points"), F.countDistinct("track_id").alias("tracks")).collect()}
        assert got == plain and len(got) == 3 * copies + 1 and got[0] == (2600, 1300) and got[900] == got[2] != got[0]
    # contained() writes an index of all copies, the second of each two.
    one, many = wrote["grid-index"][0], wrote["grid-index"][2]
    assert one == many and wrote["grid-index"][3] > 3 * wrote["grid-index"][1]
