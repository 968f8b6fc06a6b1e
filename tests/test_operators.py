"""Operators on small tables whose results are known."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.functions import regions as R
from waymark.operators import clean, density, hotspots, similarity, stays, tracks, within
from waymark.operators.graph import components

T0 = dt.datetime(2024, 1, 1, 9, 0, 0)
METRE = 1 / 111195.0
POINTS = "track_id long, seq long, recorded_at timestamp, lon double, lat double, elevation_m double"


def points(spark, rows):
    """rows: (track, second, metres north, metres east, elevation)."""
    seq, out = {}, []
    for t, s, north, east, e in rows:
        seq[t] = seq.get(t, -1) + 1
        out.append((t, seq[t], T0 + dt.timedelta(seconds=s), 0.0 + east * METRE, north * METRE, e))
    return spark.createDataFrame(out, POINTS)


def test_fast_but_steady_is_no_outlier_and_spikes_are(spark):
    steady = [(1, 10 * i, 300.0 * i, 0, None) for i in range(10)]
    spike = [(2, 10 * i, 10.0 * i + (900 if i == 5 else 0), 0, None) for i in range(10)]
    got = clean.with_outliers(clean.with_step(points(spark, steady + spike))).where("is_outlier").orderBy("seq").collect()
    assert [(r.track_id, r.seq) for r in got] == [(2, 4), (2, 5), (2, 6)]


def test_median_and_threshold(spark):
    steps, rows, at = [1, 2, 4, 10], [(1, 0, 0.0, 0, None)], 0.0
    for i, v in enumerate(steps):
        at += v * 10
        rows.append((1, 10 * (i + 1), at, 0, None))
    assert clean.speed_threshold(clean.with_step(points(spark, rows))).first().threshold == pytest.approx(9.0, abs=1e-3)
    still = points(spark, [(1, 0, 0.0, 0, None), (1, 10, 0.0, 0, None)])
    assert clean.speed_threshold(clean.with_step(still)).first().threshold == 8.0


def test_equal_times_have_no_speed_and_keep_their_order(spark):
    rows = points(spark, [(1, 10, 0.0, 0, None), (1, 0, 5.0, 0, None), (1, 0, 6.0, 0, None)])
    got = clean.with_step(clean.clean_sequence(rows)).orderBy("seq").collect()
    assert [round(r.lat / METRE) for r in got] == [5, 6, 0] and got[1].speed_mps is None and got[0].step_m == 0


def test_elevation_of_one_value_is_taken_out(spark):
    rows = [(1, i, 0.0, 0, 7.0) for i in range(3)] + [(2, i, 0.0, 0, 7.0 if i else None) for i in range(3)] + [(3, i, 0.0, 0, None) for i in range(3)] + [(4, i, 0.0, 0, float(i)) for i in range(3)]
    got = points(spark, rows).select("track_id", clean.normalized_elevation().alias("e")).groupBy("track_id").agg(F.count("e").alias("n")).collect()
    assert {r.track_id: r.n for r in got} == {1: 0, 2: 2, 3: 0, 4: 3}


def test_tracks_of_one_point_are_not_cleaned(spark):
    assert clean.clean_track(points(spark, [(1, 0, 0.0, 0, None)])).count() == 0


def test_value_at_and_playback(spark):
    p = points(spark, [(1, 0, 0.0, 0, 10.0), (1, 10, 0.0, 0, None), (1, 20, 0.0, 0, 30.0)])
    epoch = int(T0.replace(tzinfo=dt.timezone.utc).timestamp())
    for second, want in ((-5, 10.0), (5, 15.0), (20, 30.0), (99, 30.0)):
        assert clean.value_at(p, F.lit(epoch + second)).first().value == pytest.approx(want)
    r = clean.playback_stats(p).first()
    assert (r.can_play, r.span_s, r.multiplier) == (True, 20.0, 1.0)


def _naive_stays(rows, diameter=50.0, least=300, gap=300):
    from waymark.functions.geo import haversine_m

    out, i = [], 0
    while i < len(rows):
        j, held = i, None
        while j + 1 < len(rows) and rows[j + 1][0] - rows[j][0] <= gap:
            part = rows[i : j + 2]
            lon, lat = sum(p[1] for p in part) / len(part), sum(p[2] for p in part) / len(part)
            radius = max(haversine_m(lon, lat, p[1], p[2]) for p in part)
            if 2 * radius > diameter:
                break
            j, held = j + 1, radius
        if j > i and rows[j][0] - rows[i][0] >= least:
            out.append((i, j, held))
            i = j + 1
        else:
            i += 1
    return out


def test_stays(spark):
    walk = [(1, 10 * i, 15.0 * i, 0, None) for i in range(60)]
    stay = [(1, 600 + 10 * i, 885.0 + (i % 3), 0, None) for i in range(50)]
    late = [(1, 1090 + 301 + 100 * i, 885.0, 0, None) for i in range(4)]
    p = points(spark, walk + stay + late)
    got = stays.stay_points(p).orderBy("seq_start").collect()
    rows = [(int((r.recorded_at - T0).total_seconds()), r.lon, r.lat) for r in p.orderBy("seq").collect()]
    want = _naive_stays(rows)
    assert [(r.seq_start, r.seq_end) for r in got] == [w[:2] for w in want] and len(want) == 2
    assert [r.radius_m for r in got] == pytest.approx([w[2] for w in want], abs=1e-6)
    assert got[1].duration_s == 300 and got[0].duration_s == (got[0].end_time - got[0].start_time).total_seconds()
    assert stays.stay_points(p.limit(0)).count() == 0


def stay_table(spark, rows):
    """rows: (track, first seq, metres north)."""
    return spark.createDataFrame(
        [(t, s, s + 9, T0 + dt.timedelta(hours=s), T0 + dt.timedelta(hours=s, minutes=6), 360, 0.0, m * METRE, 5.0, 10) for t, s, m in rows], stays.SCHEMA
    )


def test_hotspots_of_equal_centres_rank_by_longitude(spark):
    """Forty spots of the same latitudes, visited in different orders: sums of doubles differ by their order, ranks must not."""
    rng, rows = random.Random(5), []
    lats = [39.95 + 1e-4 * rng.random() for _ in range(7)]
    for spot in range(40):
        rng.shuffle(lats)
        rows += [(spot * 10 + i, 0, T0, T0, 300, 116.0 + spot * 0.01, lat) for i, lat in enumerate(lats)]
    table = spark.createDataFrame(rows, "track_id long, seq_start long, start_time timestamp, end_time timestamp, duration_s int, center_lon double, center_lat double")
    got = hotspots.hotspots(table).orderBy("rank").collect()
    assert len({r.center_lat for r in got}) == 1 and [r.track_ids[0] // 10 for r in got] == list(range(40))


def test_hotspots_chain_and_count(spark):
    table = stay_table(spark, [(1, 0, 0), (2, 0, 150), (3, 0, 300), (4, 0, 5000), (4, 20, 5010), (4, 40, 5020), (9, 0, 90000)])
    got = hotspots.hotspots(table).orderBy("rank").collect()
    assert [(r.visit_count, r.track_count, r.track_ids) for r in got] == [(3, 3, [1, 2, 3]), (3, 1, [4])]
    assert got[0].radius_m == pytest.approx(150, abs=0.5) and got[1].total_duration_s == 1080
    assert hotspots.hotspots(table, min_visits=1).count() == 3
    assert hotspots.hotspots(table.limit(0)).count() == 0
    inside = hotspots.within_time(table, str(T0 + dt.timedelta(hours=1)) + "Z", str(T0 + dt.timedelta(hours=20, minutes=6)) + "Z")
    assert [r.seq_start for r in inside.collect()] == [20]
    with pytest.raises(ValueError):
        hotspots.hotspots(table, radius_m=float("nan"))


def test_stays_200_metres_apart_across_latitudes(spark):
    rows = [(k, 0, lat * 111195.0 + d) for k, (lat, d) in enumerate([(0.0009, 0), (0.0009, 199.9), (60.0, 0), (60.0, 199), (84.9, 0), (84.9, 198)])]
    assert hotspots.near_pairs(stay_table(spark, rows).withColumn("stay_id", F.col("track_id")), 200.0).count() == 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_density_ties_and_totals(spark):
    p = spark.createDataFrame([(1, 0, T0, 0.0025, 0.0015, None), (1, 1, T0, 0.0035, 0.0015, None), (2, 0, T0, 116.4095, 0.0, None)], POINTS)
    want = {(round(x / 0.001), round(y / 0.001), 1, 1) for x, y in ((0.0025, 0.0015), (0.0035, 0.0015), (116.4095, 0.0))}
    assert (116409, 0, 1, 1) in want  # 116.4095 / 0.001 lies below the half
    assert {(r.nx, r.ny, r.points, r.tracks) for r in density.cells(p, 0.001).collect()} == want
    box = R.Bbox(0, 0, 0.1, 0.1)
    d = density.density(p, box, 0.001)
    s = density.summary(d).first()
    assert (s.cells, s.points, s.max_tracks) == (2, 2, 1)
    assert density.summary(density.density(p, R.Bbox(10, 10, 10.1, 10.1), 0.001)).first().cells == 0
    assert {r.hour for r in p.select(F.hour(F.from_utc_timestamp("recorded_at", "Asia/Shanghai")).alias("hour")).collect()} == {17}
    assert density.density(p, box, 0.001, hour_from=17, hour_to=17).count() == 2 and density.density(p, box, 0.001, hour_from=9, hour_to=9).count() == 0


def test_similarity_matches_a_nested_loop(spark):
    from waymark.functions.geo import haversine_m

    rows = [(t, 10 * i, 20.0 * i + 7 * t, 30.0 * t * (i % 3), None) for t in range(4) for i in range(12)]
    p = points(spark, rows)
    by = {}
    for r in p.collect():
        by.setdefault(r.track_id, []).append((r.lon, r.lat))
    got = {(r.a_track, r.b_track): (r.a_hit, r.b_hit) for r in similarity.scores(p, None, 50.0).collect()}
    near = lambda a, b: haversine_m(*a, *b) <= 50
    want = {(a, b): (sum(any(near(x, y) for y in by[b]) for x in by[a]), sum(any(near(x, y) for x in by[a]) for y in by[b])) for a in by for b in by if a < b}
    assert got == {k: v for k, v in want.items() if v[0]}
    one = {r.b_track: r for r in similarity.scores(p, 0, 50.0).collect()}
    back = {r.b_track: r for r in similarity.scores(p, 1, 50.0).collect()}
    assert one[1].forward == back[0].reverse and one[1].similarity == min(one[1].forward, one[1].reverse) == back[0].similarity
    wider = {r.b_track: r.similarity for r in similarity.scores(p, 0, 90.0).collect()}
    assert all(wider[k] >= r.similarity for k, r in one.items())


def test_within(spark):
    p = points(spark, [(1, 0, 0.0, -500, None), (1, 60, 0.0, 500, None), (2, 0, 10.0, 0, None), (2, 60, 5000.0, 0, None), (3, 0, 9000.0, 0, None), (3, 60, 9900.0, 0, None)])
    t = clean.track_summary(p).withColumns({"source": F.lit("gpx"), "name": F.lit("x")})
    region = R.parse_region(R.point(0.0, 0.0), 100.0)
    found = within.matched(p, t, region)
    assert {r.track_id: r.inside_count for r in found.collect()} == {1: 0, 2: 1}
    total = within.stats(found).where("source is null").first()
    assert total.track_count == 2 and [r.track_id for r in within.items(found, 1).collect()] == [2]
    far = within.matched(p, t, region, "2030-01-01T00:00:00Z", "2031-01-01T00:00:00Z")
    assert far.count() == 0 and within.stats(far).where("source is null").first()[1] in (0, None)


def test_names(spark):
    rows = spark.createDataFrame([(" a\tb ",), ("",), (None,), ("..",), ("a/b",), ("y" * 300,)], "raw string")
    got = rows.select(tracks.normalize_name(F.col("raw")).alias("n"), tracks.safe_file_name(F.col("raw")).alias("f")).collect()
    assert [r.n for r in got] == ["a b", None, None, "..", "a/b", None]
    assert [r.f for r in got][1:5] == ["unnamed", "unnamed", "unnamed", "a_b"] and len(got[5].f) == 80


def test_scratch_tables_are_deleted(spark):
    import os

    from waymark.operators.storage import materialize, scratch, shared_dir

    folder = f"{shared_dir(spark)}/waymark".removeprefix("file:")
    outer = materialize(spark.range(3), "outer-kept")
    before = set(os.listdir(folder))
    with pytest.raises(KeyError), scratch(spark):
        assert materialize(spark.range(5), "inner").count() == 5 and set(os.listdir(folder)) > before
        raise KeyError
    assert set(os.listdir(folder)) == before and outer.count() == 3


def test_links_connect_what_near_pairs_connect(spark):
    rng = random.Random(3)
    spots = [(0.0, 0.0), (116.3, 39.9), (10.0, 80.0), (-70.0, -65.0)]
    rows = [(i, lon + rng.gauss(0, 0.003) / max(0.2, math.cos(math.radians(lat))), lat + rng.gauss(0, 0.003)) for i, (lon, lat) in enumerate(rng.choice(spots) for _ in range(400))]
    rows += [(1000 + i, 5.0, 5.0) for i in range(20)]
    stays_ = spark.createDataFrame(rows, "stay_id long, center_lon double, center_lat double")
    from waymark.operators.graph import components

    root = lambda edges: {r.node: r.root for r in components(edges).collect()}
    assert root(hotspots.links(stays_, 200.0)) == root(hotspots.near_pairs(stays_, 200.0))
    assert hotspots.links(stays_, 200.0).count() < hotspots.near_pairs(stays_, 200.0).count()


def test_similarity_at_high_latitudes(spark):
    rows = [(t, s, T0, 20.0 + 0.0001 * s, lat + t * 0.0004, None) for lat in (80.0,) for t in range(2) for s in range(5)]
    p = spark.createDataFrame(rows, POINTS)
    assert similarity.scores(p, None, 50.0).first().similarity == 100.0


def test_datum_shift_and_wkt():
    from waymark.functions import geo, regions

    lon, lat = geo.shift_place(116.4, 39.9)
    assert abs(lon - 116.406245) < 1e-4 and abs(lat - 39.901403) < 1e-4 and geo.shift_place(10.0, 50.0) == (10.0, 50.0)
    back = geo.shift_place(lon, lat, False)
    assert abs(back[0] - 116.4) < 1e-4 and abs(back[1] - 39.9) < 1e-4
    shape = {"type": "Polygon", "coordinates": [[[116.0, 39.0], [117.0, 39.0], [117.0, 40.0], [116.0, 39.0]]]}
    moved = geo.shift_geometry(shape)
    assert moved["coordinates"][0][0] == list(geo.shift_place(116.0, 39.0)) and geo.shift_geometry({"type": "Point", "coordinates": [1, 2]})["coordinates"] == [1, 2]
    assert geo.shift_geometry({"type": "MultiPolygon", "coordinates": [shape["coordinates"]]})["coordinates"][0] == moved["coordinates"]
    box = regions.shift_box(regions.Bbox(116.0, 39.0, 117.0, 40.0), False)
    d = geo.gcj02_offset_at(116.5, 39.5)
    assert box.west == 116.0 - d[0] and box.north == 40.0 - d[1]
    assert [regions.plain(v) for v in (1e-5, 100.0, -0.0, 1e16, 116.25)] == ["0.00001", "100", "0", "10000000000000000", "116.25"]
    assert regions.wkt(shape) == "POLYGON((116 39,117 39,117 40,116 39))" and regions.wkt({"type": "Point", "coordinates": [1e-7, 2]}) == "POINT(0.0000001 2)"
    assert regions.wkt({"type": "MultiPolygon", "coordinates": [shape["coordinates"]]}) == "MULTIPOLYGON(((116 39,117 39,117 40,116 39)))"
