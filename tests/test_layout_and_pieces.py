"""Files by place, runs of tracks cut in pieces, and ranks in ranges."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from waymark.functions.regions import Bbox
from waymark.operators import hotspots, layout, stays
from waymark.operators.density import in_box

POINT = "track_id long, seq long, recorded_at timestamp, lon double, lat double"
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def plain_key(lon, lat):
    x, y = (min(max(int((v + s / 2) / s * 2**24), 0), 2**24 - 1) for v, s in ((lon, 360.0), (lat, 180.0)))
    return sum(((x >> b) & 1) << (2 * b) | ((y >> b) & 1) << (2 * b + 1) for b in range(24))


def test_keys_and_ranges(spark):
    rng = random.Random(3)
    places = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(300)] + [(180.0, 90.0), (-180.0, -90.0), (0.0, 0.0)]
    got = spark.createDataFrame(places, "lon double, lat double").select("lon", "lat", layout.place_key(F.col("lon"), F.col("lat")).alias("k")).collect()
    assert all(r.k == plain_key(r.lon, r.lat) for r in got) and len(got) == 303
    for west, south, wide, high in [(116.3, 39.95, 0.007, 0.008), (-180.0, -90.0, 360.0, 180.0), (-0.001, -0.001, 0.002, 0.002), (10.0, 10.0, 0.0, 0.0), (179.0, 89.0, 1.0, 1.0)]:
        box = Bbox(west, south, west + wide, south + high)
        ranges = layout.key_ranges(box)
        assert 1 <= len(ranges) <= layout.MOST_RANGES and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
        inside = [(west + wide * rng.random(), south + high * rng.random()) for _ in range(200)] + [(box.west, box.south), (box.east, box.north)]
        assert all(any(low <= plain_key(*p) <= high_ for low, high_ in ranges) for p in inside)
    assert layout.key_ranges(Bbox(-1.0, -1.0, 1.0, 1.0), most=1) == [(0, 2**48 - 1)]


def test_a_box_opens_few_files(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i % 7, i, T0, rng.uniform(100, 130), rng.uniform(20, 50)) for i in range(6000)]
    rows += [(8, i, T0 + dt.timedelta(seconds=i), 116.4, 39.9) for i in range(3000)]  # a third at one place
    rows += [(9, 1, T0, None, None), (9, 2, None, float("nan"), 1.0), (9, 3, T0, 116.41, 39.91)]
    points = spark.createDataFrame(rows, POINT)
    path = str(tmp_path / "points")
    layout.write_by_place(points, path, rows_per_file=500)
    kept = spark.read.parquet(path)
    assert kept.count() == len(rows)
    for box in (Bbox(116.39, 39.89, 116.42, 39.92), Bbox(103.0, 22.0, 106.0, 25.0), Bbox(1.0, 1.0, 2.0, 2.0)):
        want = sorted(map(tuple, in_box(points, box).collect()))
        got = layout.read_box(spark, path, box)
        assert got.columns == points.columns and sorted(map(tuple, got.collect())) == want
    files = kept.select(F.input_file_name()).distinct().count()
    box = Bbox(103.0, 22.0, 106.0, 25.0)
    opened = {r.folder for r in kept.select("folder").distinct().collect() if r.folder is not None}
    shift = 2 * (layout.BITS - layout.FOLDER_BITS)
    met = {f for f in opened if any(low >> shift <= f <= high >> shift for low, high in layout.key_ranges(box))}
    read = kept.where(F.col("folder").isin(sorted(met))).select(F.input_file_name()).distinct().count()
    assert read * 20 < files, (read, files)
    # The crowded place lies in several files.
    assert kept.where("lon = 116.4 and lat = 39.9").select(F.input_file_name()).distinct().count() >= 3
    plan = layout.read_box(spark, path, box)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan and "PushedFilters: [IsNotNull(lon)" in plan
    empty = str(tmp_path / "empty")
    layout.write_by_place(points.limit(0), empty)
    assert spark.read.schema(kept.schema).parquet(empty).count() == 0


@pytest.mark.parametrize("piece", [1, 5, 64])
def test_runs_do_not_depend_on_pieces(spark, piece):
    rng = random.Random(5)
    rows = []
    for track in (1, 2, None):
        at, seq = T0, -20
        for _ in range(150):
            rows.append((track, seq, at, 116.3 + rng.uniform(0, 3e-4), 39.9))
            at += dt.timedelta(seconds=rng.choice([30, 60, 299, 301, 900]) if track != 2 else 45)
            seq += rng.choice([1, 1, 2, 40])
    rows.append((1, None, T0 - dt.timedelta(seconds=30), 116.3, 39.9))
    slim = spark.createDataFrame(rows, POINT).select("track_id", "seq", F.unix_millis("recorded_at").alias("ms"), "lon", "lat").repartition(5)
    want = {}
    for track in (1, 2, None):
        mine = sorted((r for r in slim.collect() if r.track_id == track), key=lambda r: -(10**9) if r.seq is None else r.seq)
        run = 0
        for k, r in enumerate(mine):
            run += k > 0 and (r.ms - mine[k - 1].ms) // 1000 > 300
            want[track, r.seq] = run
    assert {(r.track_id, r.seq): r.run for r in stays.with_runs(slim, 300, piece).collect()} == want
    points = slim.select("track_id", "seq", F.timestamp_millis("ms").alias("recorded_at"), "lon", "lat").where("seq is not null and track_id is not null")
    assert sorted(map(tuple, stays.stay_points(points, piece=piece).collect())) == sorted(map(tuple, stays.stay_points(points).collect()))


def test_ranks_of_spots_alike(spark):
    rows = [(i, 1, 1, 300, float(i % 50), float(i % 7)) for i in range(3000)] + [(5000 + i, 2, 2 + i % 3, 900 - i, 1.0, 1.0) for i in range(40)]
    spots = spark.createDataFrame(rows, "spot long, track_count long, visit_count long, total_duration_s long, lat double, lon double").repartition(6)
    want = {r[0]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (-r[1], -r[2], -r[3], r[4], r[5], r[0])))}
    for each in (100, 50_000):
        placed = hotspots.ranked(spots, len(rows), each)
        assert {r.spot: r["rank"] for r in placed.collect()} == want
    most = max(r["count"] for r in hotspots.ranked(spots, len(rows), 100).groupBy("range").count().collect())
    assert most < 400
    assert hotspots.ranked(spots.limit(0), 0).count() == 0
