"""Every registered query against its SQL on the small tables; files, the store and streams."""

import datetime as dt
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from waymark.engine import Engine, ExportFailed, TrackConflict, TrackNotFound
from waymark.operators.tracks import import_report
from waymark.plans import oracle, queries
from waymark.sources.files import content_hash, parse_any, parse_gpx, parse_plt, sniff, unreadable
from waymark.streaming import trips

SMALL = "/root/testdata/sf0.001"
HEAD = "Geolife trajectory\nWGS 84\nAltitude is in Feet\nReserved 3\n0,2,255,My Track,0,0,2,8421376\n0\n"


def plt(rows, lat=39.9):
    t = dt.datetime(2024, 3, 1, 8)
    return HEAD + "".join(f"{lat + i / 1e4:.6f},116.3,0,{100 + i},39744.1,{(t + dt.timedelta(seconds=30 * i)):%Y-%m-%d,%H:%M:%S}\n" for i in range(rows))


GPX = '<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><name> Loop </name><trkseg><trkpt lat="39.9" lon="116.3"><ele>5.5</ele><time>2024-03-01T08:00:00Z</time></trkpt><trkpt lat="x" lon="1"><time>2024-03-01T08:00:01Z</time></trkpt><trkpt lat="91" lon="1"><time>2024-03-01T08:00:01Z</time></trkpt><trkpt lat="39.9" lon="116.3"/></trkseg><trkseg><trkpt lat="39.91" lon="116.3"><time>2024-03-01T16:01:00+08:00</time></trkpt></trkseg></trk></gpx>'


def normal(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0 if isinstance(v, float) else v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("events", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no tables here")
@pytest.mark.parametrize("name", list(queries.queries()))
def test_query_against_sql(spark, duck, name):
    got = queries.queries()[name](spark, SMALL)
    cols = sorted(got.columns)
    result = duck.execute(oracle.oracle_sql()[name])
    at = {c[0]: i for i, c in enumerate(result.description)}
    assert sorted(at) == cols
    assert sorted(tuple(normal(r[c]) for c in cols) for r in got.collect()) == sorted(tuple(normal(r[at[c]]) for c in cols) for r in result.fetchall())


def test_sniffing_and_parsing(spark):
    rows = [("a", plt(3)), ("b", GPX), ("c", "hello"), ("d", None), ("e", HEAD), ("f", "39.9,200,0,1,1,2024-03-01,08:00:00\n39.9,116,0,?,1,2024-03-01,08:00:00\n")]
    files = spark.createDataFrame(rows, "file string, value string")
    assert {r.file: r.kind for r in files.select("file", sniff(F.col("value")).alias("kind")).collect()} == {"a": "geolife", "b": "gpx", "c": "unknown", "d": "unknown", "e": "unknown", "f": "geolife"}
    p = parse_plt(files.where("file in ('a', 'f')")).orderBy("file", "line").collect()
    assert len(p) == 4 and p[0].line == 6 and p[0].elevation_m == pytest.approx(30.48) and p[3].elevation_m is None
    g = parse_gpx(files.where("file = 'b'")).orderBy("line").collect()
    assert [(r.lat, r.elevation_m, r.name, r.recorded_at) for r in g] == [(39.9, 5.5, "Loop", dt.datetime(2024, 3, 1, 8)), (39.91, None, "Loop", dt.datetime(2024, 3, 1, 8, 1))]
    assert parse_any(files).count() == 6
    assert {(r.file, r.reason) for r in unreadable(files).collect()} == {("c", "unknown format"), ("d", "unknown format"), ("e", "unknown format")}
    assert len(files.select(content_hash(F.col("value")).alias("h")).first().h) == 32


def test_gpx_of_odd_segments_and_times(spark):
    point = lambda k, t="2024-03-01T08:00:00Z": f'<trkpt lat="39.{k}" lon="116.3"><time>{t}</time></trkpt>'
    gpx = lambda inner: f'<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1">{inner}</gpx>'
    times = ["2024-03-01T08:00:00", "2024-03-01", "2024-03-01 08:00:00Z", "2024-03-01 08:00:00", "2024-03-01T08:00Z", "2024-03-01t08:00:00.5z", "2024-03-01T08:00:00+08:00"]
    rows = [
        ("empty segment", gpx(f"<trk><trkseg>{point(1)}</trkseg><trkseg></trkseg></trk>")), ("short segment", gpx(f"<trk><trkseg/><trkseg>{point(1)}{point(2)}</trkseg></trk>")),
        ("no segment", gpx(f"<trk><name>a</name></trk><trk><trkseg>{point(1)}</trkseg></trk>")), ("bare track", gpx(f"<trk/><trk><trkseg>{point(1)}</trkseg></trk>")),
        ("nothing", gpx("<trk/>")), ("times", gpx("<trk><trkseg>" + "".join(point(k, t) for k, t in enumerate(times)) + "</trkseg></trk>")),
    ]
    got = parse_gpx(spark.createDataFrame(rows, "file string, value string")).groupBy("file").agg(F.sort_array(F.collect_list("line")).alias("lines")).collect()
    assert {r.file: len(r.lines) for r in got} == {"empty segment": 1, "short segment": 2, "no segment": 1, "bare track": 1, "times": 3}
    assert next(r.lines for r in got if r.file == "times") == [4, 5, 6]


ZONED = ["plt_parse", "gpx_parse", "hour_filter", "date_filter", "density_morning", "track_summary", "stay_points", "hotspots", "similarity_topk", "geojson_export", "trip_sessions", "within_stats", "cells_except", "random_points_near", "demo_points"]


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no tables here")
@pytest.mark.parametrize("zone", ["Asia/Kathmandu", "America/New_York"])
def test_results_do_not_depend_on_the_session_zone(spark, duck, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for name in ZONED:
            test_query_against_sql(spark, duck, name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_store(spark, tmp_path):
    store, inbox = Engine(spark, str(tmp_path / "store")), tmp_path / "in"
    (inbox / "deep").mkdir(parents=True)
    (inbox / "one.plt").write_text(plt(40))
    (inbox / "deep/two.plt").write_text(plt(40, 39.9001))
    (inbox / "copy.plt").write_text(plt(40))
    (inbox / "bad.plt").write_text("nothing")
    (inbox / "loop.gpx").write_text(GPX)
    assert store.health()["status"] == "ok" and store.list_tracks().count() == 0 and store.hotspots().count() == 0
    done = {os.path.basename(r.file): r.action for r in store.import_dir(str(inbox)).collect()}
    assert done == {"one.plt": "skip", "copy.plt": "insert", "deep/two.plt".split("/")[1]: "insert", "bad.plt": "unreadable", "loop.gpx": "insert"}
    assert {os.path.basename(r.file): r.action for r in store.import_dir(str(inbox)).collect()}["copy.plt"] == "skip"
    by = {r.name: r for r in store.list_tracks().collect()}
    assert set(by) == {"copy", "two", "Loop"} and by["copy"].point_count == 40 and by["Loop"].source == "gpx"
    one = by["copy"].track_id
    head, rows = store.track_detail(one)
    assert head.count() == 1 and [r.seq for r in rows.collect()] == list(range(40))
    assert [r.name for r in store.similarity(one).collect()][0] == "two"
    assert store.density("116.2,39.8,116.4,40.0", metric="points").agg(F.sum("value")).first()[0] == 82
    found, total, answer = store.within({"type": "Point", "coordinates": [116.3, 39.9]}, 200.0, limit=2)
    assert found.count() == 2 and (answer.first().total_hits, answer.first().truncated) == (3, True) and "Polygon" in answer.first().geometry
    found, total, answer = store.within({"type": "Point", "coordinates": [116.3, 39.9]}, 200.0, limit=3)
    assert not answer.first().truncated
    with pytest.raises(ValueError, match="after its end"):
        store.within({"type": "Point", "coordinates": [116.3, 39.9]}, 200.0, start="2024-02-01T00:00:00Z", end="2024-01-01T00:00:00Z")
    assert {r.compared for r in store.similarity(one).collect()} == {store.similarity(one).count()} and store.similarity(one, min_similarity=100.1).count() == 0
    report = import_report(store.import_dir(str(inbox)))
    assert (report["files"], report["imported"], report["skipped"], report["failed"]) == (5, 0, 4, 1) and len(report["errors"]) == 1
    fenced = Engine(spark, str(tmp_path / "fenced"), import_roots=[str(inbox / "deep"), " "])
    assert import_report(fenced.import_dir(str(inbox / "deep")))["imported"] == 1
    for place in (str(inbox), str(inbox / "deep/../"), str(inbox) + "/deeper"):
        with pytest.raises(ValueError, match="allowed"):
            fenced.import_dir(place)
    with pytest.raises(ValueError, match="allowed"):
        Engine(spark, str(tmp_path / "fenced"), import_roots=[]).import_dir(str(inbox))
    assert found.count() == 3 and total.where("source is null").first().track_count == 3
    assert store.stay_points(one).count() == 0
    with pytest.raises(ValueError):
        store.import_file(str(inbox / "bad.plt"))
    (inbox / "again.plt").write_text(plt(41))
    with pytest.raises(TrackConflict):
        store.import_file(str(inbox / "again.plt"), name="two")
    assert store.import_file(str(inbox / "again.plt"), mode="replace", replace_id=one).first().action == "replace"
    assert store.list_tracks().where(F.col("track_id") == one).first().point_count == 41 and store.points().count() == 83
    store.rename(one, " new\tname ")
    assert store.list_tracks().where("name = 'new name'").count() == 1
    with pytest.raises(ValueError):
        store.rename(one, " ")
    for call in (lambda: store.rename(-1, "x"), lambda: store.delete(-1), lambda: store.track_detail(-1), lambda: store.similarity(-1)):
        with pytest.raises(TrackNotFound):
            call()
    (tmp_path / "taken").mkdir()
    with pytest.raises(ExportFailed):
        store.delete(one, str(tmp_path / "taken"))
    assert store.list_tracks().count() == 3
    store.delete(one, str(tmp_path / "export"))
    assert store.list_tracks().count() == 2 and store.points().count() == 42
    assert spark.read.json(str(tmp_path / "export")).select(F.col("features")[0]["properties"]["pointCount"].alias("n")).first().n == 41


def test_streams(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, i, t + dt.timedelta(seconds=60 * i + (1000 if i >= 5 else 0)), 0.0, 0.0, None) for i in range(10)] + [(9, 0, t + dt.timedelta(days=1), 0.0, 0.0, None)]
    points = spark.createDataFrame(rows, "track_id long, seq long, recorded_at timestamp, lon double, lat double, elevation_m double")
    points.repartition(1).write.parquet(str(tmp_path / "in"))
    spark.range(1).select(F.lit(9).cast("long").alias("track_id"), F.lit(1).cast("long").alias("seq"), F.lit(t + dt.timedelta(days=2)).alias("recorded_at"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"), F.lit(None).cast("double").alias("elevation_m")).write.mode("append").parquet(str(tmp_path / "in"))
    batch = {(r.track_id, r.trip_start, r.points) for r in trips.trips(points).collect()}
    assert batch == {(1, t, 5), (1, t + dt.timedelta(seconds=1300), 5), (9, t + dt.timedelta(days=1), 1)}
    for k, (make, want) in enumerate([(trips.trips, 2), (lambda p: trips.density_stream(p, 0.001), 1), (trips.once, 12)]):
        stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.format("parquet").option("path", str(tmp_path / f"out{k}")).option("checkpointLocation", str(tmp_path / f"check{k}")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert got.count() >= want
        if k == 0:
            assert {(r.track_id, r.trip_start, r.points) for r in got.where("track_id = 1").collect()} == {b for b in batch if b[0] == 1}
    assert trips.once(points.unionByName(points)).count() == len(rows)
