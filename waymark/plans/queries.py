"""The registered queries over the virtual trajectories."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.geo import from_gcj02, geodesic, haversine, iso, local_hour, shifted, to_gcj02
from waymark.functions.regions import Bbox, Region, parse_region, rectangle
from waymark.operators import clean, density, hotspots, layout, regions_join, similarity, stays, tracks, within
from waymark.operators.storage import shared_dir
from waymark.sources.files import content_hash, parse_gpx, parse_plt
from waymark.sources.track_format import register, write_files
from waymark.sources.virtual import demo_points, named, random_points, virtual_points, virtual_regions
from waymark.streaming import trips

Query = Callable[[SparkSession, str], DataFrame]

#: All virtual points lie within this box, of at most 3,000 cells of 0.002 degrees.
BOX = Bbox(116.28, 39.94, 116.68, 39.97)
SMALL_BOX = Bbox(116.299, 39.949, 116.306, 39.957)
CELL = 0.002
BASELINE, TOLERANCE_M = 0, 50.0
IDS = [0, 3, 5, 8]
WINDOW = ("2024-01-05T00:00:00Z", "2024-01-12T23:59:59Z")
RECT = parse_region(rectangle((116.2995, 39.9495), (116.3045, 39.9535)))
POLYGON = parse_region({"type": "Polygon", "coordinates": [[[116.296, 39.949], [116.309, 39.951], [116.311, 39.958], [116.301, 39.9555], [116.296, 39.949]]]})
HOLE = parse_region({"type": "Polygon", "coordinates": [[[116.295, 39.948], [116.313, 39.948], [116.313, 39.959], [116.295, 39.959], [116.295, 39.948]], [[116.2995, 39.9495], [116.3045, 39.9495], [116.3045, 39.9545], [116.2995, 39.9545], [116.2995, 39.9495]]]})
MULTI = parse_region({"type": "MultiPolygon", "coordinates": [[[[116.299, 39.949], [116.301, 39.949], [116.301, 39.951], [116.299, 39.951], [116.299, 39.949]]], [[[116.3105, 39.954], [116.314, 39.954], [116.314, 39.9595], [116.3105, 39.954]]]]})
BUFFER = parse_region({"type": "Point", "coordinates": [116.304, 39.953]}, 400.0)
ROUTE = [(116.3974, 39.9093), (116.3948, 39.9245), (116.3880, 39.9400), (116.3900, 39.9550), (116.3920, 39.9700), (116.3900, 39.9850), (116.3880, 39.9930)]
NAMES = ["a/b:c", "  ", ".", "..", "two  words\t\nhere", "x" * 90, 'q"<>|*?', "plain", "\t\n", " \r\n "]


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(clean.track_summary(virtual_points(spark, sf_dir)))


def _shown(t: DataFrame, *extra: str) -> DataFrame:
    return t.select("track_id", "name", "source", iso(F.col("start_time")).alias("start_time"), iso(F.col("end_time")).alias("end_time"), "duration_s", "point_count", F.round("distance_m", 3).alias("distance_m"), *extra)


def _degrees(c: Column, name: str) -> Column:
    return F.round(c, 7).alias(name)


def _point(p: DataFrame) -> DataFrame:
    return p.select("track_id", "seq", iso(F.col("recorded_at")).alias("recorded_at"), "lon", "lat", "elevation_m")


def _on_points(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(virtual_points(spark, sf_dir))


def _on_tracks(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(_tracks(spark, sf_dir))


def _density(metric: str = "tracks", **limits: int) -> Query:
    def run(p: DataFrame) -> DataFrame:
        return density.density(p, BOX, CELL, metric, **limits).select(_degrees(F.col("lon"), "lon"), _degrees(F.col("lat"), "lat"), "points", "tracks", "value")

    return _on_points(run)


def _stays(p: DataFrame) -> DataFrame:
    return stays.stay_points(p)


def _stay_rows(s: DataFrame) -> DataFrame:
    return s.select("track_id", "seq_start", "seq_end", iso(F.col("start_time")).alias("start_time"), iso(F.col("end_time")).alias("end_time"), "duration_s", _degrees(F.col("center_lon"), "center_lon"), _degrees(F.col("center_lat"), "center_lat"), F.round("radius_m", 3).alias("radius_m"), "point_count")


def _hotspots(s: DataFrame, min_visits: int = 2) -> DataFrame:
    h = hotspots.hotspots(s, min_visits=min_visits)
    ids = F.concat_ws(",", F.transform("track_ids", lambda i: i.cast("string")))
    return h.select("rank", _degrees(F.col("center_lon"), "center_lon"), _degrees(F.col("center_lat"), "center_lat"), "visit_count", "track_count", "total_duration_s", F.round("radius_m", 3).alias("radius_m"), iso(F.col("first_visit")).alias("first_visit"), iso(F.col("last_visit")).alias("last_visit"), ids.alias("track_ids"))


def _hotspot_isolated(p: DataFrame) -> DataFrame:
    s = hotspots.materialize(_stays(p), "all-stays")
    spots = hotspots.hotspots(s).agg(F.count(F.lit(1)).alias("hotspots"), F.coalesce(F.sum("visit_count"), F.lit(0)).alias("visits"))
    return s.agg(F.count(F.lit(1)).alias("scanned_stays")).join(spots).withColumn("isolated", F.col("scanned_stays") - F.col("visits"))


def _within(region: Region, **window: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = virtual_points(spark, sf_dir)
        return within.matched(p, named(clean.track_summary(p)), region, **window).select("track_id", "source", "inside_count")

    return run


def _within_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = virtual_points(spark, sf_dir)
    return within.items(within.matched(p, named(clean.track_summary(p)), POLYGON), 20).select("track_id", "name", "inside_count")


def _within_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = virtual_points(spark, sf_dir)
    found = within.stats(within.matched(p, named(clean.track_summary(p)), POLYGON))
    return found.select(F.coalesce("source", F.lit("all")).alias("source"), "track_count", F.round("distance_m", 2).alias("distance_m"), iso(F.col("start_time")).alias("start_time"), iso(F.col("end_time")).alias("end_time"))


def _scores(baseline: int | None) -> Query:
    return _on_points(lambda p: similarity.scores(p, baseline, TOLERANCE_M).select("a_track", "b_track", "a_hit", "b_hit", "forward", "reverse", "similarity"))


def _hits(column: str) -> Query:
    return _on_points(lambda p: similarity.near_counts(p, BASELINE, TOLERANCE_M).where(F.col(column) > 0).select(F.col("b_track").alias("track_id"), F.col(column).alias("hits")))


def _similarity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = virtual_points(spark, sf_dir)
    return similarity.most_similar(p, named(clean.track_summary(p)), BASELINE, TOLERANCE_M, 10).withColumn("distance_m", F.round("distance_m", 3))


def _grid_pair(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells by dividing by the size, and by multiplying with its inverse (which snaps to a grid)."""
    inverse = F.lit(1 / CELL)
    b = p.groupBy(F.rint(F.col("lon") * inverse).cast("int").alias("nx"), F.rint(F.col("lat") * inverse).cast("int").alias("ny")).agg(F.count(F.lit(1)).alias("points"))
    return density.cells(p, CELL).select("nx", "ny", "points"), b


def _grid_method_diff(p: DataFrame) -> DataFrame:
    a, b = _grid_pair(p)
    b = b.withColumnRenamed("points", "snapped")
    differ = ~F.col("points").eqNullSafe(F.col("snapped"))
    return a.join(b, ["nx", "ny"], "full").agg(F.count(F.lit(1)).alias("cells"), F.count_if(differ).alias("differing"))


def _cells_except(p: DataFrame) -> DataFrame:
    """Cells touched in the morning hours only, and those never touched in them."""
    at = [F.rint(F.col(c) / F.lit(CELL)).cast("int").alias(n) for c, n in (("lon", "nx"), ("lat", "ny"))]
    morning = local_hour(F.col("recorded_at")).between(7, 9)
    a, b = p.where(morning).select(*at), p.where(~morning).select(*at)
    return a.subtract(b).withColumn("side", F.lit("morning")).unionByName(b.subtract(a).withColumn("side", F.lit("other")))


def _speed_rows(p: DataFrame) -> DataFrame:
    return clean.with_step(p).select("track_id", "seq", F.round("speed_mps", 3).alias("speed_mps"))


def _text6(micro: Column) -> Column:
    """Micro-degrees as a decimal text."""
    return F.concat((F.floor(micro / 1000000)).cast("string"), F.lit("."), F.lpad((micro % 1000000).cast("string"), 6, "0"))


def _plt_files(p: DataFrame) -> DataFrame:
    """Each track as a PLT text with header lines, unreadable rows and rows off the earth."""
    micro = lambda c: F.round(F.col(c) * 1e6).cast("long")
    lat = F.when(F.col("seq") % 17 == 3, "95.5").when(F.col("seq") % 19 == 4, "n/a").otherwise(_text6(micro("lat")))
    feet = F.when(F.col("seq") % 5 == 0, "?").otherwise((F.col("seq") * 10).cast("string"))
    row = F.concat_ws(",", lat, _text6(micro("lon")), F.lit("0"), feet, F.lit("39744.1"), F.substring(iso(F.col("recorded_at")), 1, 10), F.substring(iso(F.col("recorded_at")), 12, 8))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("seq", row.alias("row")))), lambda x: x["row"])
    head = F.array(*[F.lit(h) for h in ("Geolife trajectory", "WGS 84", "Altitude is in Feet", "Reserved 3", "0,2,255,My Track,0,0,2,8421376", "0")])
    return p.groupBy("track_id").agg(F.array_join(F.concat(head, rows), "\r\n").alias("value")).withColumn("file", F.col("track_id").cast("string"))


def _plt_parse(p: DataFrame) -> DataFrame:
    got = parse_plt(_plt_files(p))
    return got.select(F.col("file").cast("long").alias("track_id"), (F.col("line") - 6).cast("long").alias("seq"), "lat", "lon", F.round("elevation_m", 4).alias("elevation_m"), iso(F.col("recorded_at")).alias("recorded_at"))


def _gpx_files(p: DataFrame) -> DataFrame:
    micro = lambda c: F.round(F.col(c) * 1e6).cast("long")
    ele = F.when(F.col("seq") % 5 == 0, "").otherwise(F.concat(F.lit("<ele>"), (F.col("seq") * 2).cast("string"), F.lit(".5</ele>")))
    zone = F.when(F.col("seq") % 13 == 5, F.substring(iso(F.col("recorded_at")), 1, 19)).when(F.col("seq") % 13 == 6, F.substring(iso(F.col("recorded_at")), 1, 10)).otherwise(iso(F.col("recorded_at")))
    time = F.when(F.col("seq") % 11 == 2, "").otherwise(F.concat(F.lit("<time>"), zone, F.lit("</time>")))
    lat = F.when(F.col("seq") % 17 == 3, "95.5").otherwise(_text6(micro("lat")))
    row = F.concat(F.lit('<trkpt lat="'), lat, F.lit('" lon="'), _text6(micro("lon")), F.lit('">'), ele, time, F.lit("</trkpt>"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", row.alias("row")))), lambda x: x["row"]), "")
    head = F.concat(F.lit('<?xml version="1.0"?><gpx version="1.0" xmlns="http://www.topografix.com/GPX/1/0"><trk><name>track '), F.col("track_id").cast("string"), F.lit("</name><trkseg>"))
    # Some files have segments without points, and tracks without segments.
    tail = F.when(F.col("track_id") % 3 == 1, "</trkseg><trkseg></trkseg><trkseg/></trk><trk><name>no segment</name></trk><trk/></gpx>").otherwise("</trkseg></trk></gpx>")
    return p.groupBy("track_id").agg(rows.alias("rows")).select(F.col("track_id").cast("string").alias("file"), F.concat(head, "rows", tail).alias("value"))


def _gpx_parse(p: DataFrame) -> DataFrame:
    got = parse_gpx(_gpx_files(p))
    return got.select(F.col("file").cast("long").alias("track_id"), "name", F.col("line").cast("long").alias("seq"), "lat", "lon", "elevation_m", iso(F.col("recorded_at")).alias("recorded_at"))


def _through_files(files: DataFrame) -> DataFrame:
    """What the data source reads of texts (file, value) that were written as a file each."""
    spark = files.sparkSession
    path = f"{shared_dir(spark)}/waymark/track-files-{uuid.uuid4().hex}"
    write_files(files, path)
    register(spark)
    found = spark.read.format("tracks").load(path)
    return found.select(F.regexp_extract("file", r"/(\d+)$", 1).cast("long").alias("track_id"), F.col("line").cast("long").alias("seq"), "lat", "lon", F.round("elevation_m", 4).alias("elevation_m"), iso(F.col("recorded_at")).alias("recorded_at"))


def _layout_box(p: DataFrame) -> DataFrame:
    """What a search by box reads of points that were written by place."""
    path = f"{shared_dir(p.sparkSession)}/waymark/by-place-{uuid.uuid4().hex}"
    layout.write_by_place(p, path)
    return _point(layout.read_box(p.sparkSession, path, SMALL_BOX))


def _sample_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """121 points evenly along a route of six legs, 25 s apart, with a rippling elevation."""
    lengths = [((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2) ** 0.5 for a, b in zip(ROUTE, ROUTE[1:], strict=False)]
    ends = [sum(lengths[:i]) for i in range(len(ROUTE))]
    s = spark.range(121).withColumn("d", F.col("id") / F.lit(120.0) * F.lit(ends[-1]))

    def along(k: int) -> Column:
        out = F.lit(ROUTE[-1][k])
        for i in reversed(range(len(lengths))):
            here = F.lit(ROUTE[i][k]) + (F.lit(ROUTE[i + 1][k]) - F.lit(ROUTE[i][k])) * ((F.col("d") - F.lit(ends[i])) / F.lit(lengths[i]))
            out = F.when(F.col("d") < ends[i + 1], here).otherwise(out)
        return out

    at = F.timestamp_seconds(F.lit(1788823800) + F.col("id") * 25)
    return s.select(F.col("id").alias("seq"), iso(at).alias("recorded_at"), _degrees(along(0), "lon"), _degrees(along(1), "lat"), F.round(40 + 8 * F.sin(F.col("id") / 20.0), 6).alias("elevation_m"))


def _import_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = _tracks(spark, sf_dir).select("track_id", "name", "source", "external_id")
    t = F.col("track_id")
    fresh = F.concat(F.lit("new-"), t.cast("string"))
    incoming = existing.select(
        F.concat(F.lit("file-"), t.cast("string")).alias("file"),
        F.when(t % 4 == 0, F.col("name")).otherwise(fresh).alias("name"), "source",
        F.when(t % 3 == 0, F.col("external_id")).otherwise(fresh).alias("external_id"),
        F.when(t % 5 < 3, "append").otherwise("replace").alias("mode"),
        F.when(t % 7 != 6, t + t % 2).alias("replace_id"), (t % 8 == 0).alias("allow_same_name"),
    )
    return tracks.import_plan(existing, incoming)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = len(NAMES)
    pick = F.element_at(F.array(*[F.lit(x) for x in NAMES]), (F.col("track_id") % n + 1).cast("int"))
    return virtual_points(spark, sf_dir).where("seq = 0").select("track_id", pick.alias("raw"))


def _playback(p: DataFrame) -> DataFrame:
    return clean.playback_stats(p).select("track_id", "can_play", F.round("span_s", 3).alias("span_s"), F.round("multiplier", 4).alias("multiplier"))


def _line_stats(p: DataFrame) -> DataFrame:
    line = clean.make_line(p)
    lat = F.transform("line", lambda x: x["lat"])
    first, last = F.element_at("line", 1), F.element_at("line", -1)
    return line.select("track_id", F.size("line").alias("n_points"), F.array_min(lat).alias("min_lat"), F.array_max(lat).alias("max_lat"), first["lon"].alias("start_lon"), first["lat"].alias("start_lat"), last["lon"].alias("end_lon"), last["lat"].alias("end_lat"))


def _distance_ways(p: DataFrame) -> DataFrame:
    ends = p.where(F.col("seq").isin(0, 59)).groupBy("track_id").agg(*[F.max(F.when(F.col("seq") == s, F.col(c))).alias(f"{c}{s}") for s in (0, 59) for c in ("lon", "lat")]).where("lon0 is not null and lon59 is not null")
    lon0, lat0, lon1, lat1 = (F.col(c) for c in ("lon0", "lat0", "lon59", "lat59"))
    planar = F.sqrt((lon1 - lon0) * (lon1 - lon0) + (lat1 - lat0) * (lat1 - lat0))
    return ends.select("track_id", F.round(planar, 9).alias("planar_deg"), F.round(haversine(lon0, lat0, lon1, lat1), 3).alias("sphere_m"))


def _ellipsoid(p: DataFrame) -> DataFrame:
    """Of each step its length on the ellipsoid, and how much longer that is than on the sphere."""
    step = p.join(p.select("track_id", (F.col("seq") - 1).alias("seq"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2")), ["track_id", "seq"])
    places = [F.col(c) for c in ("lon", "lat", "lon2", "lat2")]
    return step.select("track_id", "seq", F.round(geodesic(*places), 4).alias("ellipsoid_m"), F.round(geodesic(*places) - haversine(*places), 4).alias("longer_m"))


def _planar_near(p: DataFrame) -> DataFrame:
    dx, dy = F.col("lon") - 116.3, F.col("lat") - 39.95
    return p.where(dx * dx + dy * dy <= 0.003 * 0.003).select("track_id", "seq", "lon", "lat")


def _gcj02(p: DataFrame) -> DataFrame:
    lon, lat = to_gcj02(F.col("lon"), F.col("lat"))
    return p.select("track_id", "seq", _degrees(lon, "lon"), _degrees(lat, "lat"))


def _gcj02_back(p: DataFrame) -> DataFrame:
    lon, lat = from_gcj02(F.col("lon"), F.col("lat"))
    return p.select("track_id", "seq", _degrees(lon, "lon"), _degrees(lat, "lat"))


def _similarity_min(p: DataFrame) -> DataFrame:
    return similarity.at_least(similarity.scores(p, BASELINE, TOLERANCE_M), 50.0).select("b_track", "similarity")


def _similarity_compared(p: DataFrame) -> DataFrame:
    return similarity.compared(similarity.scores(p, BASELINE, TOLERANCE_M)).select(F.lit(BASELINE).cast("long").alias("track_id"), "compared")


def _within_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = virtual_points(spark, sf_dir)
    return within.response(within.matched(p, named(clean.track_summary(p)), POLYGON), POLYGON, 20)


def _hotspots_resorted(p: DataFrame) -> DataFrame:
    found = hotspots.resorted(hotspots.hotspots(_stays(p)), "total_duration_s")
    return found.select("rank", "track_count", "visit_count", "total_duration_s")


def _random_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of 300,000 random points, those within 1 km of a place, by day."""
    p = random_points(spark)
    near = p.where(haversine(F.lit(116.4), F.lit(39.9), F.col("lon"), F.col("lat")) <= 1000.0)
    return near.groupBy(F.substring(iso(F.col("recorded_at")), 1, 10).alias("day")).agg(F.count(F.lit(1)).alias("points"))


def _demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _point(demo_points(spark)).select("track_id", "seq", "recorded_at", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "elevation_m")


def _cell_rect(p: DataFrame) -> DataFrame:
    half, lon, lat = F.lit(CELL / 2), F.col("lon"), F.col("lat")
    return density.density(p, BOX, CELL).select(_degrees(lon - half, "west"), _degrees(lat - half, "south"), _degrees(lon + half, "east"), _degrees(lat + half, "north"))


def queries() -> dict[str, Query]:
    return {
        # Sources and sinks
        "plt_parse": _on_points(_plt_parse),
        "gpx_parse": _on_points(_gpx_parse),
        "plt_format": _on_points(lambda p: _through_files(_plt_files(p)).withColumn("seq", F.col("seq") - 6)),
        "gpx_format": _on_points(lambda p: _through_files(_gpx_files(p))),
        "layout_box": _on_points(_layout_box),
        "sample_track": _sample_track,
        "random_points_near": _random_near,
        "demo_points": _demo,
        "content_hash": _on_points(lambda p: p.where("seq = 0").select("track_id", content_hash(F.concat(F.lit("content of "), F.col("track_id").cast("string"))).alias("hash"))),
        "geojson_export": _on_points(lambda p: tracks.geojson(p, named(clean.track_summary(p))).select("track_id", F.get_json_object("geojson", "$.features[0].geometry.type").alias("kind"), F.get_json_object("geojson", "$.features[0].properties.name").alias("name"), F.get_json_object("geojson", "$.features[0].properties.pointCount").cast("long").alias("points"), F.get_json_object("geojson", "$.features[0].geometry.coordinates[0][1]").cast("double").alias("first_lat"), F.get_json_object("geojson", "$.features[0].properties.times[0]").alias("first_time"))),
        "track_list": _on_tracks(lambda t: _shown(tracks.list_tracks(t, limit=50))),
        "track_list_source": _on_tracks(lambda t: _shown(tracks.list_tracks(t, source="gpx", limit=50))),
        "track_count_by_source": _on_tracks(lambda t: t.groupBy("source").agg(F.count(F.lit(1)).alias("tracks"))),
        "track_ids": _on_points(lambda p: p.select("track_id").distinct()),
        "track_detail": _on_points(lambda p: _point(tracks.points_of(p, [BASELINE]))),
        "points_of_tracks": _on_points(lambda p: _point(tracks.points_of(p, IDS))),
        "find_by_external_id": _on_tracks(lambda t: t.where(F.col("external_id") == F.substring(F.sha2(F.lit("track-3"), 256), 1, 32)).select("track_id", "name", "external_id")),
        "find_by_name": _on_tracks(lambda t: t.where("name = 'track-7'").select("track_id", "name", "source")),
        # Projections and filters
        "bbox_filter": _on_points(lambda p: _point(density.in_box(p, SMALL_BOX))),
        "hour_filter": _on_points(lambda p: p.where(local_hour(F.col("recorded_at")).between(7, 9)).select("track_id", "seq", local_hour(F.col("recorded_at")).alias("hour"))),
        "date_filter": _on_points(lambda p: _point(density.in_window(p, *WINDOW))),
        "track_time_overlap": _on_tracks(lambda t: _shown(within.overlapping(t, *WINDOW))),
        "planar_dwithin": _on_points(_planar_near),
        "name_normalize": lambda spark, sf_dir: _names(spark, sf_dir).select("track_id", tracks.normalize_name(F.col("raw")).alias("name")),
        "safe_file_name": lambda spark, sf_dir: _names(spark, sf_dir).select("track_id", tracks.safe_file_name(F.col("raw")).alias("file_name")),
        # Joins
        "similarity_forward": _hits("a_hit"),
        "similarity_reverse": _hits("b_hit"),
        "similarity_scores": _scores(BASELINE),
        "similarity_all_pairs": _scores(None),
        "similarity_topk": _similarity_topk,
        "similarity_ellipsoid": _on_points(lambda p: similarity.scores(p, BASELINE, TOLERANCE_M, ellipsoid=True).select("a_track", "b_track", "a_hit", "b_hit", "similarity")),
        "similarity_min": _on_points(_similarity_min),
        "similarity_compared": _on_points(_similarity_compared),
        "semi_join_ids": _on_tracks(lambda t: t.join(t.where("source = 'gpx'").select("track_id"), "track_id", "left_semi").select("track_id", "name")),
        "grid_method_diff": _on_points(_grid_method_diff),
        "delete_cascade": _on_points(lambda p: tracks.without(p, p.where("seq = 59 and track_id % 3 = 1")).groupBy("track_id").agg(F.count(F.lit(1)).alias("points"))),
        # Aggregations
        "density_tracks": _density(),
        "density_points": _density("points"),
        "density_morning": _density("points", hour_from=7, hour_to=9),
        "density_summary": _on_points(lambda p: density.summary(density.density(p, BOX, CELL))),
        "points_per_track": _on_points(lambda p: p.groupBy("track_id").agg(F.count(F.lit(1)).alias("points"))),
        "within_point_counts": _on_points(lambda p: within.inside_counts(p, POLYGON)),
        "within_stats": _within_stats,
        "track_summary": _on_tracks(_shown),
        "make_line": _on_points(lambda p: clean.make_line(p).select("track_id", F.size("line").alias("n_points"), F.concat_ws(" ", F.transform("line", lambda x: F.concat(F.round(x["lon"] * 1e6).cast("long").cast("string"), F.lit(","), F.round(x["lat"] * 1e6).cast("long").cast("string")))).alias("line"))),
        "speed_threshold": _on_points(lambda p: clean.speed_threshold(clean.with_step(p)).select("track_id", F.round("threshold", 3).alias("threshold"))),
        "elevation_normalize": _on_points(lambda p: p.select("track_id", "seq", clean.normalized_elevation().alias("elevation_m"))),
        "avg_speed_kmh": _on_tracks(lambda t: t.select("track_id", F.round(clean.mean_speed_kmh(F.col("distance_m"), F.col("duration_s")), 4).alias("kmh"))),
        "outlier_counts": _on_points(lambda p: clean.with_outliers(clean.with_step(p)).groupBy("track_id").agg(F.count_if("is_outlier").alias("outliers"))),
        # Windows
        "point_speed": _on_points(_speed_rows),
        "clean_sequence": _on_points(lambda p: clean.clean_sequence(p.withColumn("old", F.col("seq")).withColumn("seq", 59 - F.col("seq")).withColumn("recorded_at", F.date_trunc("minute", "recorded_at"))).select("track_id", "old", "seq")),
        "outlier_flags": _on_points(lambda p: clean.with_outliers(clean.with_step(p)).select("track_id", "seq", "is_outlier")),
        "value_at": _on_points(lambda p: clean.value_at(p, F.lit(1704067200) + (F.col("track_id") % 28) * 86400 + ((F.col("track_id") * 7) % 24) * 3600 + 431).select("track_id", F.round("value", 6).alias("value"))),
        "trip_sessions": _on_points(lambda p: trips.trips(p).select("track_id", iso(F.col("trip_start")).alias("trip_start"), iso(F.col("trip_end")).alias("trip_end"), "points")),
        # Sorting and sets
        "within_items": _within_items,
        "within_response": _within_response,
        "hotspots_resorted": _on_points(_hotspots_resorted),
        "cells_except": _on_points(_cells_except),
        # Scalar functions
        "haversine": _on_points(lambda p: p.select("track_id", "seq", F.round(haversine(F.lit(116.3), F.lit(39.95), F.col("lon"), F.col("lat")), 3).alias("metres"))),
        "line_stats": _on_points(_line_stats),
        "line_interpolate": _on_points(lambda p: clean.interpolated(p, [0.0, 0.1, 0.5, 0.75, 1.0]).select("track_id", "fraction", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))),
        "distance_three_ways": _on_points(_distance_ways),
        "ellipsoid_steps": _on_points(_ellipsoid),
        "gcj02_shift": _on_points(_gcj02),
        "gcj02_back": _on_points(_gcj02_back),
        "gcj02_cells": _on_points(lambda p: shifted(density.density(p, BOX, CELL)).select(_degrees(F.col("lon"), "lon"), _degrees(F.col("lat"), "lat"), "points")),
        "density_ratio": _on_points(lambda p: density.density(p, BOX, CELL).select(_degrees(F.col("lon"), "lon"), _degrees(F.col("lat"), "lat"), F.round(F.least(F.lit(1.0), F.log1p(F.col("value").cast("double")) / F.log1p(F.lit(64.0))), 6).alias("ratio"))),
        "cell_rect": _on_points(_cell_rect),
        "playback_stats": _on_points(_playback),
        # Compound operators
        "clean_track": _on_points(lambda p: clean.clean_track(p).select("track_id", "seq", "lon", "lat", "elevation_m", F.round("speed_mps", 3).alias("speed_mps"), "is_outlier")),
        "stay_points": _on_points(lambda p: _stay_rows(_stays(p))),
        "stay_count_by_track": _on_points(lambda p: _stays(p).groupBy("track_id").agg(F.count(F.lit(1)).alias("stays"))),
        "hotspots": _on_points(lambda p: _hotspots(_stays(p))),
        "hotspots_window": _on_points(lambda p: _hotspots(hotspots.within_time(_stays(p), *WINDOW), 1)),
        "hotspot_isolated": _on_points(_hotspot_isolated),
        "within_rect": _within(RECT),
        "within_polygon": _within(POLYGON),
        "within_multipolygon": _within(MULTI),
        "within_hole": _within(HOLE),
        "within_buffer": _within(BUFFER),
        "within_regions": lambda spark, sf_dir: regions_join.region_counts(virtual_points(spark, sf_dir), virtual_regions(spark, sf_dir)),
        "region_validity": lambda spark, sf_dir: regions_join.validity(virtual_regions(spark, sf_dir)).select("region_id", "valid"),
        "within_time_window": _within(POLYGON, start=WINDOW[0], end=WINDOW[1]),
        "import_plan": _import_plan,
        "name_conflicts": _on_points(lambda p: tracks.name_conflicts(p.where("seq = 0").select("track_id", F.concat(F.lit("name-"), (F.col("track_id") % 50).cast("string")).alias("name")))),
    }
