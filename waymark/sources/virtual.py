"""Deterministic trajectories over the events table: sixty consecutive events are one track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def virtual_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, seq, recorded_at, lon, lat, elevation_m; integer micro-degrees, divided once."""
    e, t, s = F.col("event_id"), F.expr("event_id div 60"), F.col("event_id") % 60
    pause = F.when((t % 9 == 4) & (s >= 30), 400).otherwise(0)
    epoch = F.lit(1704067200) + (t % 28) * 86400 + ((t * 7) % 24) * 3600 + s * 30 + pause
    along = F.when(s < 20, (s - 20) * 400).when(s < 40, ((e * 7) % 11) * 10).otherwise((s - 39) * 400)
    across = F.when(s < 20, 0).when(s < 40, ((e * 5) % 13) * 8).otherwise((s - 39) * 250)
    drift = F.when(e % 97 == 0, 20000).otherwise(0)
    lon = F.lit(116300000) + (t % 4) * 4000 + (F.expr("event_id div 60 div 192") % 10) * 40000 + along + drift
    lat = F.lit(39950000) + (t % 3) * 3000 + across
    height = F.when(t % 6 == 5, 0.0).otherwise(F.lit(40) + ((e * 13) % 50) / F.lit(10.0))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        t.cast("long").alias("track_id"), s.cast("long").alias("seq"), F.timestamp_seconds(epoch).alias("recorded_at"),
        (lon.cast("double") / F.lit(1e6)).alias("lon"), (lat.cast("double") / F.lit(1e6)).alias("lat"), height.cast("double").alias("elevation_m"),
    )


def source_of(track_id: Column) -> Column:
    return F.element_at(F.array(F.lit("geolife"), F.lit("gpx"), F.lit("sample")), (track_id % 3 + 1).cast("int"))


def named(tracks: DataFrame) -> DataFrame:
    """Add name, source and external_id to rows with track_id."""
    external = F.substring(F.sha2(F.concat(F.lit("track-"), F.col("track_id").cast("string")), 256), 1, 32)
    return tracks.withColumns({"name": F.concat(F.lit("track-"), F.col("track_id").cast("string")), "source": source_of(F.col("track_id")), "external_id": external})


def _uniform(i: Column, k: int) -> Column:
    """Numbers from 0 to under 1 that follow from i and k alone, so that any engine draws the same."""
    return ((i * 48271 + k * 7919 + 11) * 16807 % 2147483647).cast("double") / F.lit(2147483647.0)


def random_points(spark: SparkSession, rows: int = 300_000) -> DataFrame:
    """point_id, recorded_at, lon, lat: points all over a box of 0.4 by 0.3 degrees and over thirty days."""
    i = F.col("id")
    return spark.range(rows).select(
        i.alias("point_id"), F.timestamp_seconds(F.lit(1704067200) + F.floor(_uniform(i, 3) * 30 * 86400)).alias("recorded_at"),
        (F.lit(116.2) + _uniform(i, 1) * 0.4).alias("lon"), (F.lit(39.8) + _uniform(i, 2) * 0.3).alias("lat"),
    )


def demo_points(spark: SparkSession, tracks: int = 14, steps: int = 120) -> DataFrame:
    """track_id, seq, recorded_at, lon, lat, elevation_m of demo tracks from a fixed seed.

    A track walks in a straight line of its own, stays near one of four shared places for the third
    quarter of its points (ten minutes and more, within ten metres), and walks on; every third track
    has no elevation. Two tracks in turn take the same place, so that hotspots and likenesses show.
    """
    t, s = F.col("id") % tracks, F.floor(F.col("id") / tracks)
    place = F.floor(t / 2) % 4
    lon0, lat0 = F.lit(116.35) + place * 0.02, F.lit(39.9) + place * 0.015
    still = (s >= steps // 2) & (s < steps * 3 // 4)
    away = F.when(s < steps // 2, s - steps // 2).when(still, 0).otherwise(s - steps * 3 // 4 + 1)
    jitter = lambda k: F.when(still, (_uniform(F.col("id"), k) - 0.5) * 0.0001).otherwise(0.0)
    return spark.range(tracks * steps).select(
        t.alias("track_id"), s.cast("long").alias("seq"), F.timestamp_seconds(F.lit(1788220800) + t * 3600 * 7 + s * 25).alias("recorded_at"),
        (lon0 + away * (F.lit(0.0002) + t * 0.00001) + jitter(4)).alias("lon"), (lat0 + away * 0.0001 + jitter(5)).alias("lat"),
        F.when(t % 3 != 2, F.round(40 + s / F.lit(10.0), 1)).alias("elevation_m"),
    )


def _ring(corners: list[tuple[str, str]]) -> str:
    """A closed ring as SQL: corners are offsets in micro-degrees from (x, y), in terms of w."""
    return "array(" + ", ".join(f"named_struct('x', (x + {a}) / 1000000.0D, 'y', (y + {b}) / 1000000.0D)" for a, b in [*corners, corners[0]]) + ")"


_SQUARE = [("0", "0"), ("2 * w", "0"), ("2 * w", "2 * w"), ("0", "2 * w")]
_HOLE = [("w div 2", "w div 2"), ("w", "w div 2"), ("w", "w"), ("w div 2", "w")]
_ISLAND = [("w div 2 + 10", "w div 2 + 10"), ("w - 10", "w div 2 + 10"), ("w div 2 + 10", "w - 10")]
_NOTCHED = [("0", "0"), ("3 * w", "0"), ("3 * w", "3 * w"), ("w", "w div 3"), ("0", "3 * w")]
_WEDGE = [("0", "0"), ("17 * w", "w"), ("5 * w", "4 * w")]
_BOW = [("0", "0"), ("2 * w", "2 * w"), ("2 * w", "0"), ("0", "2 * w")]
_AWAY = [("5 * w", "0"), ("6 * w", "0"), ("6 * w", "w")]


def virtual_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region_id, kind, rings, geometry: a region for each customer, scattered over where virtual points lie.

    Kinds 0 to 4 are valid: squares, notched pentagons, squares with a hole, wedges, squares with an island in
    their hole. 5 to 7 are not: bow ties, holes away from their shells, polygons within polygons; as
    rings counted even-odd they hold points all the same.
    """
    k = F.col("c_custkey")
    placed = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        k.cast("long").alias("region_id"), (k % 8).cast("int").alias("kind"), (F.lit(116290000) + (k * 7919) % 390000).alias("x"), (F.lit(39938000) + (k * 104729) % 26000).alias("y"), (F.lit(300) + (k * 31) % 40 * 60).alias("w"),
    )
    shapes = [[[_SQUARE]], [[_NOTCHED]], [[_SQUARE, _HOLE]], [[_WEDGE]], [[_SQUARE, _HOLE], [_ISLAND]], [[_BOW]], [[_SQUARE, _AWAY]], [[_SQUARE], [_HOLE]]]
    nested = "case kind " + " ".join(f"when {i} then array({', '.join('array(' + ', '.join(map(_ring, polygon)) + ')' for polygon in shape)})" for i, shape in enumerate(shapes)) + " end"
    whole = placed.select("region_id", "kind", F.expr(nested).alias("polygons"))
    numbers = F.transform("polygons", lambda p: F.transform(p, lambda r: F.transform(r, lambda c: F.array(c["x"], c["y"]))))
    geometry = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), numbers.alias("coordinates")))
    return whole.select("region_id", "kind", F.flatten("polygons").alias("rings"), geometry.alias("geometry"))
