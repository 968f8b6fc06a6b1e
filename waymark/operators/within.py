"""Region queries: which tracks cross a region, how many of their points lie inside, and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import bounds_of, crosses, inside
from waymark.functions.regions import Region, check_limit, check_window
from waymark.operators.clean import along_track, track_summary
from waymark.operators.density import in_window, since, until


def overlapping(tracks: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Tracks whose time overlaps a window, its ends included."""
    return since(until(tracks, "start_time", end), "end_time", start)


def crossing_tracks(points: DataFrame, region: Region) -> DataFrame:
    """(track_id): tracks with a point inside or a segment that meets an edge, touching included."""
    lag = lambda c: F.lag(c).over(along_track())
    # Only tracks whose own box meets the region's are put in order.
    west, south, east, north = bounds_of(region.rings)
    boxes = points.groupBy("track_id").agg(*[f(c).alias(f"{n}_{c}") for c in ("lon", "lat") for n, f in (("least", F.min), ("most", F.max))])
    near = boxes.where((F.col("least_lon") <= east) & (F.col("most_lon") >= west) & (F.col("least_lat") <= north) & (F.col("most_lat") >= south))
    lines = points.join(near.select("track_id"), "track_id", "left_semi").select("track_id", "lon", "lat", lag("lon").alias("lon0"), lag("lat").alias("lat0"))
    hit = inside(F.col("lon"), F.col("lat"), region.rings) | F.coalesce(crosses(F.col("lon0"), F.col("lat0"), F.col("lon"), F.col("lat"), region.rings), F.lit(False))
    return lines.where(hit).select("track_id").distinct()


def inside_counts(points: DataFrame, region: Region, start: str | None = None, end: str | None = None) -> DataFrame:
    """(track_id, inside_count) of points inside the region in the window."""
    found = in_window(points, start, end).where(inside(F.col("lon"), F.col("lat"), region.rings))
    return found.groupBy("track_id").agg(F.count(F.lit(1)).alias("inside_count"))


def matched(points: DataFrame, tracks: DataFrame, region: Region, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of tracks that cross the region in the window, with inside_count."""
    check_window(start, end)
    ids = crossing_tracks(points, region)
    counts = inside_counts(points, region, start, end)
    hit = overlapping(tracks, start, end).join(ids, "track_id", "left_semi")
    return hit.join(counts, "track_id", "left").withColumn("inside_count", F.coalesce("inside_count", F.lit(0)))


def items(found: DataFrame, limit: int) -> DataFrame:
    check_limit(limit)
    return found.orderBy(F.desc("inside_count"), "track_id").limit(limit)


def response(found: DataFrame, region: Region, limit: int) -> DataFrame:
    """One row: total_hits, truncated (whether items() leaves some out), inside_points and the geometry searched, as GeoJSON."""
    check_limit(limit)
    total = F.count(F.lit(1))
    return found.agg(total.alias("total_hits"), (total > limit).alias("truncated"), F.coalesce(F.sum("inside_count"), F.lit(0)).alias("inside_points")).withColumn("geometry", F.lit(region.geometry))


def stats(found: DataFrame) -> DataFrame:
    """Totals by source and over all (source null; zeros where nothing was found): track_count, distance_m, start_time, end_time."""
    by = found.groupBy("source").agg(
        F.count(F.lit(1)).alias("track_count"), F.sum(F.coalesce("distance_m", F.lit(0.0))).alias("distance_m"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time")
    )
    whole = by.agg(
        F.coalesce(F.sum("track_count"), F.lit(0)).alias("track_count"), F.coalesce(F.sum("distance_m"), F.lit(0.0)).alias("distance_m"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time")
    )
    return by.unionByName(whole.withColumn("source", F.lit(None).cast("string")))


def summarized(points: DataFrame, region: Region, **window: str | None) -> DataFrame:
    """matched() over tracks derived from the points themselves."""
    return matched(points, track_summary(points), region, **window)
