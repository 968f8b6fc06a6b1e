"""Streams of points: trips by session windows, density by time windows, distinct reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP_S, LATE = 300, "10 minutes"


def trips(points: DataFrame, gap_s: int = GAP_S, late: str = LATE) -> DataFrame:
    """(track_id, trip_start, trip_end, points): points of a track less than gap_s apart are one trip.

    trip_end is the last point's time plus the gap. On a stream a trip comes out once the watermark
    has passed its end; points later than the watermark are left out.
    """
    if points.isStreaming:
        points = points.withWatermark("recorded_at", late)
    found = points.groupBy("track_id", F.session_window("recorded_at", f"{gap_s} seconds").alias("w")).agg(F.count(F.lit(1)).alias("points"))
    return found.select("track_id", F.col("w.start").alias("trip_start"), F.col("w.end").alias("trip_end"), "points")


def density_stream(points: DataFrame, size: float, every: str = "1 hour", late: str = LATE) -> DataFrame:
    """(window_start, nx, ny, points): points in each cell and span of time."""
    if points.isStreaming:
        points = points.withWatermark("recorded_at", late)
    at = [F.rint(F.col(c) / F.lit(size)).cast("int").alias(n) for c, n in (("lon", "nx"), ("lat", "ny"))]
    found = points.groupBy(F.window("recorded_at", every).alias("w"), *at).agg(F.count(F.lit(1)).alias("points"))
    return found.select(F.col("w.start").alias("window_start"), "nx", "ny", "points")


def once(points: DataFrame, late: str = LATE) -> DataFrame:
    """Points without repeats of (track_id, recorded_at): devices send a report again after a lost answer."""
    if not points.isStreaming:
        return points.dropDuplicates(["track_id", "recorded_at"])
    return points.withWatermark("recorded_at", late).dropDuplicatesWithinWatermark(["track_id", "recorded_at"])
