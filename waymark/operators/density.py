"""Grid density: points and tracks in each cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import ZONE, local_hour
from waymark.functions.regions import Bbox, check_cell_size, check_cells, check_hours, check_metric, instant


def in_box(points: DataFrame, box: Bbox) -> DataFrame:
    return points.where(F.col("lon").between(box.west, box.east) & F.col("lat").between(box.south, box.north))


def since(rows: DataFrame, column: str, start: str | None) -> DataFrame:
    """Rows whose time is not before an ISO time with its offset; all for None."""
    return rows if start is None else rows.where(F.col(column) >= F.timestamp_micros(F.lit(instant(start))))


def until(rows: DataFrame, column: str, end: str | None) -> DataFrame:
    """Rows whose time is not after an ISO time with its offset; all for None."""
    return rows if end is None else rows.where(F.col(column) <= F.timestamp_micros(F.lit(instant(end))))


def in_window(points: DataFrame, start: str | None = None, end: str | None = None, hours: tuple[int, int] | None = None, zone: str = ZONE) -> DataFrame:
    """Points from start to end (ISO times with their offsets), both included, within hours of the local day."""
    points = since(until(points, "recorded_at", end), "recorded_at", start)
    return points if hours is None else points.where(local_hour(F.col("recorded_at"), zone).between(*hours))


def cells(points: DataFrame, size: float) -> DataFrame:
    """(nx, ny, points, tracks): cells are centred on multiples of size, ties to the even index.

    Points are counted by cell and track first, so that a crowded cell's distinct count needs one
    small row for each of its tracks.
    """
    at = [F.rint(F.col(c) / F.lit(size)).cast("int").alias(n) for c, n in (("lon", "nx"), ("lat", "ny"))]
    by_track = points.groupBy(*at, "track_id").agg(F.count(F.lit(1)).alias("n"))
    return by_track.groupBy("nx", "ny").agg(F.sum("n").alias("points"), F.count(F.lit(1)).alias("tracks"))


def density(points: DataFrame, box: Bbox, size: float, metric: str = "tracks", hour_from: int | None = None, hour_to: int | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """(lon, lat, points, tracks, value): cell centres and the chosen metric."""
    check_cells(box, check_cell_size(size))
    metric, hours = check_metric(metric), check_hours(hour_from, hour_to)
    got = cells(in_window(in_box(points, box), start, end, hours), size)
    return got.select((F.col("nx") * F.lit(size)).alias("lon"), (F.col("ny") * F.lit(size)).alias("lat"), "points", "tracks", F.col(metric).alias("value"))


def summary(found: DataFrame) -> DataFrame:
    """(cells, points, max_tracks) of a density; zeros where it is empty."""
    return found.agg(F.count(F.lit(1)).alias("cells"), F.coalesce(F.sum("points"), F.lit(0)).alias("points"), F.coalesce(F.max("tracks"), F.lit(0)).alias("max_tracks"))
