"""Grid cells for joins by distance: an equality join on cells finds every pair within reach."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import LAT_M, LON_M


def _row(lat: Column, reach_m: float) -> Column:
    return F.floor(lat / F.lit(reach_m / LAT_M * 1.05))


def _column_width(row: Column, reach_m: float) -> Column:
    """Cells of a row of latitudes are as wide as reach_m at its edge nearest to a pole."""
    high = reach_m / LAT_M * 1.05
    edge = F.least(F.lit(90.0), F.greatest(F.abs(row * F.lit(high)), F.abs((row + 1) * F.lit(high))))
    return F.lit(reach_m * 1.05 / LON_M) / F.greatest(F.cos(F.lit(math.pi / 180) * edge), F.lit(1e-9))


def _column(row: Column, lon: Column, reach_m: float) -> Column:
    return F.floor(lon / _column_width(row, reach_m))


def at_home(points: DataFrame, lon: str, lat: str, reach_m: float) -> DataFrame:
    """Add the cell (by, bx) of each point."""
    return points.withColumn("by", _row(F.col(lat), reach_m)).withColumn("bx", _column(F.col("by"), F.col(lon), reach_m))


def around(points: DataFrame, lon: str, lat: str, reach_m: float) -> DataFrame:
    """A row for each of the nine cells in which points within reach_m lie."""
    mid = _row(F.col(lat), reach_m)
    rows = points.withColumn("by", F.explode(F.sequence(mid - 1, mid + 1))).withColumn("_mid", _column(F.col("by"), F.col(lon), reach_m))
    return rows.withColumn("bx", F.explode(F.sequence(F.col("_mid") - 1, F.col("_mid") + 1))).drop("_mid")


def nested(points: DataFrame, lon: str, lat: str, reach_m: float, levels: int) -> DataFrame:
    """Add the finest cell (fy, fx) of each point: cells of width reach_m cut in two, levels times, in both directions.

    Shifted right by levels they are the cell of at_home(), by less one of those between.
    """
    whole = 1 << levels
    high = reach_m / LAT_M * 1.05
    rows = points.withColumn("fy", F.floor(F.col(lat) / F.lit(high / whole)))
    edge = F.shiftright("fy", levels)
    return rows.withColumn("fx", F.floor(F.col(lon) / (_column_width(edge, reach_m) / whole)))


def column_at(row: Column, lon: Column, reach_m: float) -> Column:
    """The column of a longitude in a row of cells."""
    return _column(row, lon, reach_m)
