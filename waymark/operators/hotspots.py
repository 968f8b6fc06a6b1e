"""Hotspots: stays that chain within a radius of each other."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.functions.geo import EARTH_M, haversine
from waymark.functions.regions import check_hotspot
from waymark.operators.cells import around, at_home
from waymark.operators.density import since, until
from waymark.operators.graph import components
from waymark.operators.storage import materialize

RADIUS_M, MIN_VISITS = 200.0, 2


def within_time(stays: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Stays that lie wholly within a time window."""
    return until(since(stays, "start_time", start), "end_time", end)


def near_pairs(stays: DataFrame, radius_m: float) -> DataFrame:
    """Pairs (u, v) of stay ids within radius_m: an equality join on grid cells, then the distance."""
    here = at_home(stays.select("stay_id", "center_lon", "center_lat"), "center_lon", "center_lat", radius_m)
    there = around(stays.select(F.col("stay_id").alias("other"), F.col("center_lon").alias("lon2"), F.col("center_lat").alias("lat2")), "lon2", "lat2", radius_m)
    near = haversine(F.col("center_lon"), F.col("center_lat"), F.col("lon2"), F.col("lat2")) <= radius_m
    return here.join(there, ["by", "bx"]).where((F.col("stay_id") < F.col("other")) & near).select(F.col("stay_id").alias("u"), F.col("other").alias("v"))


def links(stays: DataFrame, radius_m: float) -> DataFrame:
    """Pairs (u, v) of stay ids that connect what near_pairs() connects, of far fewer rows in a crowded place.

    All stays of a small cell, whose diagonal is under radius_m, are linked to its first stay. Beyond
    that only stays at distinct places are compared: of stays at one place the first stands for all.
    """
    place = stays.groupBy("center_lon", "center_lat").agg(F.min("stay_id").alias("stay_id"))
    side = math.degrees(radius_m / 2**0.5 / 1.01 / EARTH_M)
    row = F.floor(F.col("center_lat") / F.lit(side))
    low = F.least(F.abs(row * F.lit(side)), F.abs((row + 1) * F.lit(side)))
    small = place.withColumns({"cy": row, "cx": F.floor(F.col("center_lon") / (F.lit(side) / F.greatest(F.cos(F.radians(low)), F.lit(1e-9))))})
    firsts = small.groupBy("cy", "cx").agg(F.min("stay_id").alias("first"))
    tied = small.join(firsts, ["cy", "cx"]).where("stay_id != first").select(F.col("stay_id").alias("u"), F.col("first").alias("v"))
    at = [F.col("center_lon"), F.col("center_lat")]
    same = stays.select(F.col("stay_id").alias("u"), *at).join(place.withColumnRenamed("stay_id", "v"), ["center_lon", "center_lat"]).where("u != v").select("u", "v")
    # Stays of one small cell are tied already; of others one pair of two small cells is enough.
    a = at_home(small, "center_lon", "center_lat", radius_m)
    b = around(small.select(F.col("stay_id").alias("other"), F.col("center_lon").alias("lon2"), F.col("center_lat").alias("lat2"), F.col("cy").alias("cy2"), F.col("cx").alias("cx2")), "lon2", "lat2", radius_m)
    near = haversine(*at, F.col("lon2"), F.col("lat2")) <= radius_m
    apart = (F.col("cy") < F.col("cy2")) | ((F.col("cy") == F.col("cy2")) & (F.col("cx") < F.col("cx2")))
    met = a.join(b, ["by", "bx"]).where(apart & near).groupBy("cy", "cx", "cy2", "cx2").agg(F.min(F.struct(F.col("stay_id").alias("u"), F.col("other").alias("v"))).alias("one")).select("one.*")
    return tied.unionByName(same).unionByName(met)


def ranked(spots: DataFrame, count: int, spots_per_range: int = 50_000) -> DataFrame:
    """count spots with their rank: by track_count, visit_count and total_duration_s, largest first, then by latitude, longitude and spot.

    Spots are sorted in ranges and written with their places; a range's offset, one small row a range,
    joins back. No task sorts more than a range, however many spots are alike.
    """
    order = [*[F.desc(c) for c in ("track_count", "visit_count", "total_duration_s")], F.asc("lat"), F.asc("lon"), F.asc("spot")]
    placed = spots.repartitionByRange(max(1, -(-count // spots_per_range)), *order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("place", F.monotonically_increasing_id()), "spots").withColumn("range", F.shiftright("place", 33))
    sizes = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = F.sum("n").over(W.orderBy("range")) - F.col("n")  # over a row a range
    return placed.join(sizes.select("range", "first", before.alias("before")), "range").withColumn("rank", (F.col("place") - F.col("first") + F.col("before") + 1).cast("int"))


def resorted(found: DataFrame, by: str = "track_count") -> DataFrame:
    """Hotspots again, largest first by track_count (as for unknown keys), visit_count or total_duration_s; ties keep their rank."""
    key = by if by in ("track_count", "visit_count", "total_duration_s") else "track_count"
    return found.orderBy(F.desc_nulls_last(key), "rank")


def hotspots(stays: DataFrame, radius_m: float = RADIUS_M, min_visits: int = MIN_VISITS) -> DataFrame:
    """Ranked hotspots: rank, center_lon, center_lat, visit_count, track_count, total_duration_s, radius_m, first_visit, last_visit, track_ids."""
    check_hotspot(radius_m, min_visits)
    ids = F.xxhash64("track_id", "seq_start")
    stays = materialize(stays.withColumn("stay_id", ids), "stays")
    root = components(links(stays, radius_m))
    tagged = stays.join(root, stays["stay_id"] == root["node"], "left").withColumn("spot", F.coalesce("root", "stay_id")).drop("node", "root")
    # Decimal sums do not depend on the order of rows, so that places of equal centres tie in each run.
    mean = lambda c: F.sum(F.col(c).cast("decimal(28,20)")).cast("double") / F.count(c)
    spots = tagged.groupBy("spot").agg(
        mean("center_lon").alias("lon"), mean("center_lat").alias("lat"), F.count(F.lit(1)).alias("visit_count"), F.countDistinct("track_id").alias("track_count"),
        F.sum(F.col("duration_s").cast("long")).alias("total_duration_s"), F.min("start_time").alias("first_visit"), F.max("end_time").alias("last_visit"), F.sort_array(F.collect_set("track_id")).alias("track_ids"),
    ).where(F.col("visit_count") >= min_visits)
    spots = materialize(spots, "groups")  # two branches read it
    reach = tagged.join(spots, "spot").groupBy("spot").agg(F.max(haversine(F.col("lon"), F.col("lat"), F.col("center_lon"), F.col("center_lat"))).alias("radius_m"))
    out = ranked(spots.join(reach, "spot"), spots.count())
    return out.select("rank", F.col("lon").alias("center_lon"), F.col("lat").alias("center_lat"), "visit_count", "track_count", "total_duration_s", "radius_m", "first_visit", "last_visit", "track_ids")
