"""Cleaning: order, speed, drift flags, elevation, and what a track derives from its points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

from waymark.functions.geo import haversine

MAX_SPEED, MEDIAN_FACTOR = 8.0, 3.0


def along_track() -> WindowSpec:
    return W.partitionBy("track_id").orderBy("seq")


def whole_track() -> WindowSpec:
    return W.partitionBy("track_id")


def clean_sequence(points: DataFrame, order: str = "seq") -> DataFrame:
    """Renumber seq from 0 by time, keeping the given order among equal times."""
    by_time = W.partitionBy("track_id").orderBy("recorded_at", order)
    return points.withColumn("seq", (F.row_number().over(by_time) - 1).cast("long"))


def with_step(points: DataFrame) -> DataFrame:
    """Add step_m (metres from the point before, 0 at the first) and speed_mps (null at the first and where time stands still)."""
    lag = lambda c: F.lag(c).over(along_track())
    step = haversine(lag("lon"), lag("lat"), F.col("lon"), F.col("lat"))
    seconds = (F.unix_millis("recorded_at") - F.unix_millis(lag("recorded_at"))) / 1000.0
    return points.withColumns({"step_m": F.coalesce(step, F.lit(0.0)), "speed_mps": F.when(seconds > 0, step / seconds)})


def speed_threshold(stepped: DataFrame) -> DataFrame:
    """(track_id, threshold): the larger of 8 m/s and three exact medians of the positive speeds."""
    median = F.percentile(F.when(F.col("speed_mps") > 0, F.col("speed_mps")), 0.5)
    return stepped.groupBy("track_id").agg(F.coalesce(F.greatest(F.lit(MAX_SPEED), MEDIAN_FACTOR * median), F.lit(MAX_SPEED)).alias("threshold"))


def with_outliers(stepped: DataFrame) -> DataFrame:
    """Add is_outlier: both ends of every step faster than the track's threshold.

    The median is a window aggregate over the same partitioning as the steps: one shuffle in all.
    """
    median = F.percentile(F.when(F.col("speed_mps") > 0, F.col("speed_mps")), F.lit(0.5)).over(whole_track())
    threshold = F.coalesce(F.greatest(F.lit(MAX_SPEED), MEDIAN_FACTOR * median), F.lit(MAX_SPEED))
    fast = stepped.withColumn("_fast", F.coalesce(F.col("speed_mps") > threshold, F.lit(False)))
    return fast.withColumn("is_outlier", F.col("_fast") | F.coalesce(F.lead("_fast").over(along_track()), F.lit(False))).drop("_fast")


def normalized_elevation() -> Column:
    """elevation_m, or null for a whole track of one repeated elevation."""
    e = F.col("elevation_m")
    n, known = F.count(F.lit(1)).over(whole_track()), F.count(e).over(whole_track())
    same = (known == 0) | ((known == n) & (F.min(e).over(whole_track()) == F.max(e).over(whole_track())))
    return F.when(~same, e)


def clean_track(points: DataFrame) -> DataFrame:
    """The whole chain: ordered, with speed, drift flags and elevation; tracks need two points."""
    out = with_outliers(with_step(clean_sequence(points)))
    out = out.withColumn("elevation_m", normalized_elevation()).withColumn("_n", F.count(F.lit(1)).over(whole_track()))
    return out.where("_n >= 2").drop("_n")


def track_summary(points: DataFrame) -> DataFrame:
    """(track_id, point_count, start_time, end_time, duration_s, distance_m)."""
    seconds = F.unix_seconds(F.max("recorded_at")) - F.unix_seconds(F.min("recorded_at"))
    return with_step(points).groupBy("track_id").agg(
        F.count(F.lit(1)).alias("point_count"), F.min("recorded_at").alias("start_time"), F.max("recorded_at").alias("end_time"),
        seconds.cast("int").alias("duration_s"), F.sum("step_m").alias("distance_m"),
    )


def make_line(points: DataFrame) -> DataFrame:
    """(track_id, line): the ordered array of (seq, lon, lat) of each track."""
    return points.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))).alias("line"))


def interpolated(points: DataFrame, fractions: list[float]) -> DataFrame:
    """(track_id, fraction, lon, lat): the places that lie these fractions of a track's planar length along it.

    Points without a place are passed over; a track of one place, or of no length, gives that place for
    every fraction. Each fraction is looked for in the steps' cumulative lengths: one row a step and
    fraction that falls within it.
    """
    if not fractions or not all(0 <= f <= 1 for f in fractions):
        raise ValueError("fractions lie between 0 and 1")
    lag = lambda c: F.coalesce(F.lag(c).over(along_track()), F.col(c))
    steps = points.where("lon is not null and lat is not null").select("track_id", "seq", "lon", "lat", lag("lon").alias("lon0"), lag("lat").alias("lat0"))
    dx, dy = F.col("lon") - F.col("lon0"), F.col("lat") - F.col("lat0")
    steps = steps.withColumn("len", F.sqrt(dx * dx + dy * dy)).withColumn("end", F.sum("len").over(along_track()))
    steps = steps.withColumns({"whole": F.max("end").over(whole_track()), "first": F.row_number().over(along_track()) == 1})
    asked = steps.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    at, begin = F.col("fraction") * F.col("whole"), F.col("end") - F.col("len")
    # The first point stands for all that lies at 0; after it a step holds its own end but not its beginning.
    held = F.when(F.col("first"), at <= 0).otherwise((at > F.lag("end").over(W.partitionBy("track_id", "fraction").orderBy("seq"))) & (at <= F.col("end")))
    share = F.coalesce((at - begin) / F.nullif(F.col("len"), F.lit(0.0)), F.lit(0.0))
    along = lambda c: F.col(f"{c}0") + (F.col(c) - F.col(f"{c}0")) * share
    return asked.withColumn("held", held).where("held").select("track_id", "fraction", along("lon").alias("lon"), along("lat").alias("lat"))


def mean_speed_kmh(distance_m: Column, duration_s: Column) -> Column:
    return distance_m / F.nullif(duration_s, F.lit(0)) * 3.6


def value_at(points: DataFrame, epoch_s: Column, value: str = "elevation_m") -> DataFrame:
    """(track_id, value): linear interpolation at a time, held at the ends; null values are passed over."""
    known = points.where(F.col(value).isNotNull()).select("track_id", F.unix_millis("recorded_at").alias("ms"), F.col(value).alias("v"), (epoch_s.cast("long") * 1000).alias("at"))
    before = F.max(F.when(F.col("ms") <= F.col("at"), F.struct("ms", "v")))
    after = F.min(F.when(F.col("ms") >= F.col("at"), F.struct("ms", "v")))
    got = known.groupBy("track_id").agg(before.alias("a"), after.alias("b"), F.min("at").alias("at"))
    span = F.col("b.ms") - F.col("a.ms")
    between = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * ((F.col("at") - F.col("a.ms")) / span)
    return got.select("track_id", F.when(F.col("a").isNull(), F.col("b.v")).when(F.col("b").isNull() | (span == 0), F.col("a.v")).otherwise(between).alias("value"))


def playback_stats(points: DataFrame, play_seconds: float = 20.0) -> DataFrame:
    """(track_id, can_play, span_s, multiplier): how much faster than real time a replay runs."""
    n, known = F.count(F.lit(1)), F.count("recorded_at")
    span = (F.unix_millis(F.max("recorded_at")) - F.unix_millis(F.min("recorded_at"))) / 1000.0
    got = points.groupBy("track_id").agg(((n >= 2) & (n == known) & (span > 0)).alias("can_play"), span.alias("span_s"))
    return got.withColumn("multiplier", F.when(F.col("can_play"), F.col("span_s") / play_seconds).otherwise(1.0))
