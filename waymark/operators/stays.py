"""Stay points: greedy windows of small spread and enough time."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.functions.geo import EARTH_M

DIAMETER_M, MIN_STAY_S, MAX_GAP_S = 50.0, 300, 300
#: Points of a track, by seq, whose gaps one task looks for.
PIECE = 100_000
SCHEMA = "track_id long, seq_start long, seq_end long, start_time timestamp, end_time timestamp, duration_s int, center_lon double, center_lat double, radius_m double, point_count int"
FOUND = SCHEMA.replace("timestamp", "long")


def _spread(lon: np.ndarray, lat: np.ndarray, c_lon: float, c_lat: float) -> float:
    """The largest distance in metres from a centre."""
    a = np.sin(np.radians(lat - c_lat) / 2) ** 2 + math.cos(math.radians(c_lat)) * np.cos(np.radians(lat)) * np.sin(np.radians(lon - c_lon) / 2) ** 2
    return float(2 * EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(a))).max())


def _far(lon: float, lat: float, c_lon: float, c_lat: float) -> float:
    a = math.sin(math.radians(lat - c_lat) / 2) ** 2 + math.cos(math.radians(c_lat)) * math.cos(math.radians(lat)) * math.sin(math.radians(lon - c_lon) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1.0, math.sqrt(a)))


def _windows(ms: np.ndarray, lon: np.ndarray, lat: np.ndarray, diameter_m: float, min_s: int) -> list[tuple[int, int, float, float, float]]:
    """Stays (first, last, lon, lat, radius) of points without a gap among them.

    The newest point's distance from the centre is a lower bound of the radius and the window's box
    gives an upper one; all distances are taken only where the two leave the answer open.
    """
    x, y, out, i, n = lon.tolist(), lat.tolist(), [], 0, len(ms)
    while i < n:
        s_lon, s_lat, end = x[i], y[i], i
        west = east = x[i]
        south = north = y[i]
        while end + 1 < n:
            # Sums run from left to right; the centre moves with each point.
            p, q, count = x[end + 1], y[end + 1], end + 2 - i
            t_lon, t_lat = s_lon + p, s_lat + q
            c_lon, c_lat = t_lon / count, t_lat / count
            if _far(p, q, c_lon, c_lat) * 2 > diameter_m * 1.000001:
                break
            west, east, south, north = min(west, p), max(east, p), min(south, q), max(north, q)
            # No place of the box is further off than its two sides together, measured where they are longest.
            wide, high = max(east - c_lon, c_lon - west), max(north - c_lat, c_lat - south)
            level = math.cos(math.radians(max(0.0, min(abs(south), abs(north)) if south * north > 0 else 0.0)))
            if math.radians(math.hypot(wide * level, high)) * EARTH_M * 2 > diameter_m * 0.999 and _spread(lon[i : end + 2], lat[i : end + 2], c_lon, c_lat) * 2 > diameter_m:
                break
            s_lon, s_lat, end = t_lon, t_lat, end + 1
        if end > i and (ms[end] - ms[i]) // 1000 >= min_s:
            c_lon, c_lat = s_lon / (end - i + 1), s_lat / (end - i + 1)
            out.append((i, end, c_lon, c_lat, _spread(lon[i : end + 1], lat[i : end + 1], c_lon, c_lat)))
            i = end + 1
        else:
            i += 1
    return out


def stays_of_run(track: int, ms: np.ndarray, seq: np.ndarray, lon: np.ndarray, lat: np.ndarray, diameter_m: float, min_s: int) -> list[tuple]:
    """The rows of FOUND for points of one track without a gap among them."""
    found = _windows(ms, lon, lat, diameter_m, min_s)
    return [(track, seq[i], seq[j], ms[i], ms[j], (ms[j] - ms[i]) // 1000, c_lon, c_lat, r, j - i + 1) for i, j, c_lon, c_lat, r in found]


def with_runs(points: DataFrame, max_gap_s: int = MAX_GAP_S, piece: int = PIECE) -> DataFrame:
    """Points (track_id, seq, ms, ...) with run: how many gaps of over max_gap_s lie before the point in its track.

    Tracks are cut in pieces by seq. Gaps are found and counted within pieces; what lies between pieces, one
    small row a piece, is added after. So no task sorts a whole track, and points are shuffled once.
    Points without a track are one track in one piece; a null seq is the first.
    """
    at = F.when(F.col("track_id").isNull(), 0).otherwise(F.coalesce(F.floor(F.col("seq") / piece), F.lit(-(1 << 62))))
    cut = points.withColumn("piece", at).repartition("track_id", "piece")
    along, pieces = W.partitionBy("track_id", "piece").orderBy("seq"), W.partitionBy("track_id").orderBy("piece")

    def is_gap(later: Column, earlier: Column) -> Column:
        return F.coalesce(F.floor((later - earlier) / 1000) > max_gap_s, F.lit(False)).cast("long")

    cut = cut.withColumn("gap", is_gap(F.col("ms"), F.lag("ms").over(along))).withColumn("run", F.sum("gap").over(along))
    ends = cut.groupBy("track_id", "piece").agg(F.sum("gap").alias("n"), F.min_by("ms", "seq").alias("first"), F.max_by("ms", "seq").alias("last"))
    ends = ends.withColumn("edge", is_gap(F.col("first"), F.lag("last").over(pieces)))
    before = ends.select("track_id", "piece", (F.sum(F.col("n") + F.col("edge")).over(pieces) - F.col("n")).alias("before")).where("before > 0")
    return cut.join(before, ["track_id", "piece"], "left").withColumn("run", F.col("run") + F.coalesce("before", F.lit(0))).drop("piece", "gap", "before")


def stay_points(points: DataFrame, diameter_m: float = DIAMETER_M, min_stay_s: int = MIN_STAY_S, max_gap_s: int = MAX_GAP_S, piece: int = PIECE) -> DataFrame:
    """One row a stay.

    From each point a window grows while gaps stay within max_gap_s and twice the distance from
    its centroid within diameter_m; if it lasts min_stay_s it is a stay and the next window begins
    after it, else one point further on. No window crosses a longer gap, so a track falls into runs
    without one: each is read by one task, which holds no more than a batch and the run at its end.
    """
    columns = [c.split()[0] for c in FOUND.split(", ")]

    def detect(run: pd.DataFrame) -> list[tuple]:
        return stays_of_run(run["track_id"].iat[0], *[run[c].to_numpy() for c in ("ms", "seq", "lon", "lat")], diameter_m, min_stay_s)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the run at the end of what was read
        for batch in chain(batches, [None]):
            if batch is not None and not len(batch):
                continue
            rows: list[tuple] = []
            runs = _runs(batch) if batch is not None else []
            if held and (not runs or _key(held[0]) != _key(runs[0])):
                rows += detect(pd.concat(held))
                held = []
            for k, run in enumerate(runs):
                held.append(run)
                if k + 1 < len(runs):
                    rows += detect(pd.concat(held) if len(held) > 1 else run)
                    held = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    slim = points.select("track_id", "seq", F.unix_millis("recorded_at").alias("ms"), "lon", "lat")
    found = with_runs(slim, max_gap_s, piece).repartition("track_id", "run").sortWithinPartitions("track_id", "run", "seq").mapInPandas(scan, FOUND)
    return found.select(*[F.timestamp_millis(c).alias(c) if c.endswith("_time") else c for c in columns])


def _key(run: pd.DataFrame) -> tuple:
    return run["track_id"].iat[0], run["run"].iat[0]


def _runs(batch: pd.DataFrame) -> list[pd.DataFrame]:
    """The batch cut where the track or the run changes."""
    track, run = batch["track_id"].to_numpy(), batch["run"].to_numpy()
    cuts = np.nonzero((track[1:] != track[:-1]) | (run[1:] != run[:-1]))[0] + 1
    return [batch.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True)]
