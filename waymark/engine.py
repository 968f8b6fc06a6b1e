"""A store of tracks and the questions asked of it.

Points are only ever appended, a folder for each import; the table of tracks is written anew as the
next version and tells which import each track's points come from. A version counts once it is
written, so a failed import, rename or deletion leaves the store as it was. One writer at a time:
the second to write a version fails.
"""

from __future__ import annotations

import os
import posixpath
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.functions.regions import check_limit, check_name, check_tolerance, parse_bbox, parse_region, pick_cell_size
from waymark.operators import clean, density, hotspots, similarity, stays, tracks, within
from waymark.operators.storage import materialize
from waymark.sources.files import content_hash, parse_any, read_texts

POINTS = "track_id long, seq long, recorded_at timestamp, lon double, lat double, elevation_m double, speed_mps double, is_outlier boolean"
TRACKS = "track_id long, name string, source string, external_id string, start_time timestamp, end_time timestamp, duration_s int, point_count long, distance_m double, batch string"


class TrackNotFound(LookupError):
    """No track has this id."""


class TrackConflict(ValueError):
    """The import needs a decision; rows has the action and the track concerned for each file."""

    def __init__(self, rows: list) -> None:
        super().__init__("; ".join(f"{r.file}: {r.action} with track {r.track_id}" for r in rows))
        self.rows = rows


class ExportFailed(RuntimeError):
    """The track could not be written before its removal, so it was kept."""


def _below(path: str, root: str) -> bool:
    """Whether path is root or lies below it, with . and .. resolved."""

    def parts(text: str) -> list[str]:
        scheme, colon, rest = text.partition("://")
        if not colon:
            scheme, rest = "file", os.path.abspath(text)
        return [scheme, *[p for p in posixpath.normpath("/" + rest).split("/") if p]]

    wanted = parts(root)
    return parts(path)[: len(wanted)] == wanted


class Engine:
    def __init__(self, spark: SparkSession, base: str, import_roots: list[str] | None = None) -> None:
        """import_roots: the folders below which import_dir() may read; None allows all, an empty list none."""
        self.spark, self.base, self.import_roots = spark, base.rstrip("/"), import_roots
        self._kept: dict[tuple, DataFrame] = {}
        try:
            self._version()
        except AnalysisException:
            spark.createDataFrame([], TRACKS).write.parquet(f"{self.base}/tracks/version=0")
            spark.createDataFrame([], POINTS).write.parquet(f"{self.base}/points/batch=none")

    def health(self) -> dict[str, str]:
        return {"status": "ok", "spark": self.spark.version}

    # Tables

    def _version(self) -> int:
        return self.spark.read.schema(f"{TRACKS}, version long").parquet(f"{self.base}/tracks").agg(F.max("version")).first()[0] or 0

    def tracks(self) -> DataFrame:
        return self.spark.read.schema(TRACKS).parquet(f"{self.base}/tracks/version={self._version()}")

    def points(self) -> DataFrame:
        """Points of the tracks that there are now."""
        rows = self.spark.read.schema(f"{POINTS}, batch string").parquet(f"{self.base}/points")
        return rows.join(self.tracks().select("track_id", "batch"), ["track_id", "batch"], "left_semi").drop("batch")

    def _commit(self, rows: DataFrame) -> None:
        rows.select(*[c.split()[0] for c in TRACKS.split(", ")]).write.parquet(f"{self.base}/tracks/version={self._version() + 1}")
        for df in self._kept.values():
            df.unpersist()
        self._kept.clear()

    def _cached(self, key: tuple, make) -> DataFrame:
        """Results kept until the store changes; the key holds all that the result depends on, and no limit."""
        if key not in self._kept:
            self._kept[key] = make().persist()
        return self._kept[key]

    def _points_of(self, track: DataFrame) -> DataFrame:
        """Points of one track, read from its own import's folder alone."""
        row = track.first()
        rows = self.spark.read.schema(f"{POINTS}, batch string").parquet(f"{self.base}/points")
        return rows.where((F.col("batch") == row["batch"]) & (F.col("track_id") == row["track_id"])).drop("batch")

    def _known(self, track_id: int) -> DataFrame:
        found = self.tracks().where(F.col("track_id") == track_id)
        if not found.take(1):
            raise TrackNotFound(f"there is no track {track_id}")
        return found

    # Import and editing

    def import_dir(self, path: str, glob: str | None = None, most_tracks: int | None = None) -> DataFrame:
        """Append all track files below path; repeated contents are skipped. Rows (file, action, track_id)."""
        if self.import_roots is not None and not any(_below(path, root) for root in self.import_roots if root.strip()):
            raise ValueError(f"{path} is not below one of the allowed folders {self.import_roots}")
        return self.import_texts(read_texts(self.spark, path, glob), allow_same_name=True, most_tracks=most_tracks, strict=False)

    def import_file(self, path: str, name: str | None = None, mode: str = "append", replace_id: int | None = None, allow_same_name: bool = False) -> DataFrame:
        """One file; TrackConflict where the content or the name is there already, ValueError if nothing can be read."""
        return self.import_texts(read_texts(self.spark, path), name, mode, replace_id, allow_same_name)

    def import_texts(self, files: DataFrame, name: str | None = None, mode: str = "append", replace_id: int | None = None, allow_same_name: bool = False, most_tracks: int | None = None, strict: bool = True) -> DataFrame:
        """Import (file, value) texts. With strict, conflicts and unreadable files raise; else they are rows of the result.

        Actions: insert, replace, skip (content known or repeated within the call), unreadable (fewer
        than two valid points), left (beyond most_tracks), conflict_content, conflict_name, error.
        """
        if mode not in ("append", "replace"):
            raise ValueError("mode is append or replace")
        given = F.lit(check_name(name) if name is not None else None).cast("string")
        parsed = materialize(parse_any(files), "parsed")
        heads = parsed.groupBy("file").agg(F.first("format").alias("source"), F.first("name").alias("own_name"), F.count(F.lit(1)).alias("n"))
        stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
        hashed = files.select("file", content_hash(F.col("value")).alias("external_id"))
        incoming = hashed.join(heads, "file", "left").select(
            "file", "external_id", "source", F.coalesce(given, tracks.normalize_name(F.col("own_name")), tracks.normalize_name(stem), F.lit("unnamed")).alias("name"),
            F.lit(mode).alias("mode"), F.lit(replace_id).cast("long").alias("replace_id"), F.lit(allow_same_name).alias("allow_same_name"), F.coalesce("n", F.lit(0)).alias("n"),
        )
        now = self.tracks()
        plan = incoming.join(tracks.import_plan(now, incoming), "file")
        again = F.row_number().over(W.partitionBy("external_id").orderBy("file")) > 1
        action = F.when(F.col("n") < 2, "unreadable").when((F.col("action") == "insert") & again, "skip").otherwise(F.col("action"))
        plan = materialize(plan.withColumn("action", action), "plan")
        if most_tracks is not None:
            within_limit = plan.where("action = 'insert'").orderBy("file").limit(most_tracks).select("file", F.lit(True).alias("_in"))
            plan = plan.join(within_limit, "file", "left").withColumn("action", F.when((F.col("action") == "insert") & F.col("_in").isNull(), "left").otherwise(F.col("action"))).drop("_in")
        # An id that follows from the content needs no counter.
        new_id = F.xxhash64("external_id").bitwiseAND(F.lit((1 << 63) - 1))
        plan = materialize(plan.withColumn("track_id", F.when(F.col("action") == "insert", new_id).otherwise(F.col("track_id"))), "plan")
        if strict:
            if rows := plan.where(F.col("action").startswith("conflict")).limit(20).collect():
                raise TrackConflict(rows)
            if rows := plan.where(F.col("action").isin("unreadable", "error")).limit(20).collect():
                raise ValueError("; ".join(f"{r.file}: {r.action}" for r in rows))
        done = plan.where(F.col("action").isin("insert", "replace"))
        if done.take(1):
            batch = uuid.uuid4().hex
            rows = parsed.join(done.select("file", "track_id"), "file").select("track_id", F.col("line").cast("long").alias("seq"), "recorded_at", "lon", "lat", "elevation_m")
            cleaned = clean.clean_track(rows)
            cleaned.select(*[c.split()[0] for c in POINTS.split(", ")]).write.parquet(f"{self.base}/points/batch={batch}")
            written = self.spark.read.schema(POINTS).parquet(f"{self.base}/points/batch={batch}")
            old = now.select("track_id", F.col("name").alias("old_name"))
            fresh = clean.track_summary(written).join(done.select("track_id", "name", "source", "external_id"), "track_id").join(old, "track_id", "left")
            fresh = fresh.withColumn("name", F.coalesce("old_name", "name")).withColumn("batch", F.lit(batch))
            self._commit(tracks.without(now, done).select(*now.columns).unionByName(fresh.select(*now.columns)))
        return plan.select("file", "action", "track_id")

    def rename(self, track_id: int, name: str) -> None:
        name = check_name(name)
        self._known(track_id)
        self._commit(self.tracks().withColumn("name", F.when(F.col("track_id") == track_id, name).otherwise(F.col("name"))))

    def delete(self, track_id: int, export_to: str | None = None) -> None:
        """Write the track as GeoJSON below export_to, if given, then take it out."""
        gone = self._known(track_id).select("track_id")
        if export_to is not None:
            try:
                self.export(track_id).write.mode("error").text(export_to)
            except Exception as e:
                raise ExportFailed(f"track {track_id} was not written to {export_to} and is kept") from e
        self._commit(tracks.without(self.tracks(), gone))

    def export(self, track_id: int) -> DataFrame:
        """One row, one column: the track as GeoJSON text."""
        found = self._known(track_id)
        return tracks.geojson(self._points_of(found), found).select("geojson")

    # Questions

    def list_tracks(self, source: str | None = None, limit: int = 100) -> DataFrame:
        return tracks.list_tracks(self.tracks(), source, limit)

    def track_detail(self, track_id: int) -> tuple[DataFrame, DataFrame]:
        """The track's row and its points in order."""
        found = self._known(track_id)
        return found, self._points_of(found).orderBy("seq")

    def _stays(self) -> DataFrame:
        return self._cached(("stays",), lambda: stays.stay_points(self.points()))

    def stay_points(self, track_id: int) -> DataFrame:
        self._known(track_id)
        return self._stays().where(F.col("track_id") == track_id)

    def hotspots(self, radius_m: float = hotspots.RADIUS_M, min_visits: int = hotspots.MIN_VISITS, start: str | None = None, end: str | None = None) -> DataFrame:
        return hotspots.hotspots(hotspots.within_time(self._stays(), start, end), radius_m, min_visits)

    def density(self, bbox: str, cell_size: float | None = None, **limits) -> DataFrame:
        """limits: metric, hour_from, hour_to, start, end."""
        box = parse_bbox(bbox)
        return density.density(self.points(), box, cell_size or pick_cell_size(box), **limits)

    def similarity(self, track_id: int, tolerance_m: float = 50.0, limit: int = 20, min_similarity: float = 0.0) -> DataFrame:
        check_limit(limit), check_tolerance(tolerance_m)
        if self._known(track_id).first()["point_count"] < 2:
            raise ValueError(f"track {track_id} has fewer than two points")
        made = lambda: similarity.most_similar(self.points(), self.tracks(), track_id, tolerance_m, 500)
        found = similarity.at_least(self._cached(("similarity", track_id, tolerance_m), made), min_similarity)
        return found.orderBy(F.desc("similarity"), "track_id").limit(limit)

    def within(self, geometry: str | dict, buffer_m: float | None = None, start: str | None = None, end: str | None = None, limit: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The tracks that cross a region, most points inside first; totals over all of them; and the answer's
        one row of total_hits, truncated, inside_points and geometry."""
        check_limit(limit)
        region = parse_region(geometry, buffer_m)
        found = within.matched(self.points(), self.tracks(), region, start, end)
        return within.items(found, limit), within.stats(found), within.response(found, region, limit)
