"""Track tables: listing, lookup, names, import decisions, removal and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import iso
from waymark.functions.regions import check_limit


def list_tracks(tracks: DataFrame, source: str | None = None, limit: int = 100) -> DataFrame:
    """The newest tracks first; limit is clamped to 1..500."""
    limit = check_limit(min(500, max(1, limit)))
    kept = tracks if source is None else tracks.where(F.col("source") == source)
    return kept.orderBy(F.desc("start_time"), F.desc("track_id")).limit(limit)


def points_of(points: DataFrame, ids: list[int]) -> DataFrame:
    return points.where(F.col("track_id").isin(ids)).orderBy("track_id", "seq")


def normalize_name(raw: Column) -> Column:
    """One line, trimmed; null where nothing is left or more than 200 characters are."""
    name = F.trim(F.regexp_replace(raw, r"[\r\n\t]+", " "))
    return F.when((name != "") & (F.char_length(name) <= 200), name)


#: Fixed value: characters that file names must not hold.
_NOT_IN_NAMES = r'[\\/:*?"<>|\s]+'


def safe_file_name(raw: Column) -> Column:
    name = F.regexp_replace(raw, _NOT_IN_NAMES, "_")
    return F.when(F.coalesce(raw, F.lit("")).rlike(r"^\s*$"), "unnamed").when(name.isin(".", ".."), "unnamed").otherwise(F.substring(name, 1, 80))


def export_name(stamp: Column, name: Column, points: Column) -> Column:
    return F.concat(stamp, F.lit("_"), safe_file_name(name), F.lit("_"), points.cast("string"), F.lit("点.geojson"))


def name_conflicts(tracks: DataFrame) -> DataFrame:
    """(track_id, name, other_id): the smallest other track of the same name."""
    sizes = tracks.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("track_id").alias("first"))
    shared = tracks.join(sizes.where("n > 1"), "name")
    second = shared.where(F.col("track_id") != F.col("first")).groupBy("name").agg(F.min("track_id").alias("second"))
    met = shared.join(second, "name")
    return met.select("track_id", "name", F.when(F.col("track_id") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("other_id"))


def import_plan(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """What importing each file would do.

    existing: track_id, name, source, external_id. incoming: file, name, source, external_id, mode
    (append or replace), replace_id, allow_same_name. Result: file, action (skip, conflict_content,
    conflict_name, insert, replace, error), track_id (the one concerned).
    """
    by_hash = existing.groupBy("external_id").agg(F.min("track_id").alias("hash_id"))
    by_name = existing.groupBy("name").agg(F.min("track_id").alias("name_id"))
    ids = existing.select(F.col("track_id").alias("replace_id"), F.col("source").alias("replace_source"))
    met = incoming.join(by_hash, "external_id", "left").join(by_name, "name", "left").join(ids, "replace_id", "left")
    replace, same = F.col("mode") == "replace", F.col("hash_id").isNotNull()
    action = (
        F.when(same & ~replace, "skip")
        .when(same & ~F.col("hash_id").eqNullSafe(F.col("replace_id")), "conflict_content")
        .when(~replace & F.col("name_id").isNotNull() & ~F.col("allow_same_name"), "conflict_name")
        .when(replace & (F.col("replace_id").isNull() | F.col("replace_source").isNull() | (F.col("replace_source") != F.col("source"))), "error")
        .when(replace, "replace")
        .otherwise("insert")
    )
    concerned = F.when(action.isin("skip", "conflict_content"), F.col("hash_id")).when(action == "conflict_name", F.col("name_id")).when(action == "replace", F.col("replace_id"))
    return met.select("file", action.alias("action"), concerned.alias("track_id"))


def import_report(result: DataFrame, most_errors: int = 5) -> dict:
    """Counts of an import's rows (file, action) and at most most_errors of its failures, by file."""
    counts = {r.action: r.n for r in result.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row an action
    failed = ~F.col("action").isin("insert", "replace", "skip", "left")
    errors = [f"{r.file}: {r.action}" for r in result.where(failed).orderBy("file").limit(most_errors).collect()]
    done, passed = counts.get("insert", 0) + counts.get("replace", 0), counts.get("skip", 0) + counts.get("left", 0)
    total = sum(counts.values())
    return {"files": total, "imported": done, "skipped": passed, "failed": total - done - passed, "errors": errors}


def without(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose track_id is not among ids: one side of a cascading delete."""
    return table.join(ids.select("track_id"), "track_id", "left_anti")


def geojson(points: DataFrame, tracks: DataFrame) -> DataFrame:
    """(track_id, geojson): a FeatureCollection with one LineString, its coordinates [lon, lat, ele] and times.

    A missing elevation is written as 0.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "lon", "lat", F.coalesce("elevation_m", F.lit(0.0)).alias("ele"), iso(F.col("recorded_at")).alias("time"))))
    lines = points.groupBy("track_id").agg(ordered.alias("p"), F.count(F.lit(1)).alias("n"))
    met = lines.join(tracks.select("track_id", "name", "source", "external_id", "start_time", "end_time", "distance_m"), "track_id")
    properties = F.struct(
        F.col("track_id").alias("trackId"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("external_id", F.lit("")).alias("externalId"),
        iso(F.col("start_time")).alias("startTime"), iso(F.col("end_time")).alias("endTime"), F.col("n").alias("pointCount"), F.coalesce("distance_m", F.lit(0.0)).alias("lengthM"), F.transform("p", lambda x: x["time"]).alias("times"),
    )
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform("p", lambda x: F.array(x["lon"], x["lat"], x["ele"])).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))
    return met.select("track_id", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))).alias("geojson"))
