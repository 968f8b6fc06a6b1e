"""Track files: format sniffing, PLT and GPX text to points, directory scans, content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD_BYTES, SCAN_LINES, FEET_M = 4096, 50, 0.3048
_NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
#: ISO times of a known offset; others name no instant.
OFFSET_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2}(:\d{2})?)$"
_GPX = "trk array<struct<name:string,trkseg:array<struct<trkpt:array<struct<_lat:string,_lon:string,ele:string,time:string>>>>>>"


def content_hash(content: Column) -> Column:
    """The first 16 bytes of the SHA-256, in hex."""
    return F.substring(F.sha2(content, 256), 1, 32)


def sniff(text: Column) -> Column:
    """gpx, geolife or unknown, from a file's first bytes; names and extensions do not count."""
    head = F.trim(F.coalesce(F.substring(text, 1, HEAD_BYTES), F.lit("")))
    lines = F.slice(F.filter(F.transform(F.split(head, r"\R"), lambda s: F.trim(s)), lambda s: s != ""), 1, SCAN_LINES)

    def plt_row(line: Column) -> Column:
        f = F.split(line, ",")
        at = lambda i: F.try_element_at(f, F.lit(i))
        numbers = at(1).rlike(_NUMBER) & at(2).rlike(_NUMBER) & at(4).rlike(_NUMBER)
        return (F.size(f) == 7) & numbers & F.trim(at(6)).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & F.trim(at(7)).rlike(r"^\d{1,2}:\d{2}:\d{2}$")

    return F.when(head.startswith("<?xml") | head.contains("<gpx"), "gpx").when(F.exists(lines, plt_row), "geolife").otherwise("unknown")


def _on_earth(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def parse_plt(files: DataFrame) -> DataFrame:
    """(file, value) texts to file, line, lat, lon, elevation_m, recorded_at; unreadable rows are left out. Times are in UTC."""
    rows = files.select("file", F.posexplode(F.split("value", r"\R")).alias("line", "row")).withColumn("f", F.split("row", ","))
    at = lambda i: F.trim(F.try_element_at("f", F.lit(i)))
    parsed = rows.where(F.size("f") >= 7).select(
        "file", "line", at(1).try_cast("double").alias("lat"), at(2).try_cast("double").alias("lon"), (at(4).try_cast("double") * FEET_M).alias("elevation_m"),
        F.try_to_timestamp(F.concat(at(6), F.lit(" "), at(7), F.lit("Z")), F.lit("yyyy-MM-dd HH:mm:ssX")).alias("recorded_at"),
    )
    return parsed.where(F.col("recorded_at").isNotNull() & _on_earth(F.col("lat"), F.col("lon")))


def parse_gpx(files: DataFrame) -> DataFrame:
    """(file, value) documents to file, line, lat, lon, elevation_m, recorded_at, name.

    Points without a place, or without a time with its offset, are left out; name is the first that is not blank.
    """
    trk = F.from_xml("value", _GPX, {"mode": "PERMISSIVE", "ignoreNamespace": "true"})["trk"]
    docs = files.select("file", trk.alias("trk"))
    name = F.element_at(F.filter(F.transform("trk", lambda t: F.trim(t["name"])), lambda n: n != ""), 1)
    # A track without segments and a segment without points are null; one null would make all of flatten() null.
    some = lambda lists: F.flatten(F.filter(lists, lambda x: x.isNotNull()))
    segments = some(F.transform("trk", lambda t: some(F.transform(t["trkseg"], lambda s: s["trkpt"]))))
    name = F.when(F.exists("trk", lambda t: F.trim(t["name"]) != ""), name)
    rows = docs.select("file", name.alias("name"), F.posexplode(segments).alias("line", "p"))
    when = F.regexp_replace(F.upper(F.trim("p.time")), r"T(\d{2}:\d{2})(Z|[+-])", "T$1:00$2")  # seconds may be left out
    parsed = rows.select(
        "file", "line", F.col("p._lat").try_cast("double").alias("lat"), F.col("p._lon").try_cast("double").alias("lon"),
        F.col("p.ele").try_cast("double").alias("elevation_m"), F.when(when.rlike(OFFSET_TIME), when.try_cast("timestamp")).alias("recorded_at"), "name",
    )
    return parsed.where(F.col("recorded_at").isNotNull() & _on_earth(F.col("lat"), F.col("lon")))


def read_texts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Whole files below path as rows (file, value)."""
    reader = spark.read.option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


#: Parsers by format; register another to read one more format.
PARSERS = {"geolife": parse_plt, "gpx": parse_gpx}


def parse_any(files: DataFrame) -> DataFrame:
    """Points of all files whose format is known: file, format, name, line, lat, lon, elevation_m, recorded_at."""
    tagged = files.withColumn("format", sniff(F.col("value")))
    parts = [parse(tagged.where(F.col("format") == kind)).withColumn("format", F.lit(kind)) for kind, parse in PARSERS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select("file", "format", "name", "line", "lat", "lon", "elevation_m", "recorded_at")


def unreadable(files: DataFrame) -> DataFrame:
    """Files (file, format, reason) that give no point: of unknown format, or without a valid point."""
    tagged = files.select("file", sniff(F.col("value")).alias("format"))
    have = parse_any(files).select("file").distinct()
    reason = F.when(F.col("format") == "unknown", "unknown format").otherwise("no valid point")
    return tagged.join(have, "file", "left_anti").withColumn("reason", reason)
