"""Track files as a Spark data source: ``spark.read.format("tracks").load(path)``, and the same for streams.

A partition holds files of about PART_BYTES together, PART_FILES at most; the task that reads it opens them through Arrow's file
systems, sniffs each one's format and gives a row a point. A stream's offset is the time of the latest file
that was seen and the files of that very time; each batch reads the files that came after it.

Rows: file, format, line, lat, lon, elevation_m, recorded_at (an instant). What is skipped is what the parsers
in ``files`` skip: rows off the earth or without a number, points without a time that names an
instant, files of unknown format.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote
from zlib import crc32

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from waymark.sources.files import FEET_M, HEAD_BYTES, OFFSET_TIME, SCAN_LINES

SCHEMA = "file string, format string, line int, lat double, lon double, elevation_m double, recorded_at timestamp"
#: Bytes of files that a task reads, about.
PART_BYTES = 64 << 20
#: Files that a task reads at most, for opening a small file takes longer than reading it; folders that files are written to.
PART_FILES, FOLDERS = 2_000, 1_000
_NUMBER = re.compile(r"\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*")
_DATE, _TIME = re.compile(r"\d{4}-\d{1,2}-\d{1,2}"), re.compile(r"\d{1,2}:\d{2}:\d{2}")


def _number(text: str | None) -> float | None:
    return float(text) if text is not None and _NUMBER.fullmatch(text) else None


def _on_earth(lat: float | None, lon: float | None) -> bool:
    return lat is not None and lon is not None and -90 <= lat <= 90 and -180 <= lon <= 180


def format_of(text: str) -> str:
    """gpx, geolife or unknown, from a file's first bytes."""
    head = text[:HEAD_BYTES].strip()
    if head.startswith("<?xml") or "<gpx" in head:
        return "gpx"
    lines = [x for x in map(str.strip, head.splitlines()) if x][:SCAN_LINES]
    rows = [f for f in (line.split(",") for line in lines) if len(f) == 7]
    known = any(all(_NUMBER.fullmatch(f[i]) for i in (0, 1, 3)) and _DATE.fullmatch(f[5].strip()) and _TIME.fullmatch(f[6].strip()) for f in rows)
    return "geolife" if known else "unknown"


def plt_points(text: str) -> Iterator[tuple]:
    for line, row in enumerate(text.splitlines()):
        f = [x.strip() for x in row.split(",")]
        if len(f) < 7:
            continue
        lat, lon, feet = _number(f[0]), _number(f[1]), _number(f[3])
        try:
            when = datetime.strptime(f"{f[5]} {f[6]}", "%Y-%m-%d %H:%M:%S").replace(tzinfo=UTC)
        except ValueError:
            continue
        if _on_earth(lat, lon):
            yield line, lat, lon, None if feet is None else feet * FEET_M, when


def gpx_points(text: str) -> Iterator[tuple]:
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return
    named = lambda node, tag: (x for x in node if x.tag.rpartition("}")[2] == tag)
    points = (p for trk in named(root, "trk") for segment in named(trk, "trkseg") for p in named(segment, "trkpt"))
    for line, p in enumerate(points):
        lat, lon = _number(p.get("lat")), _number(p.get("lon"))
        text_of = {tag: next((x.text for x in named(p, tag)), None) for tag in ("ele", "time")}
        when = re.sub(r"T(\d{2}:\d{2})(Z|[+-])", r"T\1:00\2", (text_of["time"] or "").strip().upper())
        if _on_earth(lat, lon) and re.fullmatch(OFFSET_TIME, when):
            yield line, lat, lon, _number(text_of["ele"]), datetime.fromisoformat(when).astimezone(UTC)


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(None)
        self.paths = paths


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_files(files: DataFrame, path: str) -> None:
    """Write rows (file, value), of distinct names, as a file each in FOLDERS folders below path.

    Tasks put their files in place themselves, so the driver renames none; a file that is written again is the same.
    """

    def write(rows: Iterator[Row]) -> None:
        system, root = _located(path)
        made = set()
        for r in rows:
            folder = f"{root}/{crc32(r.file.encode()) % FOLDERS}"
            if folder not in made:
                system.create_dir(folder)
                made.add(folder)
            name = quote(r.file, safe="")
            draft = f"{folder}/.{name}-{TaskContext.get().taskAttemptId()}"
            with system.open_output_stream(draft) as stream:
                stream.write((r.value or "").encode())
            system.move(draft, f"{folder}/{name}")

    _located(path)[0].create_dir(_located(path)[1])
    files.select("file", "value").foreachPartition(write)


def _listed(path: str) -> list[fs.FileInfo]:
    system, root = _located(path)
    info = system.get_file_info(root)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)


def _dealt(files: list[fs.FileInfo]) -> list[Files]:
    parts, held, size = [], [], 0
    for f in files:
        if held and (size + f.size > PART_BYTES or len(held) == PART_FILES):
            parts.append(Files(held))
            held, size = [], 0
        held.append(f.path)
        size += f.size
    return [*parts, Files(held)] if held else parts


def _rows(scheme: str, part: Files) -> Iterator[tuple]:
    for path in part.paths:
        system = fs.FileSystem.from_uri(scheme + path)[0] if scheme else fs.LocalFileSystem()
        with system.open_input_stream(path) as stream:
            text = stream.read().decode("utf-8", "replace")
        kind = format_of(text)
        points = {"gpx": gpx_points, "geolife": plt_points}.get(kind)
        for line, *place in points(text) if points else ():
            yield (path, kind, line, *place)


def _scheme(path: str) -> str:
    """What stands before the paths of a file system other than the local one."""
    return "" if "://" not in path or path.startswith("file:") else re.match(r"\w+://[^/]*", path)[0]


class TrackReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Files]:
        return _dealt(_listed(self.path))

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(_scheme(self.path), partition)


class TrackStream(DataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {"ns": -1, "seen": []}

    def latestOffset(self) -> dict:
        files = _listed(self.path)
        latest = max((f.mtime_ns for f in files), default=-1)
        return {"ns": latest, "seen": [f.path for f in files if f.mtime_ns == latest]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        def came(f: fs.FileInfo) -> bool:
            after = f.mtime_ns > start["ns"] or (f.mtime_ns == start["ns"] and f.path not in start["seen"])
            return after and (f.mtime_ns < end["ns"] or (f.mtime_ns == end["ns"] and f.path in end["seen"]))

        return _dealt([f for f in _listed(self.path) if came(f)])

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(_scheme(self.path), partition)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class TrackSource(DataSource):
    """PLT and GPX files below a path."""

    @classmethod
    def name(cls) -> str:
        return "tracks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> TrackReader:
        return TrackReader(self.options["path"])

    def streamReader(self, schema: object) -> TrackStream:
        return TrackStream(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TrackSource)
