"""Track files by spark.read.format, batch and stream, against the parsers on columns."""

import os

import pytest

from waymark.plans import queries as Q
from waymark.sources import track_format
from waymark.sources.files import parse_any, read_texts

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["format", "line", "lat", "lon", "elevation_m", "recorded_at"]


def rows_of(df):
    return sorted((os.path.basename(r.file), *[repr(r[c]) for c in COLUMNS]) for r in df.collect())


@pytest.fixture
def folder(spark, tmp_path):
    points = Q.virtual_points(spark, SMALL)
    for kind, files in (("plt", Q._plt_files(points)), ("gpx", Q._gpx_files(points))):
        (tmp_path / kind).mkdir()
        for r in files.collect():
            (tmp_path / kind / f"{r.file}.{kind}").write_text(r.value, newline="")
    (tmp_path / "odd.txt").write_text("nothing known")
    (tmp_path / "empty.gpx").write_text("")
    (tmp_path / "broken.gpx").write_text("<?xml version='1.0'?><gpx><trk>")
    (tmp_path / "_hidden.plt").write_text("x")
    return tmp_path


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no tables here")
def test_reads_what_the_parsers_read(spark, folder, monkeypatch):
    track_format.register(spark)
    want = rows_of(parse_any(read_texts(spark, str(folder))))
    assert len(want) > 1000
    assert rows_of(spark.read.format("tracks").load(str(folder))) == want
    assert rows_of(spark.read.format("tracks").load(f"file://{folder}")) == want
    one = spark.read.format("tracks").load(str(folder / "gpx" / "1.gpx"))
    assert rows_of(one) == [w for w in want if w[0] == "1.gpx"]
    sizes = [len(p.paths) for p in track_format._dealt(track_format._listed(str(folder)))]
    monkeypatch.setattr(track_format, "PART_BYTES", 10_000)
    assert len(track_format._dealt(track_format._listed(str(folder)))) > len(sizes) == 1


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no tables here")
def test_a_stream_reads_each_file_once(spark, folder, tmp_path):
    track_format.register(spark)
    out, at = str(tmp_path / "_out"), str(tmp_path / "_checkpoint")

    def run():
        q = spark.readStream.format("tracks").load(str(folder / "plt")).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return rows_of(spark.read.parquet(out))

    first = run()
    assert first == rows_of(spark.read.format("tracks").load(str(folder / "plt"))) and run() == first
    old = folder / "plt" / "0.plt"
    (folder / "plt" / "later.plt").write_text(old.read_text())
    assert len(run()) == len(first) + sum(r[0] == "0.plt" for r in first)


def test_files_are_put_in_place_by_tasks_and_dealt_by_number(spark, tmp_path, monkeypatch):
    texts = [(str(i), f"text {i} é") for i in range(40)] + [("a/b ..", ""), ("none", None)]
    track_format.write_files(spark.createDataFrame(texts, "file string, value string").repartition(5), f"file://{tmp_path}/out")
    found = {p.name: p.read_text("utf-8") for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == {f.replace("/", "%2F").replace(" ", "%20"): v or "" for f, v in texts}
    monkeypatch.setattr(track_format, "PART_FILES", 10)
    parts = track_format.TrackReader(str(tmp_path / "out")).partitions()
    assert [len(p.paths) for p in parts] == [10, 10, 10, 10, 2]
