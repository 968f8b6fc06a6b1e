"""Stays of a stream against the stays of the same points at rest."""

import os
import random

import pytest
from pyspark.sql import functions as F

from waymark.operators.stays import stay_points
from waymark.sources.virtual import virtual_points
from waymark.streaming.stay_stream import stay_stream

SMALL = "/root/testdata/sf0.001"
POINTS = "track_id long, seq long, recorded_at timestamp, lon double, lat double"


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no tables here")
def test_stream_finds_the_stays_of_the_table(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    points = virtual_points(spark, SMALL).select("track_id", "seq", "recorded_at", "lon", "lat")
    want = sorted(map(tuple, stay_points(points).collect()))
    rows = sorted(points.collect(), key=lambda r: r.recorded_at)
    rng = random.Random(4)
    # In files by time, with points up to ten minutes late, shuffled within each file.
    rows.sort(key=lambda r: (r.recorded_at.timestamp() + rng.uniform(0, 600)))
    size = len(rows) // 3 + 1
    for k in range(3):
        part = rows[k * size : (k + 1) * size]
        rng.shuffle(part)
        spark.createDataFrame(part, POINTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    end = points.agg(F.max("recorded_at")).first()[0]
    spark.createDataFrame([(-1, 0, end, 0.0, 0.0)], POINTS).select("track_id", "seq", (F.col("recorded_at") + F.expr("interval 2 days")).alias("recorded_at"), "lon", "lat").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = stay_stream(stream, "20 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert len(want) > 5 and got == want
