"""Stay points of a stream of points: one state a track, closed by event time.

A track's state holds its points whose run may still grow. A run ends where a gap is longer than
max_gap_s; once the watermark has passed a run's last point by that much no point can join it any more,
so a timer at that time takes the run out of the state and gives its stays. Points may come in any order
within the watermark's delay; later ones are dropped, as everywhere in Spark. The stays are those that
``stay_points()`` finds in the same points at rest, each given once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from waymark.operators.stays import DIAMETER_M, FOUND, MAX_GAP_S, MIN_STAY_S, stays_of_run

_COLUMNS = [c.split()[0] for c in FOUND.split(", ")]


class StayProcessor(StatefulProcessor):
    def __init__(self, diameter_m: float, min_stay_s: int, max_gap_s: int) -> None:
        self.diameter_m, self.min_stay_s, self.max_gap_s = diameter_m, min_stay_s, max_gap_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.points = handle.getListState("points", "ms long, seq long, lon double, lat double")

    def _wait(self, last_ms: int) -> None:
        """Ask for a call once no point within max_gap_s of last_ms can come."""
        self.handle.registerTimer(last_ms + (self.max_gap_s + 1) * 1000)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in rows:
            if len(pdf):
                self.points.appendList(list(zip(pdf["ms"].tolist(), pdf["seq"].tolist(), pdf["lon"].tolist(), pdf["lat"].tolist(), strict=True)))
                last = max(int(pdf["ms"].max()), last if last is not None else int(pdf["ms"].max()))
        if last is not None:
            self._wait(last)
        yield pd.DataFrame(columns=_COLUMNS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        final = timerValues.getCurrentWatermarkInMs()
        held = sorted(self.points.get(), key=lambda p: (p[1], p[0]))
        found: list[tuple] = []
        rest: list[tuple] = []
        if held:
            ms = np.array([p[0] for p in held])
            cuts = [0, *(np.nonzero(np.diff(ms) // 1000 > self.max_gap_s)[0] + 1).tolist(), len(held)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                run = held[a:b]
                # The gap to the next run may still be filled while points of its time can come.
                if run[-1][0] + (self.max_gap_s + 1) * 1000 <= final:
                    columns = [np.array([p[k] for p in run]) for k in range(4)]
                    found += stays_of_run(key[0], *columns, self.diameter_m, self.min_stay_s)
                else:
                    rest += run
        self.points.clear()
        if rest:
            self.points.appendList(rest)
            self._wait(max(p[0] for p in rest))
        yield pd.DataFrame(found, columns=_COLUMNS)

    def close(self) -> None:
        """Nothing is held outside the state."""


def stay_stream(points: DataFrame, delay: str = "10 minutes", diameter_m: float = DIAMETER_M, min_stay_s: int = MIN_STAY_S, max_gap_s: int = MAX_GAP_S) -> DataFrame:
    """The stays of a stream (track_id, seq, recorded_at, lon, lat), for append mode and the RocksDB state store."""
    slim = points.withWatermark("recorded_at", delay).select("track_id", "seq", "recorded_at", F.unix_millis("recorded_at").alias("ms"), "lon", "lat")
    processor = StayProcessor(diameter_m, min_stay_s, max_gap_s)
    found = slim.groupBy("track_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=FOUND, outputMode="Append", timeMode="EventTime")
    return found.select(*[F.timestamp_millis(c).alias(c) if c.endswith("_time") else c for c in _COLUMNS])
