"""Tracks as bits of words: sixty-four tracks of one way a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.storage import materialize

#: Tracks that a task numbers, pairs of words that a task counts, about.
TASK_TRACKS, TASK_WORDS = 200_000, 500
PAIRS = "a_track long, b_track long, a_hit long, b_hit long, a_n long, b_n long"


def visits_of(points: DataFrame) -> DataFrame:
    """(track_id, lon, lat, n): the distinct places of each track, and its points there."""
    visits = points.where("lon is not null and lat is not null").groupBy("track_id", "lon", "lat").agg(F.count(F.lit(1)).alias("n"))
    return materialize(visits, "visits")


def numbered(visits: DataFrame) -> DataFrame:
    """(track, number): tracks numbered in the order of their most western place, so that those of one way stand in few words."""
    first = visits.groupBy("track_id").agg(F.min(F.struct("lon", "lat")).alias("at"))
    first = first.repartitionByRange(max(1, -(-first.count() // TASK_TRACKS)), "at", "track_id").sortWithinPartitions("at", "track_id")
    return materialize(first.select(F.col("track_id").alias("track"), F.monotonically_increasing_id().alias("number")), "track-numbers")


def word() -> Column:
    return F.shiftright("number", 6)


def bits() -> Column:
    """The bits of the tracks of a group in their word."""
    return F.bit_or(F.expr("shiftleft(1L, cast(number & 63 as int))"))


def _unpacked(words: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.unpackbits(words.to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)


def _named(head: dict, met: np.ndarray, turned: np.ndarray) -> pa.RecordBatch:
    """The rows of PAIRS of two words: met and turned hold how many points of a track of the one come near each of the other."""
    if head["x"] == head["y"]:
        met, turned = np.triu(met, 1), np.triu(met.T, 1)
    i, j = np.nonzero((met > 0) | (turned > 0))
    x, y, xn, yn = (np.array(head[c], dtype=np.int64) for c in ("x_ids", "y_ids", "x_ns", "y_ns"))
    first = x[i] < y[j]
    ab = [(x[i], y[j]), (met[i, j].astype(np.int64), turned[i, j].astype(np.int64)), (xn[i], yn[j])]
    return pa.record_batch([np.where(first, *(v if k == 0 else v[::-1])) for v in ab for k in (0, 1)], names=[c.split()[0] for c in PAIRS.split(", ")])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the tracks of pairs of words from rows in the order of the pairs, a row with the names first in each."""
    head, met, turned = None, np.zeros((64, 64)), np.zeros((64, 64))
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = batch.column("x").to_numpy(), batch.column("y").to_numpy()
        back, weight = batch.column("turned").to_numpy(zero_copy_only=False), batch.column("weight").to_numpy()
        mine, theirs = _unpacked(batch.column("mine")) * weight[:, None], _unpacked(batch.column("theirs"))
        cuts = np.nonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1]))[0] + 1
        for a, b in zip([0, *cuts], [*cuts, len(x)], strict=True):
            if head is None or (head["x"], head["y"]) != (x[a], y[a]):
                if head is not None:
                    yield _named(head, met, turned)
                head = batch.slice(a, 1).to_pylist()[0]  # the row with the names, whose weight is 0
                met, turned = np.zeros((64, 64)), np.zeros((64, 64))
            turn = back[a:b]
            met += mine[a:b][~turn].T @ theirs[a:b][~turn]
            turned += theirs[a:b][turn].T @ mine[a:b][turn]
    if head is not None:
        yield _named(head, met, turned)


def count_pairs(stops: DataFrame, near: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of PAIRS for each two tracks that come near each other, a_track < b_track.

    stops: (place, word, weight, bits), the tracks that have so many points more at a place; near: (place, word, bits), the tracks that
    come near it; names: (word, ids, ns), sixty-four tracks and their numbers of points in the order of their bits. Places are
    joined once for all tracks of two words, and a task counts word by word: it holds two tables of 64 by 64 numbers.
    """
    a = stops.select("place", F.col("word").alias("a"), "weight", F.col("bits").alias("mine"))
    b = near.select("place", F.col("word").alias("b"), F.col("bits").alias("theirs"))
    met = a.join(b.hint("merge"), "place").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), (F.col("a") > F.col("b")).alias("turned"), "weight", "mine", "theirs")
    words = materialize(a.select("place", "a").distinct().join(b.select("place", "b").hint("merge"), "place").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct(), "word-pairs")
    side = lambda s: names.select(F.col("word").alias(s), F.col("ids").alias(f"{s}_ids"), F.col("ns").alias(f"{s}_ns")).hint("merge")
    heads = words.join(side("x"), "x").join(side("y"), "y").select("x", "y", F.lit(False).alias("turned"), F.lit(0).cast("long").alias("weight"), F.lit(0).cast("long").alias("mine"), F.lit(0).cast("long").alias("theirs"), "x_ids", "x_ns", "y_ids", "y_ns")
    rows = heads.unionByName(met, allowMissingColumns=True).repartition(max(1, -(-words.count() // TASK_WORDS)), "x", "y")
    return rows.sortWithinPartitions("x", "y", F.col("x_ids").isNull()).mapInArrow(_counted, PAIRS)
