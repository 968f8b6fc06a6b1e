"""Points laid out in files by place, so that a search by box opens few of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.regions import Bbox
from waymark.operators.density import in_box

#: Halvings of each axis in a place's key (about 2.4 m by 1.2 m at the equator) and in its folder (1.4 by 0.7 degrees).
BITS, FOLDER_BITS = 24, 8
#: Key ranges that a box is covered by at most.
MOST_RANGES = 64
#: Shifts and masks that part the bits of a number of 24 bits.
_PARTED = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _steps(degrees: Column, span: float) -> Column:
    step = F.floor((degrees + span / 2) / span * (1 << BITS)).cast("long")
    return F.least(F.greatest(step, F.lit(0)), F.lit((1 << BITS) - 1))


def _parted(step: Column) -> Column:
    return reduce(lambda v, by: v.bitwiseOR(F.shiftleft(v, by[0])).bitwiseAND(F.lit(by[1])), _PARTED, step)


def place_key(lon: Column, lat: Column) -> Column:
    """A place's key along a space-filling curve: the bits of its steps east and north in turn. Null for null."""
    return F.shiftleft(_parted(_steps(lat, 180.0)), 1).bitwiseOR(_parted(_steps(lon, 360.0)))


def key_ranges(box: Bbox, most: int = MOST_RANGES, bits: int = BITS) -> list[tuple[int, int]]:
    """Ranges of keys, both ends included, that hold all places of a box; in order, apart, at most so many.

    Squares that the box meets are cut in four, all of one size together, as long as there are few enough.
    """

    def step(degrees: float, span: float) -> int:
        return min(max(int((degrees + span / 2) / span * (1 << bits)), 0), (1 << bits) - 1)

    # A step more on each side, so that rounding differs nowhere from what place_key() does.
    w, e = step(box.west, 360.0) - 1, step(box.east, 360.0) + 1
    s, n = step(box.south, 180.0) - 1, step(box.north, 180.0) + 1
    squares, whole, depth = [(0, 0, 0)], [], 0  # key, east, north in squares of the present size
    while squares and depth < bits:
        side = 1 << (bits - depth - 1)
        cut = [(4 * k + 2 * j + i, 2 * x + i, 2 * y + j) for k, x, y in squares for j in (0, 1) for i in (0, 1)]
        cut = [(k, x, y) for k, x, y in cut if x * side <= e and (x + 1) * side > w and y * side <= n and (y + 1) * side > s]
        if len(whole) + len(cut) > most:
            break
        depth, squares = depth + 1, []
        for k, x, y in cut:
            if x * side >= w and (x + 1) * side - 1 <= e and y * side >= s and (y + 1) * side - 1 <= n:
                whole.append((k * side * side, (k + 1) * side * side - 1))
            else:
                squares.append((k, x, y))
    size = 1 << 2 * (bits - depth)
    left = [(k * size, (k + 1) * size - 1) for k, _, _ in squares]
    out: list[tuple[int, int]] = []
    for low, high in sorted(whole + left):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def write_by_place(points: DataFrame, path: str, rows_per_file: int = 4_000_000, then: tuple[str, ...] = ("recorded_at",)) -> None:
    """Write points (lon, lat, ...) as Parquet in folders of a square each, in the order of their keys.

    Files are ranges of keys of about rows_per_file points, so a crowded square is cut in many files and
    their row groups hold narrow boxes; the columns of then cut a crowded place. Points without a place
    get a folder of their own. The columns place_key and folder are added.
    """
    keyed = points.withColumn("place_key", place_key(F.col("lon"), F.col("lat")))
    keyed = keyed.withColumn("folder", F.shiftright("place_key", 2 * (BITS - FOLDER_BITS)).cast("int"))
    files = max(1, -(-points.count() // rows_per_file))
    order = ["folder", "place_key", *then]
    keyed.repartitionByRange(files, *order).sortWithinPartitions(*order).write.partitionBy("folder").parquet(path)


def read_box(spark: SparkSession, path: str, box: Bbox) -> DataFrame:
    """The points of a box, borders included, with the columns they were written with.

    Folders are chosen before the scan, row groups by the box and by ranges of keys; what the ranges
    hold beyond the box is taken out by the exact comparison.
    """
    ranges = key_ranges(box)
    shift = 2 * (BITS - FOLDER_BITS)
    folders = reduce(Column.__or__, [F.col("folder").between(low >> shift, high >> shift) for low, high in ranges])
    keys = reduce(Column.__or__, [F.col("place_key").between(low, high) for low, high in ranges])
    return in_box(spark.read.parquet(path).where(folders).where(keys), box).drop("place_key", "folder")
