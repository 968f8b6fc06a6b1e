"""Track similarity: how much of each of two tracks runs within a tolerance of the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import EARTH_M, geodesic, haversine, percent, utc_date
from waymark.functions.regions import check_limit, check_tolerance
from waymark.operators.cells import around, at_home, column_at, nested
from waymark.operators.storage import materialize
from waymark.operators.words import bits, count_pairs, numbered, visits_of, word


def near_points(points: DataFrame, baseline: int | None, tolerance_m: float, most_broadcast: int = 100_000) -> DataFrame:
    """(a_track, a_seq, b_track, b_seq): points of two tracks within tolerance_m, at any latitude.

    With a baseline, a is that track; otherwise a_track < b_track. The baseline looks into the nine
    cells around, and the distance decides. A baseline of up to most_broadcast points is broadcast.
    """
    check_tolerance(tolerance_m)
    slim = points.select("track_id", "seq", "lon", "lat")
    side = slim.where(F.col("track_id") == baseline) if baseline is not None else slim
    a = around(side.select(F.col("track_id").alias("a_track"), F.col("seq").alias("a_seq"), F.col("lon").alias("a_lon"), F.col("lat").alias("a_lat")), "a_lon", "a_lat", tolerance_m)
    b = at_home(slim.select(F.col("track_id").alias("b_track"), F.col("seq").alias("b_seq"), F.col("lon").alias("b_lon"), F.col("lat").alias("b_lat")), "b_lon", "b_lat", tolerance_m)
    if baseline is not None and side.limit(most_broadcast + 1).count() <= most_broadcast:
        a = F.broadcast(a)
    pair = F.col("a_track") != F.col("b_track") if baseline is not None else F.col("a_track") < F.col("b_track")
    near = haversine(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat")) <= tolerance_m
    return b.join(a, ["by", "bx"]).where(pair & near).select("a_track", "a_seq", "b_track", "b_seq")


def hits(near: DataFrame) -> DataFrame:
    """(a_track, b_track, a_hit, b_hit): distinct points of each side among the pairs of near_points()."""
    sides = near.select("a_track", "b_track", F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("a_seq").alias("q")), F.struct(F.lit(1).alias("s"), F.col("b_seq").alias("q")))).alias("x"))
    once = sides.select("a_track", "b_track", "x.s", "x.q").distinct()
    return once.groupBy("a_track", "b_track").agg(F.count_if(F.col("s") == 0).alias("a_hit"), F.count_if(F.col("s") == 1).alias("b_hit"))


#: How often cells may be cut in four, and products of points up to which they are compared one by one.
LEVELS, FEW = 12, 4_096
#: Places of all tracks are compared one by one up to this many times FEW: a comparison is made once, not once for each two tracks.
FEW_PLACES = 256
#: Bounds of distances closer than this share to the tolerance are left to the points themselves.
_CLOSE = 1e-9
#: By what share distances on the ellipsoid can differ from those on the sphere (0.56 percent at most).
_ELLIPSOID = 0.006
_BOX = ["n", "west", "east", "south", "north"]
#: Points that a task gathers into boxes, about: a task's memory does not follow the table.
TASK_POINTS = 200_000


def _boxes(cut: DataFrame, level: int) -> DataFrame:
    """(t, ry, rx, n, west, east, south, north): the points of a track in a cell of a level, and the box that they fill."""
    cell = [F.shiftright(c, LEVELS - level).alias(r) for c, r in (("fy", "ry"), ("fx", "rx"))]
    return cut.groupBy(F.col("track_id").alias("t"), *cell).agg(F.count(F.lit(1)).alias("n"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north"))


def _side(boxes: DataFrame, side: str) -> DataFrame:
    return boxes.select(*[F.col(c).alias(f"{side}_{c}") for c in boxes.columns])


def _bounds() -> tuple[Column, Column]:
    """The least and the largest distance that points of box x and of box y can have, on the sphere."""
    c = F.col

    def gap(low: str, high: str) -> tuple[Column, Column]:
        return F.greatest(F.lit(0.0), c(f"x_{low}") - c(f"y_{high}"), c(f"y_{low}") - c(f"x_{high}")), F.greatest(c(f"x_{high}") - c(f"y_{low}"), c(f"y_{high}") - c(f"x_{low}"))

    def cosines(side: str) -> tuple[Column, Column]:
        south, north = c(f"{side}_south"), c(f"{side}_north")
        nearest = F.when((south <= 0) & (north >= 0), 0.0).otherwise(F.least(F.abs(south), F.abs(north)))
        return F.cos(F.radians(F.greatest(F.abs(south), F.abs(north)))), F.cos(F.radians(nearest))

    (lat0, lat1), (lon0, lon1) = gap("south", "north"), gap("west", "east")
    (cx0, cx1), (cy0, cy1) = cosines("x"), cosines("y")

    def metres(lat: Column, lon: Column, cos: Column) -> Column:
        a = F.pow(F.sin(F.radians(lat) / 2), 2) + cos * F.pow(F.sin(F.radians(lon) / 2), 2)
        return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))

    return metres(lat0, lon0, cx0 * cy0), metres(lat1, lon1, cx1 * cy1)


def _around(boxes: DataFrame, tolerance_m: float) -> DataFrame:
    """A row for each cell (by, bx) in which points near those of a box lie."""
    rows = boxes.withColumn("by", F.explode(F.sequence(F.col("ry") - 1, F.col("ry") + 1)))
    reach = F.sequence(column_at(F.col("by"), F.col("west"), tolerance_m) - 1, column_at(F.col("by"), F.col("east"), tolerance_m) + 1)
    return rows.withColumn("bx", F.explode(reach))


def _in_reach(cut: DataFrame, baseline: int, tolerance_m: float, most_broadcast: int = 100_000) -> DataFrame:
    """The points of the baseline, and those of other tracks in the cells around it: no others can be near."""
    mine = _boxes(cut.where(F.col("track_id") == baseline), 0)
    cells = materialize(_around(mine, tolerance_m).select("by", "bx").distinct(), "baseline-cells")
    cells = F.broadcast(cells) if cells.limit(most_broadcast + 1).count() <= most_broadcast else cells.hint("merge")
    at = cut.withColumns({"by": F.shiftright("fy", LEVELS), "bx": F.shiftright("fx", LEVELS)})
    near = at.join(cells, ["by", "bx"], "left_semi").where(F.col("track_id") != baseline).drop("by", "bx")
    return near.unionByName(cut.where(F.col("track_id") == baseline))


def near_counts(points: DataFrame, baseline: int | None, tolerance_m: float, ellipsoid: bool = False) -> DataFrame:
    """(a_track, b_track, a_hit, b_hit): how many points of each of two tracks lie within tolerance_m of the other.

    With a baseline, a is that track; otherwise a_track < b_track, and places are compared for all tracks at
    once, see _all_pairs(). With a baseline tracks are compared cell by cell: of two
    cells in reach the boxes that the tracks' points fill tell whether all points of one are near the other,
    none, or some. Where one box of the other track is near throughout, the cell's points all count and are
    looked at no further; where it stays open, points are compared one by one if they are few, else
    the cells are cut in four and their boxes compared again. So a crowded cell costs rows for the pairs of
    tracks in it, not for the pairs of their points. Distances are those on the sphere or, if asked, on
    the ellipsoid. Numbers of a track's points are distinct;
    points without a place are near nothing.
    """
    check_tolerance(tolerance_m)
    if baseline is None:
        return _all_pairs(points, tolerance_m, ellipsoid).drop("a_n", "b_n")
    metres, unsure = (geodesic, _ELLIPSOID) if ellipsoid else (haversine, _CLOSE)
    slim = points.select("track_id", "seq", "lon", "lat").where("lon is not null and lat is not null")
    cut = materialize(_in_reach(nested(slim, "lon", "lat", tolerance_m, LEVELS), baseline, tolerance_m), "cut-points")
    # Written points are small on disk, so that few tasks would read them; and by its size on disk no table tells
    # whether it fits the driver: joins of tables that grow with the points are merge joins.
    cut = cut.repartition(max(1, -(-cut.count() // TASK_POINTS)), "track_id")
    boxes = _boxes(cut, 0)
    around_mine = _side(_around(boxes.where(F.col("t") == baseline), tolerance_m), "x").withColumnsRenamed({"x_by": "y_ry", "x_bx": "y_rx"})
    pairs = around_mine.join(_side(boxes, "y").hint("merge"), ["y_ry", "y_rx"]).where("x_t != y_t")
    turned = F.struct(*[F.col(("y" if c[0] == "x" else "x") + c[1:]).alias(c) for c in pairs.columns])
    pairs = pairs.select(F.explode(F.array(F.struct(*pairs.columns), turned)).alias("p")).select("p.*")
    cell = ["x_t", "x_ry", "x_rx", "y_t"]
    found = None
    for level in range(LEVELS + 1):
        low, high = _bounds()
        told = pairs.withColumn("all", high <= tolerance_m * (1 - unsure)).withColumn("none", low > tolerance_m * (1 + unsure)).where("not none").drop("none")
        told = materialize(told, "box-pairs")
        by_cell = told.groupBy(*cell).agg(F.bool_or("all").alias("any"), F.first("x_n").alias("n"), (F.first("x_n") * F.sum("y_n")).alias("work"))
        by_cell = materialize(by_cell, "cells")
        whole = by_cell.where("any").select("x_t", "y_t", "n")
        left = told.join(by_cell.where("not any").select(*cell, "work").hint("merge"), cell)
        last = level == LEVELS
        here = cut.select("track_id", "seq", "lon", "lat", *[F.shiftright(c, LEVELS - level).alias(r) for c, r in (("fy", "ry"), ("fx", "rx"))])
        sides = [here.select(*[F.col(c).alias(f"{s}_{n}") for c, n in (("track_id", "t"), ("ry", "ry"), ("rx", "rx"), ("seq", "seq"), ("lon", "lon"), ("lat", "lat"))]) for s in "xy"]
        keys = ["x_t", "x_ry", "x_rx", "y_t", "y_ry", "y_rx"]
        few = left.where(F.lit(last) | (F.col("work") <= FEW)).select(*keys)
        close = few.join(sides[0].hint("merge"), keys[:3]).join(sides[1].hint("merge"), keys[3:]).where(metres(F.col("x_lon"), F.col("x_lat"), F.col("y_lon"), F.col("y_lat")) <= tolerance_m)
        some = close.select("x_t", "x_seq", "y_t").distinct().groupBy("x_t", "y_t").agg(F.count(F.lit(1)).alias("n"))
        counted = whole.unionByName(some)
        found = counted if found is None else found.unionByName(counted)
        many = left.where(F.col("work") > FEW)
        if last or not many.take(1):
            break
        finer = _boxes(cut, level + 1)
        kept = [many.select(*keys)]
        for s in "xy":
            child = _side(finer, s).withColumns({f"{s}_cy": F.shiftright(f"{s}_ry", 1), f"{s}_cx": F.shiftright(f"{s}_rx", 1)})
            above = kept[0].withColumnsRenamed({f"{s}_ry": f"{s}_cy", f"{s}_rx": f"{s}_cx"})
            kept = [above.join(child.hint("merge"), [f"{s}_t", f"{s}_cy", f"{s}_cx"]).drop(f"{s}_cy", f"{s}_cx")]
        pairs = kept[0]
    first = F.col("x_t") == baseline
    named = found.select(F.when(first, F.col("x_t")).otherwise(F.col("y_t")).alias("a_track"), F.when(first, F.col("y_t")).otherwise(F.col("x_t")).alias("b_track"), first.alias("first"), "n")
    hit = lambda side: F.coalesce(F.sum(F.when(side, F.col("n"))), F.lit(0).cast("long"))
    return named.groupBy("a_track", "b_track").agg(hit(F.col("first")).alias("a_hit"), hit(~F.col("first")).alias("b_hit"))


def _near_words(cut: DataFrame, stops: DataFrame, tolerance_m: float, ellipsoid: bool) -> DataFrame:
    """(place, word, bits): the tracks that come within tolerance_m of a place.

    cut: (place, lon, lat, fy, fx); stops: (place, word, bits). Of two cells in reach the boxes that their places fill tell
    whether all places of one are near the other, none, or some. All: the words of the one go to the places of the other. Some:
    places are compared one by one if they are few, else the cells are cut in four.
    """
    metres, unsure = (geodesic, _ELLIPSOID) if ellipsoid else (haversine, _CLOSE)
    boxes = _boxes(cut, 0).drop("t")
    pairs = _side(_around(boxes, tolerance_m), "x").withColumnsRenamed({"x_by": "y_ry", "x_bx": "y_rx"}).join(_side(boxes, "y").hint("merge"), ["y_ry", "y_rx"])
    keys, found = ["x_ry", "x_rx", "y_ry", "y_rx"], None
    for level in range(LEVELS + 1):
        low, high = _bounds()
        told = pairs.withColumn("all", high <= tolerance_m * (1 - unsure)).withColumn("none", low > tolerance_m * (1 + unsure)).where("not none").drop("none")
        told = materialize(told, "box-pairs")
        here = cut.select("place", "lon", "lat", *[F.shiftright(c, LEVELS - level).alias(r) for c, r in (("fy", "ry"), ("fx", "rx"))])
        sides = [here.select(*[F.col(c).alias(f"{s}_{c}") for c in here.columns]) for s in "xy"]
        of_cells = stops.join(sides[1].hint("merge"), stops["place"] == sides[1]["y_place"]).groupBy("y_ry", "y_rx", "word").agg(F.bit_or("bits").alias("bits"))
        whole = told.where("all").select(*keys).join(of_cells.hint("merge"), keys[2:]).groupBy("x_ry", "x_rx", "word").agg(F.bit_or("bits").alias("bits"))
        last = level == LEVELS
        work = F.col("x_n") * F.col("y_n") > FEW * FEW_PLACES
        few = told.where(~F.col("all") & (F.lit(last) | ~work)).select(*keys)
        close = few.join(sides[0].hint("merge"), keys[:2]).join(sides[1].hint("merge"), keys[2:]).where(metres(F.col("x_lon"), F.col("x_lat"), F.col("y_lon"), F.col("y_lat")) <= tolerance_m)
        some = close.select("x_place", F.col("y_place").alias("place")).join(stops.hint("merge"), "place").select(F.col("x_place").alias("place"), "word", "bits")
        one = whole.join(sides[0].hint("merge"), keys[:2]).select(F.col("x_place").alias("place"), "word", "bits").unionByName(some)
        found = one if found is None else found.unionByName(one)
        many = told.where(~F.col("all") & work)
        if last or not many.take(1):
            break
        finer, pairs = _boxes(cut, level + 1).drop("t"), many.select(*keys)
        for s in "xy":
            child = _side(finer, s).withColumns({f"{s}_cy": F.shiftright(f"{s}_ry", 1), f"{s}_cx": F.shiftright(f"{s}_rx", 1)})
            above = pairs.withColumnsRenamed({f"{s}_ry": f"{s}_cy", f"{s}_rx": f"{s}_cx"})
            pairs = above.join(child.hint("merge"), [f"{s}_cy", f"{s}_cx"]).drop(f"{s}_cy", f"{s}_cx")
    return materialize(found.groupBy("place", "word").agg(F.bit_or("bits").alias("bits")), "near-words")


def _totals(points: DataFrame) -> DataFrame:
    return points.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))


def _all_pairs(points: DataFrame, tolerance_m: float, ellipsoid: bool) -> DataFrame:
    """near_counts() of all pairs, with the numbers of the tracks' points a_n and b_n.

    Distinct places are compared once for all tracks at them, tracks are bits of words, and pairs of words are counted
    by tables of 64 by 64: rows follow the places and the pairs of words, only the result follows the pairs of tracks.
    """
    visits = visits_of(points.where("track_id is not null"))
    numbers = numbered(visits)
    # Negative zero is the place of zero, so that no place is taken for two.
    places = visits.select((F.col("lon") + 0.0).alias("lon"), (F.col("lat") + 0.0).alias("lat")).distinct()
    cut = nested(places.withColumn("place", F.monotonically_increasing_id()), "lon", "lat", tolerance_m, LEVELS).withColumn("track_id", F.lit(0))
    cut = materialize(cut, "cut-places")
    cut = cut.repartition(max(1, -(-cut.count() // TASK_POINTS)), "place")
    placed = visits.join(cut.select("place", "lon", "lat").hint("merge"), ["lon", "lat"]).join(numbers.hint("merge"), F.col("track_id") == F.col("track"))
    # A number of points is a sum of powers of two, each a row of its own.
    powers = F.filter(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)), lambda w: F.col("n").bitwiseAND(w) != 0)
    stops = placed.select("place", "number", F.explode(powers).alias("weight")).groupBy("place", word().alias("word"), "weight").agg(bits().alias("bits"))
    stops = materialize(stops, "stops")
    near = _near_words(cut, stops.groupBy("place", "word").agg(F.bit_or("bits").alias("bits")), tolerance_m, ellipsoid)
    totals = _totals(points).join(numbers.hint("merge"), F.col("track_id") == F.col("track"))
    seats = totals.groupBy(word().alias("word")).agg(F.collect_list(F.struct((F.col("number") % 64).cast("int").alias("k"), "track", "n")).alias("all"))
    seat = lambda name: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.coalesce(F.get(F.filter("all", lambda s: s["k"] == k), F.lit(0))[name], F.lit(-1)))
    names = materialize(seats.select("word", seat("track").alias("ids"), seat("n").alias("ns")), "word-names")
    return count_pairs(stops, near, names)


def scores(points: DataFrame, baseline: int | None, tolerance_m: float = 50.0, ellipsoid: bool = False) -> DataFrame:
    """(a_track, b_track, a_hit, b_hit, forward, reverse, similarity): percents to one decimal, similarity the smaller."""
    if baseline is None:
        both = _all_pairs(points, tolerance_m, ellipsoid)
    else:
        totals = _totals(points)
        a, b = totals.select(F.col("track_id").alias("a_track"), F.col("n").alias("a_n")), totals.select(F.col("track_id").alias("b_track"), F.col("n").alias("b_n"))
        both = near_counts(points, baseline, tolerance_m, ellipsoid).join(a.hint("merge"), "a_track").join(b.hint("merge"), "b_track")
    both = both.withColumns({"forward": percent(F.col("a_hit"), F.col("a_n")), "reverse": percent(F.col("b_hit"), F.col("b_n"))})
    return both.select("a_track", "b_track", "a_hit", "b_hit", "forward", "reverse", F.least("forward", "reverse").alias("similarity"))


def compared(found: DataFrame) -> DataFrame:
    """One row (compared): how many tracks were compared, which is how many have a point near the baseline."""
    return found.agg(F.count(F.lit(1)).alias("compared"))


def at_least(found: DataFrame, least: float) -> DataFrame:
    """Matches of at least this similarity in percent; 0 and less keep all."""
    return found if least <= 0 else found.where(F.col("similarity") >= least)


def most_similar(points: DataFrame, tracks: DataFrame, baseline: int, tolerance_m: float = 50.0, limit: int = 20) -> DataFrame:
    """The tracks most like a baseline, with name, source, length and days apart; tracks: track_id, name, source, start_time, distance_m.

    compared tells, in each row, how many tracks come near the baseline at all.
    """
    check_limit(limit)
    meta = tracks.select("track_id", "name", "source", "start_time", "distance_m")
    base = meta.where(F.col("track_id") == baseline).select(utc_date(F.col("start_time")).alias("base_day"))
    found = scores(points, baseline, tolerance_m)
    base = compared(found).join(base, how="left")  # one row
    best = found.orderBy(F.desc("similarity"), "b_track").limit(limit)
    out = best.join(meta, best["b_track"] == meta["track_id"], "left").join(F.broadcast(base), how="left")
    days = F.coalesce(F.abs(F.datediff(utc_date(F.col("start_time")), "base_day")), F.lit(0))
    name = F.coalesce("name", F.concat(F.lit("track-"), F.col("b_track").cast("string")))
    return out.select(F.col("b_track").alias("track_id"), name.alias("name"), "source", "distance_m", "forward", "reverse", "similarity", days.alias("days_away"), "compared")
