"""Containment for many regions at once: an equality join of points with a grid index of polygons.

A region's grid is as fine as its box asks for: ACROSS to twice as many cells along its longer side, of a
width from a ladder of powers of two, so that regions of any size have a bounded number of cells. Edges are
clipped to the rows of the grid and to the cells that they pass. A cell that no edge passes lies wholly
within the region or outside it: inner cells answer without looking at an edge, outer ones are not
indexed. A cell on the border keeps the edges that pass it and those further east that a ray along its
row could miss; edges east of it that cross its whole row count as one crossing each, whatever the point.

Defined results: a point on an edge is inside, as in ``inside()``; rings count even-odd, so holes and
islands in holes need no order; points without a place and regions without rings match nothing; equal
region ids are told apart no further; empty tables give no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.regions import parse_region
from waymark.operators.storage import materialize
from waymark.operators.words import numbered, visits_of

#: Cells along the longer side of a region's box, at least.
ACROSS = 8
#: Degrees of the finest cell, and by what share of a cell edges are taken to be thicker than they are.
FINEST, THICK = 1e-4, 1e-6
#: Cells of places that are broadcast, at most.
MOST_BROADCAST = 500_000
#: Regions that a task checks, and regions that a task cuts into cells, about.
TASK_REGIONS, INDEX_REGIONS = 20_000, 4_000


def _width(level: Column) -> Column:
    return F.lit(FINEST) * F.pow(F.lit(2.0), level)


def _cells_of(points: DataFrame, levels: list[int], lon: str, lat: str) -> DataFrame:
    """Each point with its cell (_level, _cy, _cx) of each level."""
    at = points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels])))
    return at.withColumns({"_cy": F.floor(F.col(lat) / _width(F.col("_level"))), "_cx": F.floor(F.col(lon) / _width(F.col("_level")))})


def _met(rows: DataFrame, keys: DataFrame, most_broadcast: int = 200_000) -> DataFrame:
    """The rows whose keys are among the distinct ones given, which are broadcast if they are few."""
    few = keys.limit(most_broadcast + 1).count() <= most_broadcast
    return rows.join(F.broadcast(keys) if few else keys.hint("merge"), keys.columns, "left_semi")


def grid_index(regions: DataFrame, id_col: str = "region_id", rings_col: str = "rings", places: DataFrame | None = None) -> DataFrame:
    """(level, cy, cx, region_id, full, base, edges) of regions whose rings are array<array<struct<x double, y double>>>, closed.

    With places (lon, lat) only cells that hold one are indexed.
    """
    rings = regions.select(F.col(id_col).alias("region_id"), F.col(rings_col).alias("rings"))
    sides = F.flatten(F.transform("rings", lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(r) - 1)), lambda i: F.struct(F.get(r, i - 1)["x"].alias("ax"), F.get(r, i - 1)["y"].alias("ay"), F.get(r, i)["x"].alias("bx"), F.get(r, i)["y"].alias("by")))))
    # What follows groups by region in these tasks, whose work is not told by the bytes that they read.
    rings = rings.repartition(max(1, -(-rings.count() // INDEX_REGIONS)), "region_id")
    edges = rings.select("region_id", F.explode(sides).alias("e")).where("e.ax is not null and e.ay is not null and e.bx is not null and e.by is not null").select("region_id", "e.*")
    boxes = edges.groupBy("region_id").agg(F.greatest(F.max(F.greatest("ax", "bx")) - F.min(F.least("ax", "bx")), F.max(F.greatest("ay", "by")) - F.min(F.least("ay", "by"))).alias("span"))
    level = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.col("span"), F.lit(FINEST)) / F.lit(ACROSS * FINEST)))).cast("int")
    held = None
    if places is not None:
        levels = sorted(r.level for r in boxes.select(level.alias("level")).distinct().collect())  # a power of two each
        cells = _cells_of(places, levels or [0], "lon", "lat").select(F.col("_level").alias("level"), F.col("_cy").alias("cy"), F.col("_cx").alias("cx"))
        held = materialize(cells.distinct(), "held-cells")
    leveled = edges.join(boxes.select("region_id", level.alias("level")), "region_id").withColumn("c", _width(F.col("level")))
    thick = F.col("c") * THICK
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    rows = leveled.withColumn("cy", F.explode(F.sequence(F.floor((low - thick) / F.col("c")), F.floor((high + thick) / F.col("c")))))
    if held is not None:
        rows = _met(rows, held.select("level", "cy").distinct())
    south, north = F.col("cy") * F.col("c") - thick, (F.col("cy") + 1) * F.col("c") + thick

    def x_at(y: Column) -> Column:
        at = F.col("ax") + (F.col("bx") - F.col("ax")) * ((F.greatest(low, F.least(high, y)) - F.col("ay")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0)))
        return F.least(F.greatest("ax", "bx"), F.greatest(F.least("ax", "bx"), at))

    level_edge = F.col("ay") == F.col("by")
    west = F.when(level_edge, F.least("ax", "bx")).otherwise(F.least(x_at(south), x_at(north)))
    east = F.when(level_edge, F.greatest("ax", "bx")).otherwise(F.greatest(x_at(south), x_at(north)))
    middle = (F.col("cy") + 0.5) * F.col("c")
    passed = F.struct(
        F.floor((west - thick) / F.col("c")).alias("first"), F.floor((east + thick) / F.col("c")).alias("last"), ((low < south) & (high > north)).alias("spans"),
        ((F.col("ay") > middle) != (F.col("by") > middle)).alias("mid"), "ax", "ay", "bx", "by",
    )
    lines = rows.groupBy("region_id", "level", "cy").agg(F.collect_list(passed).alias("es"))
    cells = lines.withColumn("cx", F.explode(F.sequence(F.array_min(F.transform("es", lambda e: e["first"])), F.array_max(F.transform("es", lambda e: e["last"])))))
    if held is not None:
        cells = _met(cells, held)
    x = F.col("cx")
    border = F.exists("es", lambda e: (e["first"] <= x) & (e["last"] >= x))
    beyond = lambda e: e["spans"] & (e["first"] > x + 1)
    kept = F.transform(F.filter("es", lambda e: (e["last"] >= x) & ~beyond(e)), lambda e: F.struct(e["ax"].alias("ax"), e["ay"].alias("ay"), e["bx"].alias("bx"), e["by"].alias("by")))
    inner = F.size(F.filter("es", lambda e: (e["first"] > x) & e["mid"])) % 2 == 1
    out = cells.select("level", "cy", "cx", "region_id", border.alias("border"), inner.alias("inner"), F.when(border, F.size(F.filter("es", beyond)) % 2).alias("base"), F.when(border, kept).alias("edges"))
    return out.where("border or inner").select("level", "cy", "cx", "region_id", (~F.col("border")).alias("full"), "base", "edges")


def _holds(lon: Column, lat: Column) -> Column:
    """Whether a border cell's region holds a point of the cell."""
    cross = lambda e: (e["bx"] - e["ax"]) * (lat - e["ay"]) - (e["by"] - e["ay"]) * (lon - e["ax"])
    on = F.exists("_edges", lambda e: lon.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & lat.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])) & (cross(e) == 0))

    def crossed(e: Column) -> Column:
        return ((e["ay"] > lat) != (e["by"] > lat)) & (lon < (e["bx"] - e["ax"]) * (lat - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"])

    return on | ((F.size(F.filter("_edges", crossed)) + F.col("_base")) % 2 == 1)


def contained(points: DataFrame, regions: DataFrame, id_col: str = "region_id", rings_col: str = "rings", lon: str = "lon", lat: str = "lat", places: DataFrame | None = None) -> DataFrame:
    """The rows of points once for each region that holds them, with region_id added (in place of a column of that name).

    places: the points' distinct places (lon, lat) if these are known to be few, so that no cells beside them are indexed.
    """
    index = materialize(grid_index(regions, id_col, rings_col, places), "grid-index")
    levels = sorted(r.level for r in index.select("level").distinct().collect())  # a power of two each
    if not levels:
        return points.drop("region_id").select("*", F.lit(None).cast(regions.schema[id_col].dataType).alias("region_id")).limit(0)
    points = points.drop("region_id")
    at = _cells_of(points, levels, lon, lat)
    named = index.select("region_id", *[F.col(c).alias(f"_{c}") for c in ("level", "cy", "cx", "full", "base", "edges")])
    met = at.join(named, ["_level", "_cy", "_cx"]).where(F.col("_full") | _holds(F.col(lon), F.col(lat)))
    return met.select(*points.columns, "region_id")


#: Words of a row: eight times sixty-four tracks.
WIDE = 8


def _merged() -> list[Column]:
    return [*[F.bit_or(f"b{k}").alias(f"b{k}") for k in range(WIDE)], F.sum("n").alias("n")]


def by_place(points: DataFrame) -> DataFrame:
    """(lon, lat, word, b0 .. b7, n): at each place, 512 tracks a row as bits, and their n points there.

    Tracks are numbered in the order of their most western place, so that those of one way stand in few words.
    """
    visits = visits_of(points)
    met = visits.join(numbered(visits).hint("merge"), F.col("track_id").eqNullSafe(F.col("track")))
    bit = F.expr("shiftleft(1L, cast(number & 63 as int))")
    each = [F.coalesce(F.bit_or(F.when(F.shiftright("number", 6) % WIDE == k, bit)), F.lit(0).cast("long")).alias(f"b{k}") for k in range(WIDE)]
    return met.groupBy("lon", "lat", F.floor(F.col("number") / (64 * WIDE)).alias("word")).agg(*each, F.sum("n").alias("n"))


def shapes_of(regions: DataFrame, id_col: str = "region_id", rings_col: str = "rings") -> tuple[DataFrame, DataFrame]:
    """(region_id, rings) of one region of each shape, and (shape, region_id): which regions have the rings of region shape.

    Rings are alike if their digests are. Regions of one id are one region of all their rings.
    """
    rings = regions.select(F.col(id_col).alias("region_id"), F.col(rings_col).alias("rings")).where("region_id is not null and rings is not null")
    digest = F.sha2(F.to_json("rings"), 256)
    keyed = rings.groupBy("region_id").agg(F.unhex(F.sha2(F.array_join(F.sort_array(F.collect_list(digest)), ","), 256)).alias("key"))
    keyed = materialize(keyed, "region-shapes")
    first = keyed.groupBy("key").agg(F.min("region_id").alias("shape"))
    copies = materialize(keyed.join(first.hint("merge"), "key").select("shape", "region_id"), "region-copies")
    return _met(rings, copies.where("shape = region_id").select("region_id")), copies


def region_counts(points: DataFrame, regions: DataFrame, id_col: str = "region_id", rings_col: str = "rings") -> DataFrame:
    """(region_id, points, tracks) of the regions that hold a point.

    Regions of the same rings are counted once. They are joined with places, not with points, and with whole cells of
    places where these lie in them; the tracks of a place or of a cell come as words of bits. So rows follow the pairs of
    shapes and cells, and the words of these, not the pairs of regions and points.
    """
    seen = materialize(by_place(points.select("track_id", "lon", "lat")), "places")
    places = materialize(seen.select("lon", "lat").distinct(), "distinct-places")
    shapes, copies = shapes_of(regions, id_col, rings_col)
    index = materialize(grid_index(shapes, places=places), "grid-index")
    levels = sorted(r.level for r in index.select("level").distinct().collect())  # a power of two each
    at = ["level", "cy", "cx"]
    names = {"_level": "level", "_cy": "cy", "_cx": "cx"}
    of_cells = _cells_of(seen, levels or [0], "lon", "lat").withColumnsRenamed(names).groupBy(*at, "word").agg(*_merged())
    columns = ["region_id", "word", *[f"b{k}" for k in range(WIDE)], "n"]
    within = index.where("full").select("region_id", *at).join(of_cells.hint("merge"), at).select(*columns)
    border = index.where("not full").select("region_id", *[F.col(c).alias(f"_{c}") for c in (*at, "base", "edges")])
    spread = _cells_of(places, levels or [0], "lon", "lat")  # broadcast if few, so that no edges are shuffled
    spread = F.broadcast(spread) if spread.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else spread.hint("merge")
    on = border.join(spread, ["_level", "_cy", "_cx"]).where(_holds(F.col("lon"), F.col("lat"))).select("lon", "lat", "region_id")
    near = on.join(seen.hint("merge"), ["lon", "lat"]).select(*columns)
    words = within.unionByName(near).groupBy("region_id", "word").agg(*_merged())
    tracks = sum((F.bit_count(f"b{k}").cast("long") for k in range(WIDE)), F.lit(0).cast("long"))
    counts = words.groupBy(F.col("region_id").alias("shape")).agg(F.sum("n").alias("points"), F.sum(tracks).alias("tracks"))
    return copies.join(counts.hint("merge"), "shape").select("region_id", "points", "tracks")


def _fault_of(geometry: str | None) -> str | None:
    try:
        parse_region(geometry)
    except (ValueError, TypeError, AttributeError) as e:
        return str(e) or type(e).__name__
    return None


def validity(regions: DataFrame, id_col: str = "region_id", geometry_col: str = "geometry") -> DataFrame:
    """(region_id, valid, reason) of regions given as GeoJSON; null is invalid.

    Regions are dealt to tasks by number: a table of a few MB is read by one or two, but takes minutes to check.
    """

    @F.pandas_udf("string")
    def why(geometries: pd.Series) -> pd.Series:
        return geometries.map(_fault_of).astype(object)

    regions = regions.select(id_col, geometry_col).repartition(max(1, -(-regions.count() // TASK_REGIONS)))
    found = regions.select(F.col(id_col).alias("region_id"), why(F.col(geometry_col)).alias("reason"))
    return found.select("region_id", F.col("reason").isNull().alias("valid"), "reason")
