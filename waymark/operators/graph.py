"""Connected components by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.storage import materialize


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """Connected components of edges (u long, v long): rows (node, root), root the smallest node reached.

    Alternating large-star and small-star steps; each round's edges go to the shared folder. The
    rounds end when the edge set no longer changes, after about log(nodes) of them. Loops (u = v)
    are left out, so a node without another neighbour has no row.
    """

    def stamp(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    def distinct(e: DataFrame) -> DataFrame:
        return e.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    now = materialize(distinct(edges.select("u", "v")), "edges")
    mark = stamp(now)
    for _ in range(most_rounds):
        if mark[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = distinct(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        met = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = met.select("u", F.col("m").alias("v")).unionByName(met.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = materialize(distinct(small), "edges")
        was, mark = mark, stamp(now)
        if was == mark:
            break
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
