"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.operators.graph import components
from waymark.operators.storage import materialize, scratch, shared_dir

__all__ = ["components", "global_rank", "heavy_join", "hinted", "materialize", "ordered_rank", "query_blocks", "scratch", "shared_dir", "shingle_hashes", "small_enough", "words"]

#: Words for word shingles: runs of letters, marks and digits of the lower-cased text.
NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-case words of a text; null and wordless texts give an empty array."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def shingle_hashes(words_col: Column, n: int) -> Column:
    """One xxhash64 per n-word shingle, in text order; fewer than n words give none."""
    # The words are bound to a lambda's variable, else Spark would split the text again for each shingle.
    def of(ws: Column) -> Column:
        count = F.size(ws) - n + 1
        each = F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice(ws, i, n)))
        return F.when(count > 0, each).otherwise(F.array().cast("array<bigint>"))

    return F.element_at(F.transform(F.array(words_col), of), 1)


def small_enough(df: DataFrame, most: int) -> bool:
    """Whether df has at most so many rows; reads no further than that."""
    return df.limit(most + 1).count() <= most


def hinted(df: DataFrame, broadcastable: bool) -> DataFrame:
    """A broadcast hint where a size check allowed it; otherwise Spark shuffles both sides."""
    return F.broadcast(df) if broadcastable else df


def heavy_join(rows: DataFrame, table: DataFrame, key: str, size: str, total: int | None = None, share: int = 1000) -> DataFrame:
    """rows joined with table, whose keys are distinct and whose column size tells how many rows have the key.

    Keys that hold over one in share of all rows are fewer than share, so their part of table is
    broadcast and their rows stay where they are; only rows of other keys are shuffled.
    """
    total = rows.count() if total is None else total
    heavy = table.where(F.col(size) * share > total)
    light = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(table.where(F.col(size) * share <= total), key)
    return rows.join(F.broadcast(heavy), key).unionByName(light)


def query_blocks(queries: DataFrame, most: int) -> Iterator[list[tuple]]:
    """The distinct rows (id, v, ...) of a query set in blocks of about most rows, each block read on its own: (number, id, v, ...).

    The driver holds one block at a time. Numbers are distinct over all blocks.
    """
    asked = queries.distinct()
    blocks = max(1, -(-asked.count() // most))
    dealt = materialize(asked.withColumn("_block", F.pmod(F.xxhash64(*queries.columns), F.lit(blocks))), "queries")
    number = 0
    for b in range(blocks):
        rows = [(number + i, *r) for i, r in enumerate(dealt.where(F.col("_block") == b).drop("_block").collect())]  # a block
        number += len(rows)
        if rows:
            yield rows


def global_rank(df: DataFrame, keys: list[str], order: list[Column], rank: str, rows_per_bucket: int = 20_000, least_buckets: int = 256) -> DataFrame:
    """Add a gapless rank from 0 within keys, however many rows a key has and however many rows are alike.

    Rows go to hashed buckets of about rows_per_bucket, least_buckets of them at least; row_number()
    orders each bucket, and the buckets' offsets, one small row a bucket, join back. The hash takes
    in a row number written with the rows, so that equal rows spread over buckets as others do. No
    task ever sorts a whole key.
    """
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    cut = materialize(numbered, "numbered")
    buckets = max(least_buckets, -(-cut.count() // rows_per_bucket))
    cut = cut.withColumn("_bucket", F.pmod(F.xxhash64(*order, "_row"), F.lit(buckets)))
    counts = cut.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over((W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy("_bucket")) - F.col("_n")
    offsets = counts.withColumn("_before", before).drop("_n")
    inner = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order, "_row")) - 1
    ranked = cut.withColumn("_inner", inner)
    on = [ranked[k].eqNullSafe(offsets[k]) for k in [*keys, "_bucket"]]
    joined = ranked.join(offsets, on, "left")
    return joined.select(*[ranked[c] for c in df.columns], (ranked["_inner"] + offsets["_before"]).cast("long").alias(rank))


def ordered_rank(df: DataFrame, keys: list[str], order: list[str], rank: str, size: str, rows_per_range: int = 50_000) -> DataFrame:
    """Add a gapless rank from 0 within keys (without nulls) in the order of columns, nulls first, and the key's number of rows.

    Rows are sorted in ranges over all keys and written with their places; a range's offset within a
    key, one small row a range and key, joins back. A row number is the last to sort by, so that a
    range can end among equal rows. No task sorts a whole key.
    """
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    by = [F.col(c).asc_nulls_first() for c in [*keys, *order, "_row"]]
    ranges = max(1, -(-df.count() // rows_per_range))
    placed = numbered.repartitionByRange(ranges, *by).sortWithinPartitions(*by).drop("_row").withColumn("_place", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("_range", F.shiftright("_place", 33)), "ranges")
    counts = placed.groupBy(*keys, "_range").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    key = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    offsets = counts.select(*keys, "_range", "_first", (F.sum("_n").over(key.orderBy("_range")) - F.col("_n")).alias("_before"), F.sum("_n").over(key).alias(size))
    met = placed.join(offsets, [*keys, "_range"])
    return met.select(*df.columns, (F.col("_place") - F.col("_first") + F.col("_before")).alias(rank), size)
