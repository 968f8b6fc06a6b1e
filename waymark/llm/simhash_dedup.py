"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Of two fingerprints at 2 or fewer differing
bits, one segment differs by at most one bit, so both hold an equal variant of that segment with
one bit wild. Every distinct fingerprint is indexed under its 64 one-wildcard variants; an equality
join on the variants finds all candidate pairs and the full distance verifies them.

Defined results: null, empty and blank texts have fingerprint 0 and are linked like any other;
repeated rows come back once each; an empty table gives an empty result; other columns are ignored
by ``near_duplicates`` and carried unchanged by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.llm.common import components, heavy_join, materialize

SHINGLE_WORDS = 3
SEED = 42
MAX_DISTANCE = 2
#: Variants that more fingerprints than this share are cut once more before their pairs are formed.
HOT_VARIANT = 256
_BLOCK = 1 << 15


def simhash64(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text as a signed 64-bit integer; its shingles are hashed in blocks."""
    # bytes.lower() and bytes.split() know only ASCII: A-Z, and white space \x20 \x09-\x0D.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        end = min(n, at + _BLOCK)
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle_words]), SEED) for i in range(at, end)), np.uint64, end - at
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash64(t, shingle_words) for t in texts], dtype="int64")

    return of(text)


def links(prints: DataFrame) -> DataFrame:
    """Pairs (u, v) of the distinct longs in column fp, u < v, at 2 or fewer differing bits.

    The list is whole in what it connects: each pair within the distance appears at least once.
    """
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    index = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("at"))
    segment = F.when(F.col("at") < 32, low).otherwise(high)
    wild = F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at") % 32))
    index = index.select(
        "fp", (F.col("at").cast("long") * (1 << 32) + segment.bitwiseAND(wild)).alias("variant"), (F.col("at") % 32 == 0).alias("first")
    )
    sized = index.withColumn("n", F.count("*").over(W.partitionBy("variant"))).where("n > 1")
    sized = materialize(sized, "variants")

    def pairs(rows: DataFrame, *on: str) -> DataFrame:
        a = rows.select(*on, F.col("fp").alias("u"))
        b = rows.select(*on, F.col("fp").alias("v"))
        near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_DISTANCE
        return a.join(b, [a[k] == b[k] for k in on] + [F.col("u") < F.col("v"), near]).select("u", "v")

    cold = sized.where(F.col("n") <= HOT_VARIANT)
    found = pairs(cold, "variant")
    # A hot variant fixes 31 bits. Within it the other 32 bits differ by at most 2, so of their two
    # 16-bit halves one differs by at most one bit: the same cut again, on 46 fixed bits.
    hot = sized.where(F.col("n") > HOT_VARIANT)
    other = F.when(F.col("variant") < F.lit(32 * (1 << 32)), high).otherwise(low)
    finer = hot.select("fp", "variant", other.alias("other"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("cut"))
    half = F.when(F.col("cut") < 16, F.col("other").bitwiseAND(F.lit(0xFFFF))).otherwise(F.shiftrightunsigned("other", 16))
    wild = F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("cut") % 16))
    finer = finer.select("fp", "variant", (F.col("cut").cast("long") * (1 << 32) + half.bitwiseAND(wild)).alias("finer"))
    return found.unionByName(pairs(finer, "variant", "finer")).distinct()


def print_classes(prints: DataFrame) -> DataFrame:
    """(fp, root) for each distinct fingerprint that has a link."""
    return components(links(prints)).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), n_links.

    n_links counts the other distinct fingerprints within the distance. Rows of one fingerprint are
    tied by component_id alone and never paired off. A component whose ids are all null has a null
    component_id.
    """
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("fp")), "prints")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "distinct-prints")
    edges = materialize(links(prints.select("fp")), "links")
    classes = components(edges).select(F.col("node").alias("fp"), "root")
    degree = edges.select(F.col("u").alias("fp")).unionByName(edges.select(F.col("v").alias("fp"))).groupBy("fp").agg(F.count("*").alias("n_links"))
    classed = prints.join(classes, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = classed.select("fp", "root", "rows").join(least, "root").join(degree, "fp", "left")
    of_print = materialize(of_print.select("fp", "rows", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    # A fingerprint may be that of a third of all rows, as that of empty texts.
    return heavy_join(rows, of_print, "fp", "rows").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def _row_hash(docs: DataFrame) -> Column:
    """A hash of all columns; maps, which xxhash64() does not take, are hashed as JSON."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with one row left of each near-duplicate group: that with the smallest id.

    Null ids come after others; ties go to the smallest row hash, and of rows alike in every column one
    is left. All columns return as they were.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    printed = docs.select(whole.alias("row"), F.col(id_col).alias("id"), _row_hash(docs).alias("hash"), fingerprint(F.col(text_col)).alias("fp"))
    # The number is written with its row, so it names one row for good; rows alike in every column differ by it.
    printed = materialize(printed.withColumn("number", F.monotonically_increasing_id()), "printed")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "hash", "number")
    prints = materialize(printed.groupBy("fp").agg(F.min(rank).alias("rank")), "prints")
    classed = prints.join(print_classes(prints.select("fp")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = classed.groupBy("root").agg(F.min("rank").alias("best")).select("best.number")
    # Whole rows are shuffled once, by a key that no two of them share, so copies spread over all tasks.
    return printed.join(best, "number", "left_semi").select("row.*")
