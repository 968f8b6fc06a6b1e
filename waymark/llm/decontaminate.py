"""Benchmark decontamination by SimHash of item-sized windows. DataFrame operations only.

Windows of a document are as long as a benchmark item. A window has a SimHash fingerprint of 256 bits
of its distinct five-word shingles, each as heavy as it is rare among the items. Multi-index Hamming
blocks retrieve, for each window, all items of its length whose fingerprint is within RADIUS bits: a
fingerprint has sixteen blocks of sixteen bits, items are indexed under every value of a block that is
at most three bits off, and of two fingerprints at 63 or fewer differing bits one block differs by at
most three. Of unrelated pairs a block brings together one in 94, so the sixteen make 0.17 rows a pair
that the radius then tests. The exact weighted Jaccard similarity of the shingles, 0.8 or more,
verifies the pairs.

At similarity 0.8 the angle between the two shingle sets is 27 degrees, so 38 of the 256 bits differ
on average with a deviation of 5.7: RADIUS is 4.3 deviations off.

A window that shares no shingle with the benchmark has similarity 0 with every item, whatever its
fingerprint, so windows are laid only where a shared shingle stands: with each shared shingle at each
place that it has in an item, at the starts between two places a quarter of a window apart or less
(words put in or left out), and moved back where a window would pass the document's end.

Defined results: null, empty and short texts hold no window and match nothing; items of fewer than
five words have no shingle and match nothing; repeated rows give a row each, for ids that repeat
one; rows with a null id match with a null id; an empty table on either side gives no rows; extra
columns are ignored, and ``clean`` keeps them.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import hinted, materialize, shingle_hashes, small_enough, words

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: 64-bit words of a fingerprint, and the blocks that it is cut into.
WORDS = 4
BLOCKS, BLOCK_BITS = 16, 16
#: Bits that one block may be off, and what that makes certain for whole fingerprints.
BLOCK_RADIUS = 3
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Rows up to which a table made from the benchmark is broadcast; beyond it Spark shuffles.
BROADCAST_ROWS = 500_000


def _blocks(fp: str) -> Column:
    """The blocks of a fingerprint, each with its place."""
    whole, each = (1 << BLOCK_BITS) - 1, 64 // BLOCK_BITS
    return F.array(*[F.shiftrightunsigned(F.element_at(fp, b // each + 1), BLOCK_BITS * (b % each)).bitwiseAND(F.lit(whole)) + F.lit(b << BLOCK_BITS).cast("long") for b in range(BLOCKS)])


def _variants(fp: str) -> Column:
    """Every value that is at most BLOCK_RADIUS bits off a block of a fingerprint, each with its place."""
    bits = range(BLOCK_BITS)
    masks = [sum(1 << b for b in off) for n in range(BLOCK_RADIUS + 1) for off in combinations(bits, n)]
    listed = F.expr(f"array({', '.join(f'{m}L' for m in masks)})")
    return F.flatten(F.transform(_blocks(fp), lambda block: F.transform(listed, lambda m: block.bitwiseXOR(m))))


def _apart(a: str, b: str) -> Column:
    """In how many bits two fingerprints differ."""
    words = [F.bit_count(F.element_at(a, w + 1).bitwiseXOR(F.element_at(b, w + 1))) for w in range(WORDS)]
    return words[0] + words[1] + words[2] + words[3]


#: Two bits of a word, 32 apart, are counted in one long: the weights of a window's shingles stay under 2^32.
_LANES, _LANE = (1 << 32) + 1, (1 << 32) - 1


def bit_sums(shingle: str, weight: str) -> list[Column]:
    """Aggregates over a window's distinct shingles: the weight that has each bit, two bits a column."""
    words = [shingle, *[f"xxhash64({shingle}, {w})" for w in range(1, WORDS)]]
    return [F.expr(f"sum((shiftrightunsigned({words[w]}, {b}) & {_LANES}L) * {weight})").alias(f"bits{w}_{b}") for w in range(WORDS) for b in range(32)]


def fingerprint(total: str) -> Column:
    """SimHash from the columns of bit_sums(): the bits that over half the total weight has."""
    # Each lane is a choice between two literals: built as text, for a Column a bit would take seconds to build.
    def bit(w: int, b: int) -> str:
        lane = f"bits{w}_{b} & {_LANE}L" if b < 32 else f"shiftrightunsigned(bits{w}_{b - 32}, 32)"
        return f"if(({lane}) * 2 > {total}, shiftleft(1L, {b}), 0L)"

    return F.expr("array(" + ", ".join(" | ".join(bit(w, b) for b in range(64)) for w in range(WORDS)) + ")")


def _total(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda n, x: n + x["weight"])


def _up_to_next(start: Column, i: Column) -> Column:
    """The starts from one place of a window to the next, if that is near; else the place alone."""
    after = F.try_element_at("places", i + 2)
    return F.when(after - start <= F.col("n") / 4, F.sequence(start, after - 1)).otherwise(F.array(start))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, similarity, n_windows): the best similarity over the document's windows."""
    items = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("words")).where(F.size("words") >= SHINGLE_WORDS)
    # Items of one text share a key, whatever their ids are.
    items = items.withColumns({"item": F.sha2(F.concat_ws(" ", "words"), 256), "shingles": shingle_hashes(F.col("words"), SHINGLE_WORDS), "n": F.size("words")})
    items = materialize(items, "items")
    n_items = items.count()

    # Thousandths between 0 and 1000: log((items + 1) / (items with it)) over its largest value.
    seen = items.select(F.explode(F.array_distinct("shingles")).alias("shingle")).groupBy("shingle").agg(F.count("*").alias("df"))
    rarity = F.greatest(F.lit(1), F.round(1000 * F.log((n_items + 1) / F.col("df")) / F.log(F.lit(n_items + 1.0)))).cast("long")
    shingle_weight = materialize(seen.select("shingle", rarity.alias("weight")), "shingle-weights")
    small = small_enough(items.select(F.explode("words")), BROADCAST_ROWS)

    # Where in a window of n words the shingle may stand.
    seats = items.select("n", F.posexplode("shingles").alias("seat", "shingle")).distinct()
    texts = docs.select(F.xxhash64(text_col).alias("_t"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spread = texts.select("doc_id", "_t", F.posexplode(shingle_hashes(words(F.col("text")), SHINGLE_WORDS)).alias("at", "shingle"))
    laid = spread.join(hinted(seats, small), "shingle").select("doc_id", "_t", F.greatest(F.lit(0), F.col("at") - F.col("seat")).alias("start"), "n").distinct()
    laid = materialize(laid, "laid")
    # One row for each document with windows; each window's words are cut from its text.
    places = laid.groupBy("doc_id", "_t", "n").agg(F.array_sort(F.collect_set("start")).alias("places"))
    filled = F.flatten(F.transform("places", _up_to_next))
    starts = places.select("doc_id", "_t", "n", filled.alias("starts")).groupBy("doc_id", "_t").agg(F.collect_list(F.struct("starts", "n")).alias("windows"))
    held = texts.join(starts, [texts["doc_id"].eqNullSafe(starts["doc_id"]), texts["_t"].eqNullSafe(starts["_t"])]).select(texts["doc_id"], texts["_t"], words(F.col("text")).alias("all"), "windows")
    each = held.select("doc_id", "_t", "all", F.explode("windows").alias("w"))
    last = F.greatest(F.lit(0), F.size("all") - F.col("w.n"))
    each = each.select("doc_id", "_t", "all", F.col("w.n").alias("n"), F.explode(F.array_union(F.col("w.starts"), F.transform("w.starts", lambda x: F.least(x, last)))).alias("start"))
    cut = each.select("doc_id", "_t", "start", "n", F.slice("all", F.col("start") + 1, F.col("n")).alias("words"))
    # Equal windows, of copies or of much-shared passages, are compared once.
    cut = materialize(cut.withColumn("window", F.sha2(F.concat_ws(" ", F.col("n").cast("string"), "words"), 256)).dropDuplicates(["doc_id", "_t", "start", "n"]), "windows")
    distinct = cut.groupBy("window").agg(F.first("n").alias("n"), F.first("words").alias("words"))

    def weighted(rows: DataFrame, keys: list[str], shingles: Column) -> DataFrame:
        """keys, pairs (the distinct shingles with their weights; unknown ones are as rare as can be), total, fp."""
        each = rows.select(*keys, F.explode(F.array_distinct(shingles)).alias("shingle")).join(hinted(shingle_weight, small), "shingle", "left")
        each = each.withColumn("weight", F.coalesce("weight", F.lit(1000).cast("long")))
        sums = each.groupBy(*keys).agg(F.collect_list(F.struct("shingle", "weight")).alias("pairs"), F.sum("weight").alias("total"), *bit_sums("shingle", "weight"))
        return sums.select(*keys, "pairs", "total", fingerprint("total").alias("fp"))

    held = materialize(weighted(distinct, ["window", "n"], shingle_hashes(F.col("words"), SHINGLE_WORDS)), "window-prints")
    asked = materialize(weighted(items.dropDuplicates(["item"]), ["item", "n"], F.col("shingles")), "item-prints")
    few = small and small_enough(asked, BROADCAST_ROWS // 1_000)
    # One long is the key: the block with its place, and the length.
    key = lambda block: (block + F.col("n").cast("long") * F.lit(BLOCKS << BLOCK_BITS)).alias("key")
    index = asked.select("item", F.explode(F.array_distinct(_variants("fp"))).alias("block"), "n").select(key(F.col("block")), F.xxhash64("item").alias("item_key"))
    index = materialize(index, "index")  # else Spark takes it to be as small as what it is made from, and broadcasts it
    probes = held.select("window", "n", F.explode(_blocks("fp")).alias("block")).select(key(F.col("block")), F.xxhash64("window").alias("window_key"))
    met = probes.join(hinted(index, small and small_enough(index, BROADCAST_ROWS)), "key").select("window_key", "item_key").distinct()
    met = met.join(held.select(F.xxhash64("window").alias("window_key"), "window", "n", "fp"), "window_key")
    met = met.join(hinted(asked.select(F.xxhash64("item").alias("item_key"), "item", F.col("n").alias("its_n"), F.col("fp").alias("its_fp")), few), "item_key")
    met = met.where((F.col("n") == F.col("its_n")) & (_apart("fp", "its_fp") <= RADIUS)).select("window", "item")
    theirs = asked.select("item", F.col("pairs").alias("its_pairs"), F.col("total").alias("its_total"))
    both = met.join(held.select("window", "pairs", "total"), "window").join(hinted(theirs, few), "item")
    # A shingle weighs the same wherever it stands, so the structs are equal where the shingles are.
    common = _total(F.array_intersect("pairs", "its_pairs"))
    scored = both.select("window", "item", common.alias("common"), (F.col("total") + F.col("its_total")).alias("sum"))
    scored = scored.select("window", "item", (F.col("common") / (F.col("sum") - F.col("common"))).alias("similarity"))
    alike = scored.where(F.col("similarity") >= SIMILARITY)
    alike = alike.join(hinted(items.select("item", "item_id"), small), "item")
    return cut.select("doc_id", "window").join(alike, "window").groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.count("*").alias("n_windows"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs in which no item was found, all columns as they were.

    Ids stand for documents: rows that share an id go or stay together, rows without one too.
    """
    bad = leaks(docs, benchmark, id_col, text_col).select("doc_id").distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["doc_id"]), "left_anti")
