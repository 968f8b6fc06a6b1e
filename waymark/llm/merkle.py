"""Merkle manifest of a dataset: a leaf a row, trees of sixteen a source, one root over the sources.

Rows are ranked within their source by id and fall into buckets of 4,096 aligned leaves: whole runs
of three levels. Spark deals buckets to tasks in blocks of BLOCK_ROWS or so; on a block a DuckDB
engine runs the level queries, an ordered string_agg and a sha256 a level over all buckets at once,
on Arrow tables. The first pass gives bucket roots. Spark combines these level by level up to each
source's root and the sources' roots up to the root, and joins to each bucket what its proofs hold
above it. The second pass adds what they hold within the bucket and folds each leaf up to the root.
Only rows of digests are shuffled, never texts.

A digest is a lower-case hex sha256; where digests are hashed they are concatenated as hex text. A
node is the digest of up to sixteen nodes below it, even of one, until one node remains.

Defined results: null fields are written ``-``; a null id comes first in its source and is never
tampered with; a null source comes first of all; rows of one source and id follow each other by leaf,
and equal rows take neighbouring leaves, each with its own proof; texts that hold no A-Z are the same
when tampered with, so they verify; a lone leaf is its source's root and, alone, the root, with the
digest of nothing as its proof; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import heavy_join, materialize, ordered_rank

FANOUT, BUCKET_LEVELS = 16, 3
BUCKET = FANOUT**BUCKET_LEVELS
#: Rows that a task holds at a time, or some buckets more, for buckets fall into blocks by a hash.
BLOCK_ROWS = 8_192
#: Rows of which an engine has the proofs at a time, in whole buckets; a block of many buckets is read in parts.
PART_ROWS = BUCKET
#: Ids whose checksum this divides are tampered with before folding.
TAMPERED = 5
#: Memory that a task's engine may take.
ENGINE_MEMORY = "400MB"
_BUCKET_ROOTS = "src string, bucket long, n long, h string"
_FOLDED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def field(value: Column) -> Column:
    """A field as bytes, colon, value; a null as a dash."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """src (the source, sortable and never null), doc_id, leaf, and tampered: the leaf of the tampered row, or null."""
    lower = F.translate(text_col, string.ascii_uppercase, string.ascii_lowercase)

    def leaf(text: Column) -> Column:
        head = [field(F.col(c)) for c in (id_col, "source", "lang", "n_chars")]
        return F.sha2(F.concat(*head, field(text)), 256)

    touched = F.crc32(F.col(id_col).cast("string")) % TAMPERED == 0
    src = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    return docs.select(src.alias("src"), F.col(id_col).cast("long").alias("doc_id"), leaf(F.col(text_col)).alias("leaf"), F.when(touched, leaf(lower)).alias("tampered"))


def _engine(**tables: pa.Table) -> duckdb.DuckDBPyConnection:
    """A DuckDB of the task's own with the Arrow tables registered and no files of its own."""
    db = duckdb.connect()
    db.execute(f"SET threads = 1; SET memory_limit = '{ENGINE_MEMORY}'; SET temp_directory = ''")
    for name, table in tables.items():
        db.register(name, table)
    return db


def _levels(db: duckdb.DuckDBPyConnection) -> None:
    """Tables run1 .. run3 (src, bucket, idx, depth, run, h): the runs of each level of all buckets in leaf(src, bucket, idx, depth, h)."""
    below = "leaf"
    for level in range(1, BUCKET_LEVELS + 1):
        db.execute(
            f"CREATE TABLE run{level} AS SELECT *, sha256(run) AS h FROM (SELECT src, bucket, idx // {FANOUT} AS idx, any_value(depth) AS depth, string_agg(h, '' ORDER BY idx) AS run "
            f"FROM {below} WHERE depth >= {level} GROUP BY src, bucket, idx // {FANOUT})"
        )
        below = f"run{level}"


_LEAF = f"CREATE TABLE leaf AS SELECT src, bucket, CAST(pos % {BUCKET} AS INTEGER) AS idx, n, depth, doc_id, leaf AS h, tampered FROM given"


def _parts(block: pa.Table) -> Iterator[tuple[pa.Table, pa.Table]]:
    """The block in parts of whole buckets, PART_ROWS or one bucket at most, each with its buckets (src, bucket)."""
    block = block.sort_by([("src", "ascending"), ("bucket", "ascending")])
    buckets = block.group_by(["src", "bucket"], use_threads=False).aggregate([([], "count_all")])  # in the order of the rows
    first = at = rows = 0
    for k, n in enumerate([*buckets["count_all"].to_pylist(), PART_ROWS + 1]):
        if rows and rows + n > PART_ROWS:
            yield block.slice(at, rows), buckets.select(["src", "bucket"]).slice(first, k - first)
            first, at, rows = k, at + rows, 0
        rows += n


def bucket_roots(block: pa.Table) -> pa.Table:
    """One row a bucket of the block: its root (for a source of one bucket, the source's)."""
    return pa.concat_tables([_bucket_roots(part) for part, _ in _parts(block)])


def _bucket_roots(block: pa.Table) -> pa.Table:
    with _engine(given=block) as db:
        db.execute(_LEAF)
        _levels(db)
        tops = " UNION ALL ".join(f"SELECT src, bucket, h FROM {'leaf' if k == 0 else f'run{k}'} WHERE depth = {k}" for k in range(BUCKET_LEVELS + 1))
        return db.sql(f"SELECT src, bucket, n, h FROM ({tops}) JOIN (SELECT src, bucket, any_value(n) AS n FROM leaf GROUP BY ALL) USING (src, bucket)").to_arrow_table()


def folded(block: pa.Table, outer: pa.Table) -> pa.Table:
    """One row a leaf of the block: its proof and what it folds up to. outer: src, bucket, before, after, subroot, root."""
    at = outer.select(["src", "bucket"]).append_column("at", pa.array(range(outer.num_rows), pa.int64()))
    own = lambda buckets: outer.take(at.join(buckets, ["src", "bucket"], join_type="inner", use_threads=False)["at"])
    return pa.concat_tables([_folded(part, own(buckets)) for part, buckets in _parts(block)])


def _folded(block: pa.Table, outer: pa.Table) -> pa.Table:
    with _engine(given=block, outer_part=outer) as db:
        db.execute(_LEAF)
        _levels(db)
        step, inner, folds, joins = "idx", [], "coalesce(tampered, leaf.h)", []
        for k in range(1, BUCKET_LEVELS + 1):
            at = f"64 * ({step} % {FANOUT})"
            before, after = f"coalesce(substr(run{k}.run, 1, {at}), '')", f"coalesce(substr(run{k}.run, {at} + 65), '')"
            inner += [before, after]
            folds = f"CASE WHEN leaf.depth >= {k} THEN sha256({before} || {folds} || {after}) ELSE {folds} END"
            step = f"({step} // {FANOUT})"
            joins.append(f"LEFT JOIN run{k} ON run{k}.src = leaf.src AND run{k}.bucket = leaf.bucket AND run{k}.idx = {step}")
        db.execute(
            f"CREATE TABLE up AS SELECT doc_id, leaf.h AS leaf, o.subroot, o.root, o.before, o.after, {folds.replace('idx', 'leaf.idx')} AS f, {' || '.join(inner).replace('idx', 'leaf.idx')} AS proof "
            f"FROM leaf {' '.join(joins).replace('(idx', '(leaf.idx')} JOIN outer_part o ON o.src = leaf.src AND o.bucket = leaf.bucket"
        )
        # Above the bucket: as many levels as its source and the sources together have.
        above = db.execute("SELECT coalesce(max(len(before)), 0) FROM up").fetchall()[0][0]
        for k in range(1, above + 1):
            db.execute(f"CREATE OR REPLACE TABLE up AS SELECT * REPLACE (CASE WHEN len(before) >= {k} THEN sha256(before[{k}] || f || after[{k}]) ELSE f END AS f, CASE WHEN len(before) >= {k} THEN proof || before[{k}] || after[{k}] ELSE proof END AS proof) FROM up")
        return db.sql("SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM up").to_arrow_table()


def climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From nodes (tree, place, n, h), n of them a tree: the paths (tree, place, before, after) and the roots (tree, root).

    before and after hold, level by level, the digests left and right of the path's own node in its run.
    """
    none = F.array().cast("array<string>")
    level = materialize(nodes, "nodes")
    paths = level.select("tree", "place", F.col("place").alias("at"), none.alias("before"), none.alias("after"))
    level = level.withColumnRenamed("place", "at")
    roots = level.where("n = 1")
    while level.where("n > 1").take(1):
        up = F.expr(f"at div {FANOUT}").alias("at")
        below = F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"])
        runs = level.where("n > 1").groupBy("tree", "n", up).agg(F.array_join(below, "").alias("run"))
        level = materialize(runs.select("tree", "at", F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), "run", F.sha2("run", 256).alias("h")), "nodes")
        own = (F.col("at") % FANOUT * 64).cast("int")
        here = paths.select("*", F.expr(f"at div {FANOUT}").alias("up")).join(level.select("tree", F.col("at").alias("up"), "run"), ["tree", "up"], "left")
        met = F.col("run").isNotNull()
        grown = {c: F.when(met, F.concat(c, F.array(part))).otherwise(F.col(c)) for c, part in (("before", F.substring("run", F.lit(1), own)), ("after", F.substring("run", own + 65, F.lit(64 * FANOUT))))}
        paths = here.withColumns(grown).select("tree", "place", F.col("up").alias("at"), "before", "after")
        roots = roots.unionByName(level.where("n = 1").drop("run"))
    return paths.drop("at"), roots.select("tree", F.col("h").alias("root"))


def manifest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    spark = docs.sparkSession
    ranked = ordered_rank(materialize(leaves(docs, id_col, text_col), "digests"), ["src"], ["doc_id", "leaf"], "pos", "n")
    total = ranked.count()
    if not total:
        return spark.createDataFrame([], _FOLDED)
    depth = F.when(F.col("n") <= 1, 0).otherwise(F.least(F.lit(BUCKET_LEVELS), F.length(F.hex(F.col("n") - 1))))  # hex digits: levels of sixteen
    bucket = F.expr(f"pos div {BUCKET}")
    block = F.pmod(F.xxhash64("src", "bucket"), F.lit(-(-total // BLOCK_ROWS)))
    cut = materialize(ranked.withColumns({"depth": depth.cast("int"), "bucket": bucket}).withColumn("block", block), "leaves")
    given = ["block", "src", "bucket", "pos", "n", "depth", "doc_id", "leaf", "tampered"]
    roots = materialize(cut.select(*given).groupBy("block").applyInArrow(bucket_roots, _BUCKET_ROOTS), "bucket-roots")

    buckets = roots.select(F.col("src").alias("tree"), F.col("bucket").alias("place"), F.expr(f"(n + {BUCKET - 1}) div {BUCKET}").alias("n"), "h")
    inside, subroots = climb(buckets)
    seats = ordered_rank(subroots, [], ["tree"], "place", "n")
    outside, top = climb(seats.select(F.lit("").alias("tree"), "place", "n", F.col("root").alias("h")))
    root = top.first().root
    over = seats.join(outside.drop("tree"), "place").join(buckets.groupBy("tree").agg(F.count("*").alias("size")), "tree")
    over = materialize(over.select("tree", F.col("root").alias("subroot"), F.col("before").alias("before2"), F.col("after").alias("after2"), "size"), "subroots")
    outer = heavy_join(inside, over, "tree", "size")
    outer = outer.select(F.col("tree").alias("src"), F.col("place").alias("bucket"), F.concat("before", "before2").alias("before"), F.concat("after", "after2").alias("after"), "subroot", F.lit(root).alias("root"))
    outer = materialize(outer.withColumn("block", block), "outer-proofs")
    return cut.select(*given).groupBy("block").cogroup(outer.groupBy("block")).applyInArrow(folded, _FOLDED)
