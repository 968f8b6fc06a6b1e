"""Exact top-k search by integer inner product: exhaustive term-at-a-time accumulation.

A vector is a sparse row: its dimensions are terms and its non-zero components, scaled and floored,
their weights. A task reads its rows in Arrow batches; of each batch it makes a posting list a
dimension (the rows that have it, and their weights). For each query the postings of the query's own
dimensions are taken in turn and scattered, times the query's weight, into a dense array with a score
for each row of the batch. A partition selection keeps the k best, which are merged with those of
the task's earlier batches, and at last with those of other tasks.

Queries are a stated set and meet all rows in blocks: each block of QUERY_BLOCK queries is sent to
the tasks that read the rows, and rows are neither copied nor shuffled for it. What a task holds is a
block of queries, a batch of rows and k results a query.

Defined results: vectors that are null or hold null or non-finite components, and rows without an
id, take no part; an empty or zero vector does, with score 0 everywhere; a shorter vector has 0 in the
dimensions that it lacks; components saturate where their products could leave 64 bits (with 64
dimensions at 379,625,062); equal scores go to the smaller id; rows that repeat id and vector ask once
and stand as often as they come; rows of one id with other vectors ask each on its own and are no
candidates of each other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.llm.common import materialize, query_blocks

K = 5
SCALE = 256
QUERY_BLOCK = 4096
#: Rows of a written part, more where all cores would else not be used.
TASK_ROWS = 50_000
#: Queries that are scored at a time.
_TILE = 32
_FOUND = "query long, query_id long, vec_id long, score long"
_NONE = np.iinfo(np.int64).min


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def quantized(rows: DataFrame, id_col: str, vector_col: str, most: int | None = None) -> DataFrame:
    """id, v (array of long) of the rows that take part; components lie within most."""
    cast = F.col(vector_col).cast("array<double>")
    sound = rows.select(F.col(id_col).cast("long").alias("id"), cast.alias("x")).where(F.col("id").isNotNull() & usable(F.col("x")))
    whole = F.transform("x", lambda x: F.floor(x * SCALE))
    return sound.select("id", (whole if most is None else F.transform(whole, lambda v: F.least(F.lit(most), F.greatest(F.lit(-most), v)))).alias("v"))


class Postings:
    """For each dimension of a batch the rows with a weight there, in order, and the weights."""

    def __init__(self, vectors: pa.ListArray) -> None:
        self.rows = len(vectors)
        sizes = np.diff(vectors.offsets.to_numpy(zero_copy_only=False))
        weights = vectors.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(self.rows), sizes)
        term = np.arange(len(weights)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        some = np.nonzero(weights)[0]
        some = some[np.argsort(term[some], kind="stable")]
        terms, starts = np.unique(term[some], return_index=True)
        ends = [*starts[1:], len(some)]
        self.of = {int(t): (row[some[a:b]], weights[some[a:b]]) for t, a, b in zip(terms, starts, ends, strict=True)}

    def scores(self, queries: list[list[int]]) -> np.ndarray:
        """Dense scores (queries x rows), a term after the other."""
        out = np.zeros((len(queries), self.rows), np.int64)
        asked: dict[int, tuple[list[int], list[int]]] = {}
        for i, query in enumerate(queries):
            for term, weight in enumerate(query):
                if weight and term in self.of:
                    at, weights = asked.setdefault(term, ([], []))
                    at.append(i)
                    weights.append(weight)
        for term, (at, weights) in asked.items():
            rows, theirs = self.of[term]
            if len(rows) == self.rows:  # every row has the term
                for i, w in zip(at, weights, strict=True):
                    out[i] += theirs * w
            else:
                for i, w in zip(at, weights, strict=True):
                    out[i, rows] += theirs * w
        return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, equal ones by id, after a partition selection."""
    if len(scores) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.nonzero(scores >= bar)[0]
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def scan(batches: Iterator[pa.RecordBatch], queries: list, k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of a task for each query (number, id, vector); at most k rows a query come out."""
    held_ids = [np.empty(0, np.int64) for _ in queries]
    held = [np.empty(0, np.int64) for _ in queries]
    for batch in batches:
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        postings = Postings(batch.column("v"))
        for at in range(0, len(queries), _TILE):
            part = queries[at : at + _TILE]
            for i, (mine, (_, own, _)) in enumerate(zip(postings.scores([q[2] for q in part]), part, strict=True), at):
                # Rows under the k-th best of earlier batches are out.
                could = ids != own
                if len(held[i]) >= k:
                    could &= mine >= held[i][-1]
                places = np.nonzero(could)[0]
                if not len(places):
                    continue
                scores, named = np.concatenate((held[i], mine[places])), np.concatenate((held_ids[i], ids[places]))
                best = _best(scores, named, k)
                held[i], held_ids[i] = scores[best], named[best]
    counts = [len(h) for h in held]
    if sum(counts):
        number, own = (np.repeat(np.array([q[j] for q in queries], np.int64), counts) for j in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(own), pa.array(np.concatenate(held_ids)), pa.array(np.concatenate(held))], ["query", "query_id", "vec_id", "score"])


def search(rows: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per query and rank: query_id, rank (from 1), vec_id, score, query (a number of its own for each id and vector)."""
    spark = rows.sparkSession
    longest = quantized(rows, id_col, vector_col).agg(F.max(F.size("v"))).first()[0] or 1
    most = math.isqrt(((1 << 63) - 1) // max(1, longest)) - 1
    base = quantized(rows, id_col, vector_col, most)
    # Rows are dealt round robin, so that equal ones spread too.
    parts = max(spark.sparkContext.defaultParallelism, -(-base.count() // TASK_ROWS))
    base = materialize(base.repartition(parts), "quantized")
    found = spark.createDataFrame([], _FOUND)
    for block in query_blocks(quantized(queries, id_col, vector_col, most), QUERY_BLOCK):
        sent = spark.sparkContext.broadcast(block)
        found = found.unionByName(materialize(base.mapInArrow(lambda batches, sent=sent: scan(batches, sent.value, k), _FOUND), "best"))
        sent.unpersist()
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query")
