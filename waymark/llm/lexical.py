"""Ranked lexical search by Fagin's threshold algorithm.

A pass over the documents writes a forward index: of each document with terms its length and the
counts of the terms that the items ask for. Corpus statistics (documents, terms, document frequencies)
are counted over all of them. A task then reads its documents in Arrow batches; of each batch it makes
the impact-sorted list of every asked term (documents by what the term adds to their score). For an
item the lists of its terms are read round robin, a few entries further each round; documents met for
the first time are looked up in the forward index for their whole score. The threshold is the sum of
the impacts at the depth reached: no document not yet met scores more. An item is done with the
batch when the threshold falls strictly below its k-th best score, of this or an earlier batch. The k
best of all tasks are merged.

Items are a stated query set: they are searched in blocks of BLOCK_TERMS terms or so, each a pass of its
own, so that what is sent to the tasks is bounded however many items there are.

Defined results: null texts and texts without a term have none and are not counted; an item without
terms, or whose terms no document holds, has no rows; equal scores go to the smaller id, rows without an
id last; rows of documents that repeat are documents of their own; rows of items that repeat id and
text ask once, those of one id and other texts each on its own; empty tables give no rows; extra columns
are ignored.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.llm.common import materialize, query_blocks

K = 20
#: Terms of the items of a block, about: what is sent to the tasks at once.
BLOCK_TERMS = 500_000
#: Entries by which each list is read further in an item's first round; each round reads as many as all before it.
FIRST_ROUND = 16
#: What bounds a term: ASCII but for digits and letters, as the task states it (fixed value).
_ASCII_TERM = set(string.digits + string.ascii_letters)
_TABLE = bytes(ord(chr(b).lower()) if chr(b) in _ASCII_TERM else 32 for b in range(128)) + bytes(range(128, 256))
_FORWARD = "doc_id long, n long, terms array<int>, counts array<int>"
_FOUND = "query long, item_id long, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8: every byte of a character beyond ASCII belongs to one."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split(b" ") if text else []


def counts_of(text: str | None) -> Counter[bytes]:
    counts = Counter(terms_of(text))
    counts.pop(b"", None)
    return counts


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms, repeats included), and terms and counts of the vocabulary's terms in it; documents without a term are left out."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        known = number.keys()
        for batch in batches:
            kept, sizes, terms, counts, ends = [], [], [], [], [0]
            for i, text in enumerate(batch.column("text")):
                found = counts_of(text.as_py())
                if found:
                    kept.append(i)
                    sizes.append(found.total())
                    for t in found.keys() & known:
                        terms.append(number[t])
                        counts.append(found[t])
                    ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(index, _FORWARD)


class Index:
    """A batch of the forward index with its impact-sorted lists."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray) -> None:
        terms, counts = batch.column("terms"), batch.column("counts")
        self.starts = terms.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        self.terms = terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        tf = counts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = self.starts - self.starts[0]
        doc = np.repeat(np.arange(batch.num_rows), np.diff(self.starts))
        m = batch.column("m").to_numpy(zero_copy_only=False)[doc]
        self.impacts = weights[self.terms] * (1_000_000_000 * tf // (1000 * tf + 12 * m))
        order = np.lexsort((-self.impacts, self.terms))
        self.list_docs, self.list_impacts, sorted_terms = doc[order], self.impacts[order], self.terms[order]
        self.list_starts = np.searchsorted(sorted_terms, np.arange(len(weights) + 1))
        self.rows = batch.num_rows

    def lookup(self, docs: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Whole scores of documents for an item; times: how often it has each term."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[docs] - ends + sizes, sizes)
        sums = np.concatenate(([0], np.cumsum(times[self.terms[at]] * self.impacts[at])))
        return sums[ends] - sums[ends - sizes]

    def best(self, terms: np.ndarray, times: np.ndarray, keys: np.ndarray, k: int, bar: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores of the k best that reach bar, by score and key; and how many were looked up.

        terms: the item's distinct terms; times: how often it has each term of the vocabulary.
        """
        first = self.list_starts[terms]
        size = self.list_starts[terms + 1] - first
        met, docs, scores, depth, looked_up = np.zeros(self.rows, bool), np.empty(0, np.int64), np.empty(0, np.int64), 0, 0
        longest = int(size.max(initial=0))
        while depth < longest:
            reached = min(longest, max(FIRST_ROUND, 2 * depth))
            grid = np.arange(depth, reached)[None, :]
            places = (first[:, None] + grid)[grid < size[:, None]]
            depth = reached
            new = np.unique(self.list_docs[places])
            new = new[~met[new]]
            if len(new):
                met[new] = True
                looked_up += len(new)
                its = self.lookup(new, times)
                good = its >= max(bar, 1)
                docs, scores = np.concatenate((docs, new[good])), np.concatenate((scores, its[good]))
                if len(docs) > k:
                    top = np.lexsort((keys[docs], -scores))[:k]
                    docs, scores = docs[top], scores[top]
            # The impact last read of each list; a list that is read to its end adds nothing more.
            on = size > depth
            threshold = int((self.list_impacts[first[on] + depth - 1] * times[terms[on]]).sum())
            if threshold < (max(bar, int(scores.min())) if len(docs) >= k else bar):
                break
        return docs, scores, looked_up


def scan(batches: Iterator[pa.RecordBatch], items: list[tuple], weights: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k best documents of a task for each item (number, item_id, terms, times); at most k rows an item come out."""
    held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in items]
    times = np.zeros(len(weights), np.int64)
    for batch in batches:
        index = Index(batch, weights)
        ids = batch.column("doc_id")
        nameless = ids.is_null().to_numpy(zero_copy_only=False)
        keys = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        for i, (_, _, terms, repeats) in enumerate(items):
            times[terms] = repeats
            mine, theirs, none = held[i]
            docs, scores, _ = index.best(terms, times, keys, k, int(mine[-1]) if len(mine) >= k else 0)
            times[terms] = 0
            if len(docs):
                mine, theirs, none = np.concatenate((mine, scores)), np.concatenate((theirs, keys[docs])), np.concatenate((none, nameless[docs]))
                top = np.lexsort((none, theirs, -mine))[:k]
                held[i] = mine[top], theirs[top], none[top]
    counts = [len(h[0]) for h in held]
    if sum(counts):
        scores, ids, none = (np.concatenate([h[j] for h in held]) for j in range(3))
        number = np.repeat(np.array([x[0] for x in items], np.int64), counts)
        names = pa.array([x[1] for x in items], pa.int64()).take(pa.array(np.repeat(np.arange(len(items)), counts)))
        yield pa.RecordBatch.from_arrays([pa.array(number), names, pa.array(ids, mask=none), pa.array(scores)], ["query", "item_id", "doc_id", "score"])


def _search_block(docs: DataFrame, block: list[tuple], k: int) -> DataFrame:
    """query, item_id, doc_id, score of the best of every task for a block of items (number, item_id, text)."""
    spark = docs.sparkSession
    counts = [counts_of(text) for _, _, text in block]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
    forward = materialize(forward_index(docs, vocabulary), "forward-index")
    whole = forward.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    if not vocabulary or not whole.n:
        return spark.createDataFrame([], _FOUND)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=len(total))
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["term", "df"])

    partial = forward.select("terms").mapInArrow(frequencies, "term int, df long")
    weights = np.zeros(len(vocabulary), np.int64)
    for r in partial.groupBy("term").agg(F.sum("df").alias("df")).collect():  # the block's terms
        weights[r.term] = weight(whole.n, r.df)
    items = []
    for (number, item_id, _), own in zip(block, counts, strict=True):
        terms = np.array(sorted(vocabulary[t] for t in own), np.int64)
        repeats = {vocabulary[t]: c for t, c in own.items()}
        items.append((number, item_id, terms, np.array([repeats[int(t)] for t in terms], np.int64)))
    sent = spark.sparkContext.broadcast((items, weights))
    # Products of three numbers of the corpus may leave 64 bits; the quotient does not.
    m = F.lit(100 - 25) + F.expr(f"cast(25 * cast(n as decimal(19, 0)) * {whole.n}bd div {whole.l}bd as bigint)")
    scored = forward.withColumn("m", m).mapInArrow(lambda batches: scan(batches, *sent.value, k), _FOUND)
    return materialize(scored, "ranked")


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per item and rank: item_id, rank (from 1), doc_id, score, query (a number of its own for each id and text)."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null").distinct()
    size = asked.agg(F.sum(F.char_length("text")), F.count(F.lit(1))).first()
    found = spark.createDataFrame([], _FOUND)
    # Terms have two characters or so at least with what parts them.
    for block in query_blocks(asked, max(1, int(BLOCK_TERMS * 2 * size[1] / max(1, size[0] or 0)))):
        found = found.unionByName(_search_block(slim, block, k))
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score", "query")
