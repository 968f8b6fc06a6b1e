"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Each vector is rotated by a random orthonormal frame into BITS dimensions; its code keeps one sign
bit for each, packed into words, with two correction scalars: the vector's length and the cosine
between the rotated vector and its code. A rotated query is rounded to four bits a dimension, so its
inner product with a code is a weighted count of the bits that the code shares with four bit planes.
From these and the scalars the inner product of the vectors is estimated with an error bound.

A query's bar is the K-th best score that it is sure to reach: first within a bounded sample of the
rows, then within all that a task has reranked so far. A task reranks, on the original vectors and in
double precision, exactly those rows whose upper bound reaches the bar; the best K of all tasks are
the answer. The sample sets only where the bar begins: every row is coded, estimated and bounded.

Queries are a stated set and meet all rows in blocks: each block of queries is sent to the tasks that
read the coded rows, which are written once and neither copied nor shuffled for it. A task holds one
block of queries, a batch of rows and K results a query; work grows with rows times queries and nothing else.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows
without an id, take no part, and neither do vectors of another length than the commonest (of equally
common ones, the smallest); ties go to the smaller id; rows that repeat are candidates
as often as they come; queries that repeat id and vector ask once, those of one id and different vectors
each on its own (told apart by ``query``), and none has rows of its own id as candidates; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.llm.common import materialize, query_blocks

K = 20
BITS = 256
SEED = 20240601
#: Multiple of the standard error that bounds an estimate.
EPSILON = 3.2
#: Bit planes of a rounded query.
PLANES = 4
#: Queries sent to tasks at once, and rows of a task (fewer where all cores would else not be used).
QUERY_BLOCK, ROW_BLOCK = 4096, 65_536
#: Rows, chosen by a hash, from which the first bars come (a bound that the task allows).
SAMPLE_ROWS = 16_384
#: Queries and rows that are estimated at a time.
_TILE = (64, 2048)
_SLACK = 1e-9
_FOUND = "query long, query_id long, vec_id long, score double, n_reranked long"


def frame(dimensions: int, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """dimensions x bits with orthonormal rows: a random rotation of the zero-padded space."""
    bits = max(bits, -(-dimensions // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dimensions)))
    return (q * np.sign(np.diag(r))).T.astype(np.float64)


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    return np.packbits(bits, axis=-1).view(np.uint64)


def encode(vectors: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths, and cosines between rotated vectors and their codes."""
    lengths = np.linalg.norm(vectors, axis=1)
    turned = (vectors / lengths[:, None]) @ rotation
    return pack(turned > 0), lengths, np.abs(turned).sum(1) / np.sqrt(rotation.shape[1])


class Rounded:
    """Rotated queries rounded to PLANES bits a dimension between each one's least and largest entry."""

    def __init__(self, queries: np.ndarray, rotation: np.ndarray) -> None:
        turned = queries @ rotation
        self.bits = rotation.shape[1]
        self.size = np.linalg.norm(queries, axis=1)
        self.low = turned.min(1)
        step = (turned.max(1) - self.low) / ((1 << PLANES) - 1)
        self.step = np.where(step > 0, step, 1.0)
        levels = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.total = self.low * self.bits + self.step * levels.sum(1)
        self.planes = [pack(levels >> p & 1 == 1) for p in range(PLANES)]

    def shared(self, codes: np.ndarray, part: slice) -> np.ndarray:
        """Sum of a query's levels over the set bits of a code, for queries of part and all codes."""
        out = np.zeros((self.size[part].size, len(codes)), np.uint32)
        for p, plane in enumerate(self.planes):
            words = plane[part]
            count = np.zeros(out.shape, np.uint16)
            for w in range(codes.shape[1]):
                count += np.bitwise_count(words[:, w, None] & codes[None, :, w])
            out += count.astype(np.uint32) << p
        return out

    def estimate(self, codes: np.ndarray, set_bits: np.ndarray, lengths: np.ndarray, cosines: np.ndarray, part: slice = slice(None), epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products (queries x rows) and their error bounds."""
        f = np.float32
        root = np.sqrt(self.bits)
        scale = (lengths / cosines / root).astype(f)
        # <query, code> with code entries +-1/sqrt(bits): twice what lies on set bits, less the whole.
        dots = self.shared(codes, part) * (2 * self.step[part]).astype(f)[:, None]
        dots += (2 * self.low[part]).astype(f)[:, None] * set_bits.astype(f)
        dots -= self.total[part].astype(f)[:, None]
        dots *= scale
        angle = lengths * np.sqrt(np.maximum(1 / cosines**2 - 1, 0)) * epsilon / np.sqrt(max(1, self.bits - 1))
        rounding = epsilon / np.sqrt(12) * lengths / cosines
        return dots, self.size[part].astype(f)[:, None] * angle.astype(f) + self.step[part].astype(f)[:, None] * rounding.astype(f)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed in order of the components."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def _usable(embedding: Column) -> Column:
    sound = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & sound & F.exists(embedding, lambda x: x != 0)


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(b, np.float64) for b in column])


class Best:
    """The k best rows so far for each query of a block (arrays ids, vectors and bars), and how many rows each had reranked."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bars: np.ndarray, rotation: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.bars, self.k = ids, vectors, bars.astype(np.float64), k
        self.rounded = Rounded(vectors, rotation)
        self.reranked = np.zeros(len(ids), np.int64)
        self.q, self.found, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, lengths: np.ndarray, cosines: np.ndarray) -> None:
        """Estimate all rows for all queries, rerank those whose upper bound reaches the bar, and raise the bars."""
        set_bits = np.bitwise_count(codes).sum(1)
        out = [(self.q, self.found, self.scores)]
        for at in range(0, len(self.ids), _TILE[0]):
            part = slice(at, min(len(self.ids), at + _TILE[0]))
            bar, asked, size = self.bars[part], self.vectors[part], self.rounded.size[part].astype(np.float32)
            for lo in range(0, len(ids), _TILE[1]):
                tile = slice(lo, lo + _TILE[1])
                guess, error = self.rounded.estimate(codes[tile], set_bits[tile], lengths[tile], cosines[tile], part)
                guess += error
                i, j = np.nonzero(guess >= bar.astype(np.float32)[:, None] - np.float32(1e-6) * size[:, None])
                j += lo
                other = self.ids[part][i] != ids[j]
                i, j = i[other], j[other]
                self.reranked[part] += np.bincount(i, minlength=len(asked))
                scores = inner(asked[i], vectors[j])
                keep = scores >= bar[i]
                i, j, scores = i[keep], j[keep], scores[keep]
                out.append((i + at, ids[j], scores))
                # What k rows of this tile reach, the bar rises to.
                order = np.lexsort((-scores, i))
                place = np.arange(len(i)) - np.searchsorted(i[order], i[order])
                full = order[place == self.k - 1]
                bar[i[full]] = np.maximum(bar[i[full]], scores[full] - _SLACK * np.abs(scores[full]))
        q, found, scores = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((found, -scores, q))
        order = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < self.k]
        self.q, self.found, self.scores = q[order], found[order], scores[order]
        last = np.nonzero(np.arange(len(self.q)) - np.searchsorted(self.q, self.q) == self.k - 1)[0]
        self.bars[self.q[last]] = np.maximum(self.bars[self.q[last]], self.scores[last] - _SLACK * np.abs(self.scores[last]))


def search(rows: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per query and rank: query_id, rank (from 1), vec_id, score, n_reranked (by the row's task), query (a number of its own for each id and vector)."""
    spark = rows.sparkSession

    def sound(df: DataFrame) -> DataFrame:
        cast = F.col(vector_col).cast("array<double>")
        return df.select(F.col(id_col).cast("long").alias("id"), cast.alias("v")).where(F.col("id").isNotNull() & _usable(F.col("v")))

    base = sound(rows)
    shape = base.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, n_reranked long, query long")
    base, asked = base.where(F.size("v") == shape.d), sound(queries).where(F.size("v") == shape.d)
    rotation = frame(shape.d)

    # About SAMPLE_ROWS rows by a hash of their ids; the limit bounds what ids that repeat could add.
    share = int(min(1.0, SAMPLE_ROWS / shape.n) * 1_000_000)
    chosen = base.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1_000_000)) < share).limit(2 * SAMPLE_ROWS).toPandas()
    sample_ids = chosen["id"].to_numpy(np.int64)
    sample = np.stack(chosen["v"].to_list()).astype(np.float64) if len(chosen) else np.empty((0, shape.d))
    sent = spark.sparkContext.broadcast((rotation, sample_ids, sample))

    def bytes_of(vectors: np.ndarray) -> list[bytes]:
        return [v.tobytes() for v in vectors]

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                vectors = np.stack(pdf["v"].to_list()).astype(np.float64)
                codes, lengths, cosines = encode(vectors, sent.value[0])
                yield pd.DataFrame({"id": pdf["id"], "v": bytes_of(vectors), "code": bytes_of(codes), "length": lengths, "cosine": cosines})

    def barred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, its_ids, its_vectors = sent.value
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                vectors, own = np.stack(part["v"].to_list()).astype(np.float64), part["id"].to_numpy()
                bar = np.full(len(part), -np.inf)
                if len(its_ids) > k:
                    scores = vectors.astype(np.float32) @ its_vectors.T.astype(np.float32)
                    q, r = np.nonzero(np.isin(own, its_ids)[:, None] & (own[:, None] == its_ids))
                    scores[q, r] = -np.inf
                    bar = np.partition(scores, -k, axis=1)[:, -k].astype(np.float64)
                    bar -= 1e-5 * np.linalg.norm(vectors, axis=1) * np.linalg.norm(its_vectors, axis=1).max()  # what single precision may be off
                yield pd.DataFrame({"id": own, "v": bytes_of(vectors), "bar": bar})

    # Codes are written once, dealt round robin so that equal rows spread too; each block of queries reads them where they lie.
    parts = max(spark.sparkContext.defaultParallelism, -(-shape.n // ROW_BLOCK))
    codes = materialize(base.repartition(parts).mapInPandas(coded, "id long, v binary, code binary, length double, cosine double"), "codes")
    found = spark.createDataFrame([], _FOUND)
    for block in query_blocks(asked.mapInPandas(barred, "id long, v binary, bar double"), QUERY_BLOCK):
        number, ids, vectors, bars = zip(*block, strict=True)
        near = spark.sparkContext.broadcast((np.array(number), np.array(ids), np.stack([np.frombuffer(v, np.float64) for v in vectors]), np.array(bars)))

        def scan(batches: Iterator[pd.DataFrame], near=near) -> Iterator[pd.DataFrame]:
            numbers, *queries = near.value
            best = Best(*queries, sent.value[0], k)
            for pdf in batches:
                if len(pdf):
                    best.add(pdf["id"].to_numpy(), _vectors(pdf["v"]), np.stack([np.frombuffer(c, np.uint64) for c in pdf["code"]]), pdf["length"].to_numpy(), pdf["cosine"].to_numpy())
            if len(best.q):
                yield pd.DataFrame({"query": numbers[best.q], "query_id": best.ids[best.q], "vec_id": best.found, "score": best.scores, "n_reranked": best.reranked[best.q]})

        found = found.unionByName(materialize(codes.mapInPandas(scan, _FOUND), "nearest"))
        near.unpersist()
    # -0.0 and 0.0 compare equal; ids break all ties.
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "n_reranked", "query")
