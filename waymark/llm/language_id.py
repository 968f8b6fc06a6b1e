"""Language identification with hyperdimensional profiles.

Each letter, a code point, has a random +-1 vector of its own, drawn from the code point alone; so has
the gap between words. An n-gram's vector binds its letters' vectors, permuted (rotated) by their
place, by element-wise product; a text's vector bundles its n-grams by addition; a
language's prototype bundles its training texts, each at unit length. A text takes the language
whose prototype, with the mean prototype taken off, has the largest cosine with it.

Defined results: null, empty and letterless texts are ``und`` with score 0; rows repeat as they
come; equal cosines go to the language first in order; an empty table gives no rows; with nothing
to learn from every text is ``und``; a text that repeats within a language is learned from once;
columns of docs named as those added are replaced, others stay whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
N = 3
SEED = 20240229
#: Training takes this many labelled rows a language at most (a bound that the task allows).
TRAINING_ROWS = 4_000
_BATCH_CHARS = 1 << 20


#: Bits of a code point in an n-gram's code.
_POINT_BITS = 21
_LETTERS: np.ndarray | None = None


def _letters(points: np.ndarray) -> np.ndarray:
    """Lower-case code points as they are where they are letters, else 0, the gap."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([chr(cp).isalpha() for cp in range(1 << 16)])
    is_letter = _LETTERS[np.minimum(points, 0xFFFF)]
    if (high := points > 0xFFFF).any():
        is_letter[high] = [chr(p).isalpha() for p in points[high]]
    return np.where(is_letter, points, 0).astype(np.int64)


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """A random +-1 vector for each code point (0, the gap, has one too): the bits of a mixed counter (splitmix64)."""
    with np.errstate(over="ignore"):
        counter = points.astype(np.uint64)[:, None] * np.uint64(DIMENSIONS // 64) + np.arange(DIMENSIONS // 64, dtype=np.uint64)
        z = (counter + np.uint64(SEED)) * np.uint64(0x9E3779B97F4A7C15)  # fixed values of splitmix64
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return np.unpackbits(z.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def _gram_counts(text: str, block: int = _BATCH_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """The text's n-gram codes and their counts, with single gaps between words and at both ends.

    Blocks bound the memory; the last N - 1 letters go over into the next block, so their size
    changes nothing.
    """
    codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    lower = text.lower()
    carried = np.zeros(1, np.int64)
    for at in range(0, len(lower) or 1, block):
        points = np.frombuffer(lower[at : at + block].encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.concatenate((carried, _letters(points), np.zeros(int(at + block >= len(lower)), np.int64)))
        gap = c == 0
        c = c[~(gap & np.concatenate(([False], gap[:-1])))]
        carried = c[1 - N :]
        if len(c) < N:
            continue
        got, n = np.unique((c[:-2] << 2 * _POINT_BITS) + (c[1:-1] << _POINT_BITS) + c[2:], return_counts=True)
        if not len(codes):
            codes, counts = got, n
        else:
            codes, back = np.unique(np.concatenate((codes, got)), return_inverse=True)
            counts = np.bincount(back, np.concatenate((counts, n))).astype(np.int64)
    return codes, counts


def _gram_vectors(codes: np.ndarray) -> np.ndarray:
    whole = (1 << _POINT_BITS) - 1
    own, at = np.unique(np.stack([codes >> 2 * _POINT_BITS, codes >> _POINT_BITS & whole, codes & whole]), return_inverse=True)
    letters = letter_vectors(own)
    a, b, c = at.reshape(3, -1)
    return np.roll(letters, 2, 1)[a] * np.roll(letters, 1, 1)[b] * letters[c]


def bundle(texts: list[str | None]) -> np.ndarray:
    """One unit-length row for each text; a row of zeros for a text without letters."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    at = 0
    while at < len(texts):
        grams, chars, end = [], 0, at
        while end < len(texts) and chars < _BATCH_CHARS and end - at < 256:
            grams.append(_gram_counts(texts[end] or ""))
            chars += len(texts[end] or "")
            end += 1
        codes = np.unique(np.concatenate([g for g, _ in grams]))
        for lo in range(0, len(codes), 8192):  # bounds the vectors at 8192 x DIMENSIONS
            part = codes[lo : lo + 8192]
            weights = np.zeros((end - at, len(part)), np.float32)
            for i, (g, n) in enumerate(grams):
                s, e = np.searchsorted(g, (part[0], part[-1] + 1))
                weights[i, np.searchsorted(part, g[s:e])] = n[s:e]
            out[at:end] += weights @ _gram_vectors(part).astype(np.float32)
        at = end
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows_per_language: int = TRAINING_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, from at most about rows_per_language distinct texts of each.

    Rows are chosen by a hash of their text, so every task agrees on them. What reaches the driver and
    later every task is a vector a language, 4 KB: as many as there are language names in the column.
    """
    known = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, DIMENSIONS), np.float32)
    shares = labelled.sparkSession.createDataFrame([(k, min(1.0, rows_per_language / sizes[k])) for k in langs], "lang string, share double")
    chosen = known.join(F.broadcast(shares), "lang").where((F.pmod(F.xxhash64("text"), F.lit(1_000_000)) + 0.0) < F.col("share") * 1_000_000).select("text", "lang").distinct()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                total[lang] = total.get(lang, 0) + bundle(list(texts)).sum(0, dtype=np.float64)
        if total:
            yield pd.DataFrame({"lang": list(total), "vector": [v.tolist() for v in total.values()]})

    parts = chosen.mapInPandas(partial, "lang string, vector array<double>")
    sums = parts.select("lang", F.posexplode("vector").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x"))
    prototypes = np.zeros((len(langs), DIMENSIONS))
    place = {k: i for i, k in enumerate(langs)}
    for r in sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v")).collect():  # a row a language
        prototypes[place[r.lang]] = [x.x for x in r.v]
    return langs, _centred(prototypes)


def _centred(prototypes: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
    unit = prototypes / np.where(norms > 0, norms, 1)
    if len(unit) > 1:
        unit = unit - unit.mean(0)
    norms = np.linalg.norm(unit, axis=1, keepdims=True)
    return (unit / np.where(norms > 0, norms, 1)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """All columns of docs with lang_pred and score added (replacing columns of those names)."""
    langs, prototypes = model
    names = np.array([*langs, "und"], dtype=object)

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        best, score = np.full(len(texts), len(langs)), np.zeros(len(texts))
        rows = list(texts)
        for at in range(0, len(rows), 256):
            vectors = bundle(rows[at : at + 256])
            if langs:
                cosines = vectors @ prototypes.T
                found = vectors.any(1)
                best[at : at + 256] = np.where(found, cosines.argmax(1), len(langs))
                score[at : at + 256] = np.where(found, np.clip(cosines.max(1), 0, 1), 0)
        return pd.DataFrame({"lang_pred": names[best], "score": score})

    taken = {c.lower() for c in docs.columns}
    name = next(n for i in count() if (n := f"_language{i}") not in taken)
    got = docs.withColumn(name, of(F.col(text_col)))
    kept = [docs[c] for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return got.select(*kept, F.col(f"{name}.lang_pred").alias("lang_pred"), F.col(f"{name}.score").alias("score"))
