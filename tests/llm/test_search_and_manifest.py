"""Ranked lexical search, exact search and the Merkle manifest against plain Python; repeated queries of op2."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import ann, common, exact_search, lexical, merkle

DOCS, ITEMS, VECTORS = "doc_id long, text string", "item_id long, text string", "vec_id long, embedding array<double>"
ROWS = "doc_id long, source string, lang string, n_chars long, text string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k=20):
    """Every document scored for every item."""
    held = [(i, Counter(ts), len(ts)) for i, t in docs if (ts := terms(t))]
    n, length, df = len(held), sum(h[2] for h in held), Counter(t for h in held for t in h[1])
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, tf, size in held:
            m = 100 - 25 + 25 * size * n // length
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m)) for t, r in Counter(terms(text)).items() if t in tf)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    known = ["a", "B", "c1", "é", "Ünï", "x　y", "zz", *[f"w{i}" for i in range(40)]]
    docs = [(i if i % 50 else None, " ".join(rng.choices(known, weights=[1 / (j + 1) for j in range(len(known))], k=rng.choice([0, 1, 3, 10, 60])))) for i in range(1500)]
    docs += [(7, None), (8, ""), (9, "-- .."), (10, "w7 " * 200_000)] + [(i, "w5 W5 a") for i in range(2000, 2100)] * 2
    items = [(1, "w5 a a b"), (1, "w5 a a b"), (1, "É é"), (2, None), (None, "zz w39, w39"), (3, "nowhere"), (4, ""), (5, " ".join(known)), (6, "w7 " * 50)]
    return docs, items


def searched(docs, items, **more):
    return sorted(repr((r.item_id, r["rank"], r.doc_id, r.score)) for r in lexical.search(docs, items, **more).collect())


def test_threshold_algorithm_against_scoring_everything(spark, corpus, monkeypatch):
    docs, items = corpus
    table = spark.createDataFrame(docs, DOCS).repartition(4).withColumns({"n": F.lit(1), "terms": F.lit("x"), "query": F.lit(2)})
    asked = spark.createDataFrame(items, ITEMS).withColumn("doc_id", F.lit(1))
    want = ranked(docs, items)
    assert searched(table, asked) == want and len(want) > 60
    assert searched(table.limit(0), asked) == [] == searched(table, asked.limit(0))
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 4)  # a pass an item
    assert searched(table, asked) == want
    monkeypatch.undo()
    monkeypatch.setattr(lexical, "FIRST_ROUND", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 97)
    try:
        assert searched(table, asked) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lists_are_left_once_the_threshold_is_below_the_bar():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    counts = rng.integers(1, 50, 3000).astype(np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(np.full(3000, 100)), pa.ListArray.from_arrays(pa.array(np.arange(3001, dtype=np.int32)), pa.array(np.zeros(3000, np.int32))), pa.ListArray.from_arrays(pa.array(np.arange(3001, dtype=np.int32)), pa.array(counts))], ["m", "terms", "counts"])
    index = lexical.Index(batch, np.array([700]))
    docs, scores, met = index.best(np.array([0]), np.array([1]), np.arange(3000), 5, 0)
    assert met < 200 and sorted(scores) == sorted(700 * (1_000_000_000 * int(c) // (1000 * int(c) + 1200)) for c in sorted(counts)[-5:])
    # Of equal scores all are met, so that the smaller ids come out.
    assert sorted(docs) == sorted(sorted(range(3000), key=lambda i: (-counts[i], i))[:5])
    assert lexical.terms_of("a-B\x00É１ ß") == ["a".encode(), b"b", "É１".encode(), "ß".encode()]


def nearest(rows, k=5, every=50):
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in dict.fromkeys((i, tuple(v)) for i, v in sound):
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in sound if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def test_exact_search_against_all_products(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8) * (rng.random(8) < 0.5)]) for i in range(600)]
    rows += [(50, rows[50][1]), (50, [1.0, 0.0, 0.0]), (None, [1.0]), (700, None), (701, []), (702, [0.0] * 8), (703, [float("nan")] + [1.0] * 7), (704, [None, 1.0]), (705, [float("inf")]), (750, []), (800, [0.0])]
    rows += [(i, [1.0] * 8) for i in range(1000, 1400)]
    table = spark.createDataFrame(rows, VECTORS).repartition(5).withColumns({"id": F.lit(1), "v": F.lit("x"), "query": F.lit(2)})
    asked = table.where("vec_id % 50 = 0")
    found = lambda: sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in exact_search.search(table, asked).collect())
    assert found() == nearest(rows)
    monkeypatch.setattr(exact_search, "QUERY_BLOCK", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 61)
    try:
        assert found() == nearest(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert exact_search.search(table.limit(0), asked).count() == 0 and exact_search.search(table, asked.limit(0)).count() == 0


def test_huge_components_saturate(spark):
    rows = [(0, [1e300, 1e300]), (1, [1e300, 1e300]), (2, [-1e300, 0.0])]
    table = spark.createDataFrame(rows, VECTORS)
    got = exact_search.search(table, table.where("vec_id = 0")).collect()
    most = math.isqrt(((1 << 63) - 1) // 2) - 1
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2 * most * most), (2, -most * most)]


def test_repeated_queries_of_neighbours_ask_once(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(200)]
    rows += [rows[20], rows[20], (40, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (7, rows[7][1])]
    table = spark.createDataFrame(rows, VECTORS)
    got = ann.search(table, table.where("vec_id % 20 = 0")).collect()
    counts = Counter(r["query"] for r in got)
    assert set(counts.values()) == {20} and len(counts) == 11
    for q in counts:
        mine = sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and all(r.vec_id != r.query_id for r in mine)
        own = [v for i, v in rows if i == mine[0].query_id]
        best = min(own, key=lambda v: abs(float(np.dot(v, dict(rows)[mine[0].vec_id])) - mine[0].score))
        want = sorted(((-float(np.dot(best, v)), i) for i, v in rows if i != mine[0].query_id))[:20]
        assert [r.vec_id for r in mine] == [i for _, i in want]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def manifest(rows):
    """Trees in plain Python."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: digest("".join(map(field, (*r[:4], t))))

    def tree(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for j, a in enumerate(at):
                run = nodes[a // 16 * 16 : a // 16 * 16 + 16]
                paths[j].append((run[: a % 16], run[a % 16 + 1 :]))
                at[j] = a // 16
            nodes = [digest("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        return nodes[0], paths

    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources]
    root, above = tree([t[0] for t in trees])
    out = []
    for s, (subroot, paths), outer in zip(sources, trees, above, strict=True):
        for (_, _, own, r), path in zip(sorted(by[s], key=lambda x: x[:3]), paths, strict=True):
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            folded = leaf(r, r[4].translate(LOWER) if touched else r[4])
            for before, after in path + outer:
                folded = digest("".join([*before, folded, *after]))
            out.append((r[0], own, subroot, root, digest("".join("".join(b + a) for b, a in path + outer)), folded, folded == root))
    return sorted(map(repr, out))


def made(rows, seed=1):
    rng = random.Random(seed)
    return [(i if i % 97 else None, rng.choice([None, "", "a", "é", "Z", "hot", "hot", "hot"]), rng.choice([None, "en"]), i % 7 or None, rng.choice([None, "", "Text A", "text b", "É", "日本"])) for i in range(rows)]


@pytest.mark.parametrize("rows", [made(13_000) + made(40) + [(5, "one", None, None, "x")], [(i, f"s{i % 300}", None, None, "X") for i in range(700)], [(1, None, None, None, None)], [(i, "s", "en", 1, "T") for i in range(17)], [(3, "s", None, None, "Same Text")] * 5000])
def test_manifest_against_plain_trees(spark, monkeypatch, rows):
    monkeypatch.setattr(merkle, "BLOCK_ROWS", 3000)
    table = spark.createDataFrame(rows, ROWS).repartition(3).withColumns({"leaf": F.lit("x"), "src": F.lit(1), "pos": F.lit(2), "n": F.lit(3)})
    assert sorted(map(repr, map(tuple, merkle.manifest(table).collect()))) == manifest(rows)


def test_a_block_of_many_buckets_fits_the_engine(monkeypatch):
    """Sixteen full buckets that a hash dealt to one block, with long proofs above them; in one engine they ran out of its memory."""
    import pyarrow as pa

    n, above = 16 * merkle.BUCKET, ["0" * 960] * 4
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    block = pa.table({"src": ["=s"] * n, "bucket": [i // merkle.BUCKET for i in range(n)], "pos": range(n), "n": [n] * n, "depth": pa.array([3] * n, pa.int32()), "doc_id": range(n), "leaf": digests, "tampered": pa.array([None] * n, pa.string())})
    outer = pa.table({"src": ["=s"] * 16, "bucket": range(16), "before": [above] * 16, "after": [above] * 16, "subroot": ["s"] * 16, "root": ["r"] * 16})
    monkeypatch.setattr(merkle, "ENGINE_MEMORY", "200MB")
    assert merkle.bucket_roots(block)["bucket"].to_pylist() == list(range(16))
    got = merkle.folded(block, outer)
    assert dict(zip(got["doc_id"].to_pylist(), got["leaf"].to_pylist(), strict=True)) == dict(enumerate(digests))


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], ROWS)).count() == 0


def test_ranks_in_order_and_among_equal_rows(spark):
    rows = [("a", 5, "x")] * 4000 + [("b", None, "y"), ("b", 2, "y"), ("b", 1, "z")]
    table = spark.createDataFrame(rows, "k string, o long, p string").repartition(6)
    got = common.ordered_rank(table, ["k"], ["o", "p"], "r", "n", rows_per_range=500).collect()
    assert sorted(r.r for r in got if r.k == "a") == list(range(4000)) and [(r.o, r.r, r.n) for r in sorted(got, key=lambda r: r.r) if r.k == "b"] == [(None, 0, 3), (1, 1, 3), (2, 2, 3)]
    hot = common.global_rank(table, ["k"], [F.col("o"), F.col("p")], "r", rows_per_bucket=100)
    assert sorted(r.r for r in hot.collect() if r.k == "a") == list(range(4000))


def test_equal_rows_spread_over_the_buckets_of_a_rank(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(common, "materialize", lambda df, name, real=common.materialize: seen.append(real(df, name)) or seen[-1])
    table = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("o"))
    common.global_rank(table, [], [F.col("o")], "r").count()
    bucket = F.pmod(F.xxhash64("o", "_row"), F.lit(256))
    assert seen[0].groupBy(bucket.alias("b")).count().agg(F.max("count")).first()[0] < 60
