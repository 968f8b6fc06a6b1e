"""License scans, decontamination and mixing against plain Python; the pipeline stage by stage."""

import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from waymark.llm import decontaminate, license_scan, mixing, queries

DOCS = "doc_id long, text string"
NO_WORD = re.compile(r"[\W_]+")


def words(text):
    return [w for w in NO_WORD.split((text or "").lower()) if w]


def shingles(ws, n=5):
    return [tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)]


def prose(rng, n):
    return ["".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(n)]


def planted(seed, passages):
    """Documents with passages whole, with a word changed, cut in half, twice, and without any."""
    rng, rows = random.Random(seed), []
    for name, passage in passages:
        ws = passage.split()
        for kind in ("whole", "changed", "half", "twice", "start", "end"):
            inner = list(ws)
            if kind == "changed":
                inner[len(inner) // 2] = "zzz"
            if kind == "half":
                inner = inner[: len(inner) // 2]
            before, after = prose(rng, 0 if kind == "start" else rng.randint(1, 200)), prose(rng, 0 if kind == "end" else rng.randint(1, 200))
            rows.append((name, kind, " ".join([*before, *inner, *(prose(rng, 30) + inner if kind == "twice" else []), *after])))
    rows += [(None, "clean", " ".join(prose(rng, rng.choice([0, 1, 4, 300])))) for _ in range(20)] + [(None, "clean", None), (None, "clean", " ".join(prose(rng, 30_000)))]
    return rows


def test_license_scan_against_containment(spark, monkeypatch):
    rows = planted(2, list(license_scan.TEMPLATES.items()))
    docs = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(rows)], DOCS).withColumns({"license": F.lit("x"), "window": F.lit(1)})
    got = {(r.doc_id, r.license): r.containment for r in license_scan.scan(docs, license_scan.templates(spark)).collect()}
    known = {k: set(shingles(words(t))) for k, t in license_scan.TEMPLATES.items()}
    longest = {k: len(words(t)) for k, t in license_scan.TEMPLATES.items()}
    for i, (_, _, text) in enumerate(rows):
        own = shingles(words(text))
        everything = set(own)
        for k, template in known.items():
            if len(everything & template) < 0.8 * len(template):
                assert (i, k) not in got
                continue
            n = longest[k] - 4
            best = max(len(set(own[at : at + n]) & template) / len(template) for at in range(max(1, len(own) - n + 1)))
            if best >= 0.8:
                assert got[(i, k)] >= best - 1e-9
    assert all(any(i == d for d, _ in got) for i, (_, kind, _) in enumerate(rows) if kind in ("whole", "twice", "start", "end"))
    monkeypatch.setattr(license_scan, "BROADCAST_ROWS", 10)  # the way for templates too many to broadcast
    assert {(r.doc_id, r.license): r.containment for r in license_scan.scan(docs, license_scan.templates(spark)).collect()} == got
    assert license_scan.scan(docs.limit(0), license_scan.templates(spark)).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan(docs, license_scan.templates(spark, {"short": "two words"}))


def items(seed=4):
    rng = random.Random(seed)
    return [(100 + k, " ".join(prose(rng, n))) for k, n in enumerate([5, 8, 12, 20, 40, 80])] + [(200, "too short"), (201, None)]


def naive_leaks(docs, bench):
    items = {i: words(t) for i, t in bench if len(words(t)) >= 5}
    df = Counter(s for ws in items.values() for s in set(shingles(ws)))
    weight = lambda s: max(1, math.floor(1000 * math.log((len(items) + 1) / df[s]) / math.log(len(items) + 1) + 0.5)) if s in df else 1000
    found = set()
    for d, text in docs:
        ws = words(text)
        for i, item in items.items():
            b = set(shingles(item))
            for at in range(max(1, len(ws) - len(item) + 1)):
                a = set(shingles(ws[at : at + len(item)]))
                if a & b and sum(map(weight, a & b)) >= 0.8 * sum(map(weight, a | b)):
                    found.add((d, i))
    return found


def test_decontamination_against_brute_force(spark):
    bench = items()
    rows = [(i, t) for i, (_, _, t) in enumerate(planted(6, [(i, t) for i, t in bench if t and i < 200]))]
    rows += [(500, bench[3][1]), (500, bench[3][1]), (None, bench[4][1])]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"item_id": F.lit("x"), "words": F.lit(1), "n": F.lit(0)})
    table = spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit(3))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, table).collect()}
    assert got == naive_leaks(rows, bench)
    kept = decontaminate.clean(docs, table)
    bad = {d for d, _ in got}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _ in rows if d not in bad) and kept.columns == docs.columns
    assert decontaminate.leaks(docs.limit(0), table).count() == decontaminate.leaks(docs, table.limit(0)).count() == 0
    assert decontaminate.clean(docs, table.limit(0)).count() == len(rows)


def _words_of(bits):
    return [(w + (1 << 63)) % (1 << 64) - (1 << 63) for w in (bits >> 64 * k & (1 << 64) - 1 for k in range(decontaminate.WORDS))]


def test_fingerprint_blocks_meet_within_the_radius_and_seldom_else(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        a = rng.getrandbits(256)
        b = rng.getrandbits(256)
        if i < 200:
            b = a
            for k in rng.sample(range(256), decontaminate.RADIUS):
                b ^= 1 << k
        rows.append((i, _words_of(a), _words_of(b)))
    table = spark.createDataFrame(rows, "i long, a array<long>, b array<long>").repartition(8)
    got = table.select("i", decontaminate._apart("a", "b").alias("apart"), F.size(F.array_intersect(decontaminate._blocks("a"), decontaminate._variants("b"))).alias("met")).collect()
    assert all(r.met and r.apart == decontaminate.RADIUS for r in got if r.i < 200)
    assert sum(r.met for r in got if r.i >= 200) < 0.25 * 200  # rows of a join, of unrelated pairs


def test_weighted_fingerprint(spark):
    rng = random.Random(10)
    rows = [(i, rng.getrandbits(64) - (1 << 63), rng.randint(1, 1000)) for i, n in enumerate((1, 2, 11, 60)) for _ in range(n)]
    each = spark.createDataFrame(rows, "i long, shingle long, weight long")
    sums = each.groupBy("i").agg(F.sum("weight").alias("total"), *decontaminate.bit_sums("shingle", "weight"))
    got = {r.i: r.fp for r in sums.select("i", decontaminate.fingerprint("total").alias("fp")).collect()}
    hashes = {r.shingle: [r.shingle, r.h1, r.h2, r.h3] for r in each.select("shingle", *[F.xxhash64("shingle", F.lit(k)).alias(f"h{k}") for k in (1, 2, 3)]).collect()}
    for i in range(4):
        own = [(h, w) for j, h, w in rows if j == i]
        for k in range(4):
            assert got[i][k] % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum(w for h, w in own if hashes[h][k] >> b & 1) > sum(w for _, w in own))


def test_decontamination_without_broadcasts_and_with_odd_items(spark, monkeypatch):
    bench = [(1, "a b c d e f g h"), (2, "A b, c d e f g h!"), (None, "k l m n o p q"), (4, ""), (5, None)]
    docs = spark.createDataFrame([(1, "x y a b c d e f g h z"), (2, "a b c d e f g h"), (3, "k l m n o p q"), (4, None), (5, "k l m n o p")], DOCS)
    table = spark.createDataFrame(bench, "item_id long, text string")
    want = {(1, 1), (1, 2), (2, 1), (2, 2), (3, None)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, table).collect()} == want
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 2)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, table).collect()} == want


def test_rates_meet_the_targets(spark):
    rng = random.Random(1)
    rows = [(i, 10 + rng.randrange(200), 1, [p, 1 - p]) for i in range(300) for p in [rng.random()]] + [(999, 0, 1, [0.5, 0.5])]
    members = spark.createDataFrame(rows, "doc_id long, n_tokens long, copies long, p array<double>")
    now = [sum(n * p[k] for _, n, _, p in rows) for k in (0, 1)]
    targets = [1.2 * now[0], 0.7 * now[1]]
    got = mixing.fit_rates(members, targets).collect()
    assert all(r.rate >= 0 for r in got) and len(got) == len(rows)
    for k in (0, 1):
        assert abs(sum(r.rate * r.n_tokens * r.p[k] for r in got) / targets[k] - 1) < 0.01
    # Nonnegativity binds: nothing of the second domain is wanted, and rates stop at 0.
    rows = [(i, 100, 1, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(20)]
    got = mixing.fit_rates(spark.createDataFrame(rows, "doc_id long, n_tokens long, copies long, p array<double>"), [1000.0, -500.0]).collect()
    assert {r.rate for r in got if r.p[1]} == {0.0} and all(abs(r.rate - 1) < 1e-6 for r in got if r.p[0])


def labelled_corpus(seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(600):
        domain = "toxic" if i % 10 == 0 else "low" if i % 3 == 0 else "high"
        ws = prose(rng, 60) + (["vilexx"] * 4 if domain == "toxic" else ["$$$", "!!!"] * 6 if domain == "low" else ["indeed."])
        rng.shuffle(ws)
        docs.append((i, " ".join(ws)))
        if i % 2:
            continue
        labels.append((i, int(domain == "high"), int(domain == "toxic")))
    return docs, labels


def test_mixing(spark):
    docs, labels = labelled_corpus()
    table = spark.createDataFrame(docs + [(900, None), (901, ""), (None, "no id"), (5, docs[5][1])], DOCS).withColumns({"rate": F.lit("x"), "text_hash": F.lit(1)})
    marks = spark.createDataFrame(labels + [(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int").select("doc_id", mixing.labelled_domain(F.col("quality"), F.col("toxic")).alias("domain"))
    got = {r.doc_id: r for r in mixing.mix(table, marks, queries.target_shares(spark), keep="high").collect()}
    assert len(got) == 603 and got[900].n_tokens == got[901].n_tokens == 0 and got[5].copies == 2
    for i, t in docs:
        assert got[i].n_tokens == len(t.split())
        assert abs(got[i].p_high + got[i].p_low + got[i].p_toxic - 1) < 1e-9
    toxic = [got[i] for i in range(0, 600, 10)]
    assert sum(r.p_toxic > 0.5 for r in toxic) >= 0.9 * len(toxic)
    assert all(r.draws in (math.floor(r.rate), math.floor(r.rate) + 1) for r in got.values())
    kept = mixing.mixed(table, marks, queries.target_shares(spark), keep="high")
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i in [*range(600), 5, 900, 901, None] if got[i].draws) and kept.columns == table.columns
    assert mixing.mix(table, marks.limit(0), queries.target_shares(spark), keep="high").count() == 603
    assert mixing.mix(table.limit(0), marks, queries.target_shares(spark), keep="high").count() == 0


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no tables here")
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontaminate", "mix", "shard"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, SMALL).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
        assert ids(after) <= ids(before)
        if name == "shard":
            assert ids(after) == ids(before)
        else:
            assert after.columns == docs.columns
        if name == "language_id":
            lost = before.join(after, "doc_id", "left_anti").collect()
            assert not any(any(c.isalpha() for c in r.text or "") for r in lost)
        if name == "decontaminate":
            texts = [(r.doc_id, r.text) for r in before.collect()]
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            assert ids(before) - ids(after) == {d for d, _ in quick_leaks(texts, bench)}
        before = after


def quick_leaks(docs, bench):
    """naive_leaks() over documents that share a shingle with the benchmark; others cannot match."""
    known = {s for _, t in bench for s in shingles(words(t))}
    return naive_leaks([(d, t) for d, t in docs if known & set(shingles(words(t)))], bench)
