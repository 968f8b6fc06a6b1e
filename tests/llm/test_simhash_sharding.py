"""SimHash groups and shards against plain Python."""

import random
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from waymark.llm import sharding, simhash_dedup
from waymark.llm.common import components, global_rank

DOCS = "doc_id long, text string"


def naive_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_roots(prints):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if a < b and bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def corpus(seed=5):
    rng = random.Random(seed)
    texts = []
    for _ in range(25):
        words = ["".join(rng.choices("abcdefÉß", k=4)) for _ in range(rng.choice([1, 2, 3, 60, 200]))]
        texts.append(" ".join(words))
        for _ in range(3):
            if len(words) > 50:
                other = list(words)
                other[rng.randrange(len(other))] = "changed"
                texts.append(" ".join(other))
    texts += [None, "", " \t\n", texts[3].upper(), "A B", "word " * 5000] + [texts[0]] * 30
    return list(enumerate(texts, 10))


def test_fingerprints_and_components(spark):
    rows = corpus()
    got = simhash_dedup.near_duplicates(spark.createDataFrame(rows, DOCS).withColumns({"fp": F.lit(1), "root": F.lit("x")})).collect()
    prints = {i: naive_print(t) for i, t in rows}
    roots = naive_roots(sorted(set(prints.values())))
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(i, least.get(roots[p], i))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{p:016x}", least[roots[p]]) for i, p in prints.items()}
    assert len(got) == len(rows)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_are_whole_in_small_and_in_hot_variants(spark, monkeypatch):
    rng = random.Random(11)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(12):
            x = base
            for _ in range(rng.choice([0, 1, 2, 2, 3])):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints |= {0, 1 << 63, (1 << 64) - 1, ((1 << 64) - 1) ^ 3}
    want = {tuple(sorted((signed(a), signed(b)))) for a in prints for b in prints if a != b and bin(a ^ b).count("1") <= 2}
    table = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    for hot in (256, 2):
        monkeypatch.setattr(simhash_dedup, "HOT_VARIANT", hot)
        assert {(r.u, r.v) for r in simhash_dedup.links(table).collect()} == want


def test_keep_one(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows + [(None, "a text of its own that is long enough"), (None, "a text of its own that is long enough")], DOCS).withColumns({"rank": F.lit(1), "row": F.lit("x"), "fp": F.lit(2)})
    kept = simhash_dedup.keep_one(docs)
    ids = [r.doc_id for r in kept.collect()]
    groups = {r.component_id for r in simhash_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert Counter(ids) == Counter([*groups, None]) and kept.columns == docs.columns
    mapped = docs.withColumns({"m": F.create_map(F.lit("k"), F.col("doc_id")), "a.b": F.lit(1)}).unionByName(docs.withColumns({"m": F.create_map(F.lit("k"), F.col("doc_id")), "a.b": F.lit(1)}))
    again = simhash_dedup.keep_one(mapped)
    assert Counter(r.doc_id for r in again.collect()) == Counter(ids) and again.columns == mapped.columns


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert simhash_dedup.near_duplicates(none).count() == simhash_dedup.keep_one(none).count() == sharding.assign(none).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 60 + i) for i in range(30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(31)} | {50: 50} | {60 + i: 50 for i in range(30)}


def test_global_rank_is_gapless(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    got = global_rank(rows, ["k"], [F.col("id")], "n", rows_per_bucket=50).collect()
    by = defaultdict(list)
    for r in got:
        by[r.k].append(r.n)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(got) == 1000


def test_shards(spark):
    rng = random.Random(3)
    texts = [f"group {g}" for g in range(40) for _ in range(rng.randint(2, 5))] + ["all alike"] * 300 + [f"alone {i} é" for i in range(200)] + [None, "", ""]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "alone null id")], DOCS).withColumns({"shard": F.lit("x"), "group": F.lit(1), "size": F.lit(0)})
    got = sharding.assign(docs).collect()
    n = len(texts) + 1
    assert len(got) == n and {r.law for r in got} == {"rows"}
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        text = (texts[r.doc_id] or "") if r.doc_id is not None else "alone null id"
        assert (r.size, r.text_crc32, r.grown_shard) == (len(text.encode()) + 16, zlib.crc32(text.encode()), None)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    homes = defaultdict(set)
    for r in got:
        if r.doc_id is not None and (texts[r.doc_id] or "").startswith("group"):
            homes[texts[r.doc_id]].add(r.shard)
    assert sum(len(h) == 1 for h in homes.values()) >= 0.8 * len(homes)
    alike = Counter(r.shard for r in got if r.doc_id is not None and texts[r.doc_id] == "all alike")
    assert len(alike) <= 40 and sum(alike.values()) == 300
