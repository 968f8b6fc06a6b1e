"""Moves between full shards."""

import random
from collections import Counter, defaultdict

from test_simhash_sharding import DOCS

from waymark.llm import sharding


def test_admissible_moves_keep_room_and_leave_no_cycle():
    rng = random.Random(2)
    for _ in range(50):
        asked = {(a, b): rng.randint(1, 9) for a in range(8) for b in range(8) if a != b and rng.random() < 0.4}
        room = [rng.choice([0, 0, 3]) for _ in range(8)]
        given = sharding.admissible(asked, room)
        assert all(0 < n <= asked[e] for e, n in given.items())
        gain = [sum(n for (_, b), n in given.items() if b == j) - sum(n for (a, _), n in given.items() if a == j) for j in range(8)]
        assert all(g <= r for g, r in zip(gain, room, strict=True))
        left = {e: n - given.get(e, 0) for e, n in asked.items()}
        assert not sharding.admissible({e: n for e, n in left.items() if n}, [max(0, r - g) for r, g in zip(room, gain, strict=True)])
    assert sharding.admissible({(0, 1): 5, (1, 2): 3, (2, 0): 4}, [0, 0, 0]) == {(0, 1): 3, (1, 2): 3, (2, 0): 3}


def test_pairs_meet_where_every_row_is_linked(spark):
    texts = [f"pair {i // 2}" for i in range(4000)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = sharding.assign(docs, shards=8).collect()
    assert set(Counter(r.shard for r in got).values()) == {500}
    homes = defaultdict(set)
    for r in got:
        homes[texts[r.doc_id]].add(r.shard)
    assert sum(len(h) == 1 for h in homes.values()) >= 0.95 * len(homes)
