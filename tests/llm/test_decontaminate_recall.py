"""Perturbed benchmark items against a brute-force weighted Jaccard similarity."""

import random

from test_text_matching import DOCS, naive_leaks, prose

from waymark.llm import decontaminate


def perturbed(seed=12):
    """Items of 15 to 59 words and documents that hold them with few words changed, put in or left out."""
    rng = random.Random(seed)
    bench = [(i, " ".join(prose(rng, rng.randint(15, 59)))) for i in range(40)]
    docs = []
    for _, text in bench:
        ws = text.split()
        m = len(ws)
        for kind in range(7):
            inner = list(ws)
            if kind == 0:
                inner[-1] = "zzz"
            elif kind == 1:
                inner[0] = "zzz"
            elif kind == 2:
                inner[-2:] = ["zzz", "yyy"]
            elif kind == 3:
                inner[m // 2 : m // 2] = ["zzz"]
            elif kind == 4:
                del inner[rng.randrange(m)]
            elif kind == 5:
                inner[2:2] = ["zzz", "yyy"]
            else:
                inner[-1:] = []
            tail = [] if kind == 6 else prose(rng, 40)
            docs.append((len(docs), " ".join([*prose(rng, 40), *inner, *tail])))
    return bench, docs


def test_no_similar_window_is_lost(spark):
    bench, docs = perturbed()
    want = naive_leaks(docs, bench)
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert len(want) > 150 and want <= got
    assert all(i == d // 7 for d, i in got)  # and nothing that was not put there
