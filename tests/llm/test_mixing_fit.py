"""Rates of rare domains."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_matching import DOCS, labelled_corpus

from waymark.llm import mixing

MEMBERS = "doc_id long, n_tokens long, copies long, p array<double>"


@pytest.mark.parametrize("rare", [1, 3, 30])
def test_rare_domains_meet_their_targets(spark, rare):
    rows = [(i, 100, 1, [0.0, 0.0, 1.0] if i < rare else [1.0, 0.0, 0.0] if i % 4 else [0.0, 1.0, 0.0]) for i in range(1000)]
    now = [sum(p[k] for *_, p in rows) * 100 for k in range(3)]
    targets = [now[0] * 1.02, now[1] * 0.7, now[2] * 0.2]
    got = mixing.fit_rates(spark.createDataFrame(rows, MEMBERS).repartition(4), targets).collect()
    for k, want in enumerate((1.02, 0.7, 0.2)):
        assert all(abs(r.rate - want) < 1e-3 for r in got if r.p[k])


def test_uncertain_and_unreachable_targets(spark):
    rows = [(i, 10 + i, 1, [0.9, 0.09, 0.01] if i % 50 else [0.1, 0.2, 0.7]) for i in range(500)]
    members = spark.createDataFrame(rows, MEMBERS)
    got = mixing.fit_rates(members, [sum(n * p[0] for _, n, _, p in rows), sum(n * p[1] for _, n, _, p in rows), 0.0]).collect()
    assert all(r.rate >= 0 for r in got) and {r.rate for r in got if r.p[2] == 0.7} == {0.0}
    # Of what no document holds, none can be asked for; other targets are still met.
    one = spark.createDataFrame([(i, 10, 1, [1.0, 0.0, 0.0]) for i in range(5)], MEMBERS)
    assert all(abs(r.rate - 2) < 1e-4 for r in mixing.fit_rates(one, [100.0, 0.0, 30.0]).collect())
    nothing = spark.createDataFrame([(1, 0, 1, [1.0, 0.0, 0.0])], MEMBERS)
    assert [r.rate for r in mixing.fit_rates(nothing, [5.0, 1.0, 1.0]).collect()] == [1.0]


def plain_nnls(a, goal, rounds=20_000):
    """Least squares over nonnegative x by accelerated projected gradient: the columns of a are kinds of documents."""
    step = 1 / np.linalg.norm(a, 2) ** 2
    x = y = np.ones(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * (a.T @ (a @ y - goal)))
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        x, y = new, new + (was - 1) / t * (new - x)
    return x


def test_residual_is_that_of_plain_least_squares_far_from_the_natural_mixture(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.4, 0.3, 0.2], 400).round(3)
    rows = [(i, int(rng.integers(1, 500)), 1, [float(v) for v in q]) for i, q in enumerate(p)]
    members = spark.createDataFrame(rows, MEMBERS)
    tokens = np.array([n for _, n, _, _ in rows], float)
    for shares in ([0.2, 0.2, 0.6], [0.0, 0.0, 1.0], [0.98, 0.01, 0.01]):
        targets = [float(tokens.sum()) * s for s in shares]
        got = np.array(mixing.residuals(mixing.fit_rates(members, targets), targets))
        a = (p * tokens[:, None]).T
        best = a @ plain_nnls(a, np.array(targets)) - targets
        assert np.linalg.norm(got) <= 1.01 * np.linalg.norm(best) + 1e-4 * tokens.sum()


def test_softmax_fit_is_calibrated():
    rng = np.random.default_rng(6)
    x = np.column_stack([np.ones(4000), rng.integers(0, 5, 4000) / 2.0])
    truth = np.array([[0.2, 1.0], [0.0, -1.0], [-1.0, 0.3]])
    z = np.exp(x @ truth.T)
    y = np.array([rng.choice(3, p=q / q.sum()) for q in z])
    terms = mixing.softmax_fit(x, y, np.ones(4000), 3)
    got = np.exp(x @ terms.T)
    got /= got.sum(1, keepdims=True)
    for value in np.unique(x[:, 1]):
        at = x[:, 1] == value
        assert np.allclose(got[at][0], np.bincount(y[at], minlength=3) / at.sum(), atol=0.06)


def test_posteriors_of_held_out_rows_and_of_ties(spark, monkeypatch):
    docs, labels = labelled_corpus()
    # Many near copies of one toxic text: they are learned from once.
    docs += [(2000 + i, docs[10][1] + f" tail{i}") for i in range(40)]
    table = spark.createDataFrame(docs, DOCS)
    marks = spark.createDataFrame([(i, "toxic" if t else "high" if q else "low") for i, q, t in labels] + [(2, "toxic"), (2, "low")], "doc_id long, domain string")
    domains = ["high", "low", "toxic"]
    model = mixing.learn(table, marks, domains)
    got = {r.doc_id: r.p for r in mixing.posteriors(table, model, domains).collect()}
    held = [i for i in range(600) if i % 2]
    truth = ["toxic" if i % 10 == 0 else "low" if i % 3 == 0 else "high" for i in held]
    assert np.mean([domains[int(np.argmax(got[i]))] == t for i, t in zip(held, truth)]) > 0.95
    assert len({tuple(p) for p in got.values()}) >= 3 and all(abs(sum(p) - 1) < 1e-8 for p in got.values())
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 1)  # the way for weights too many to broadcast
    again = {r.doc_id: r.p for r in mixing.posteriors(table, model, domains).collect()}
    assert again == got
    keys = {r.doc_id: r.k for r in table.select("doc_id", mixing._copy_key(F.col("text")).alias("k")).collect()}
    assert len({keys[2000 + i] for i in range(40)}) < 12 and len({keys[i] for i in range(600)}) == 600
