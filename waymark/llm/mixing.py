"""Mixing to target weights by soft membership. DataFrame operations only.

A classifier learned from a labelled table gives each document a posterior over domains. Features
(words, word beginnings, trailing symbols, share of distinct words) that speak clearly for one domain
are found on one half of a bounded sample of labelled rows; a document's evidence for a domain is the
sum of their log-ratios, in halves up to MOST_EVIDENCE; a logistic model fitted on the other half
turns the evidence for all domains into a posterior. Then nonnegative document rates are fitted by
projected gradient so that the expected tokens of each domain meet the targets in the least-squares
sense. Rates begin at 1. A step aggregates the expected tokens of each domain, takes from each rate its
gradient, which is the document's posterior times the domains' residuals, and sets what falls below 0
to 0. Rates depend on the posterior alone, so they are held in a table with a row for each distinct
posterior, written anew each step by the job that also aggregates for the next. A step's gradient is scaled
in three ways, by the second moments of the posteriors of documents with a rate above 0, by those moments
weighted with the rates, and plainly; one aggregation tells which scaling and which of a range of lengths
leads nearest to the targets. The distance never rises. Steps end where the targets are met or, where no rates
meet them all, where the distance falls no further.
``residuals`` tells how far the fitted mixture is from the targets.

Defined results: null and empty texts have no tokens and the posterior of documents without
evidence; rows that repeat id and text share one row with their count in ``copies``; null ids are
ids like any other; without labels, or with one domain only, posteriors are uniform over the target
domains; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from waymark.llm.common import materialize, shingle_hashes, small_enough, words

#: Labelled rows learned from at most, chosen by a hash of their id (a bound that the task allows).
TRAINING_ROWS = 20_000
#: A feature speaks for a domain at this log-ratio of its shares within and outside it, ...
MIN_LOG_RATIO = 3.5
#: ... if the likelihood-ratio statistic of its counts is so large and it stands in so many documents.
MIN_STATISTIC, MIN_SUPPORT = 18.0, 5
#: Evidence above this says no more; evidence of STRONG and more has a term of its own in the model.
MOST_EVIDENCE, STRONG = 12.0, 6.0
#: MinHash values by which near copies among the labelled rows are told.
COPY_HASHES = 3
#: A target is met within this share of it. The distance from the targets falls no further where it does so by less
#: than SETTLED of itself in PATIENCE steps. Lengths tried for a step.
TOLERANCE, SETTLED, PATIENCE = 1e-6, 1e-3, 5
LENGTHS = [2.0**k for k in range(-8, 9)]
#: Rows up to which the feature weights are broadcast; beyond it Spark shuffles.
BROADCAST_ROWS = 200_000
_SENTINEL = "\u0001document"


def labelled_domain(quality: Column, toxic: Column) -> Column:
    """The domain of a labelled row: toxic, else high or low by quality; null labels give none."""
    return F.when(toxic == 1, "toxic").when(quality == 1, "high").when(quality == 0, "low")


def _evidence_rows(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, n_tokens and a hash for each feature of each distinct token, with one sentinel a document."""
    cut = docs.select(*keep, F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+").alias("all"))
    cut = cut.select(*keep, F.size("all").alias("size"), F.array_distinct("all").alias("once"))
    n = F.when((F.col("size") == 1) & (F.element_at("once", 1) == ""), 0).otherwise(F.col("size"))
    share = F.floor(10 * F.size("once") / F.col("size")).cast("string")
    own = F.array(F.lit(_SENTINEL), F.concat(F.lit("\u0001distinct"), F.when(n >= 20, share).otherwise("")))
    each = cut.select(*keep, n.alias("n_tokens"), F.explode(F.concat("once", own)).alias("token"))
    low, last = F.lower("token"), F.substring("token", -1, 1)
    features = F.array(
        F.xxhash64(F.lit("word"), F.rtrim(low, F.lit(".,"))),
        F.xxhash64(F.lit("begins"), F.substring(low, 1, 4)),
        F.when(F.lower(last) == F.upper(last), F.xxhash64(F.lit("ends"), F.substring("token", -2, 2))),
    )
    return each.select(*keep, "n_tokens", F.explode(features).alias("feature")).where("feature is not null")


def _copy_key(text: Column) -> Column:
    """One value for copies and most near copies: the least of each of COPY_HASHES rehashes of the whole text's shingles."""

    def least(k: int) -> Column:
        return F.array_min(F.transform(shingle_hashes(words(text), 5), lambda h: F.xxhash64(h, F.lit(k))))

    return F.coalesce(F.xxhash64(*[least(k) for k in range(COPY_HASHES)]) + F.when(least(0).isNull(), F.xxhash64(text)).otherwise(0), F.lit(0).cast("long"))


def _sum_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _xlogx(seen: Column, expected: Column) -> Column:
    return F.when((seen > 0) & (expected > 0), seen * F.log(seen / expected)).otherwise(0.0)


class Model:
    """Feature weights (feature, one column w<i> a domain) and the logistic terms (domains x terms)."""

    def __init__(self, weights: DataFrame, terms: np.ndarray) -> None:
        self.weights, self.terms = weights, terms


def _inputs(evidence: list[Column]) -> list[Column]:
    """The model's inputs: 1, then for each domain its evidence, whether there is some and whether it is strong."""
    out = [F.lit(1.0)]
    for e in evidence:
        out += [e, (e > 0).cast("double"), (e >= STRONG).cast("double")]
    return out


def softmax_fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, classes: int, ridge: float = 0.5, steps: int = 50) -> np.ndarray:
    """Terms (classes x inputs) of a logistic model of rows x with class y and count n, by damped Newton steps."""
    size = x.shape[1]
    hot = np.eye(classes)[y]
    terms = np.zeros((classes, size))
    penalty = ridge * np.concatenate(([1e-3], np.ones(size - 1)))

    def probabilities(t: np.ndarray) -> np.ndarray:
        z = x @ t.T
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def loss(t: np.ndarray) -> float:
        return float(-(n * np.log(np.maximum(probabilities(t)[np.arange(len(y)), y], 1e-300))).sum() + (penalty * t**2).sum() / 2)

    best = loss(terms)
    for _ in range(steps):
        p = probabilities(terms)
        slope = ((p - hot) * n[:, None]).T @ x + penalty * terms
        curve = np.zeros((classes, size, classes, size))
        for a in range(classes):
            for b in range(classes):
                curve[a, :, b] = (x * (n * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x
        curve = curve.reshape(classes * size, -1) + np.diag(np.tile(penalty, classes))
        step = np.linalg.solve(curve, slope.ravel()).reshape(classes, size)
        tried = [(loss(terms - step * 0.5**k), k) for k in range(8)]
        value, k = min(tried)
        if best - value <= 1e-9 * abs(best):
            break
        terms, best = terms - step * 0.5**k, value
    return terms


def learn(docs: DataFrame, labels: DataFrame, domains: list[str], rows: int = TRAINING_ROWS) -> Model:
    """docs: doc_id, text. labels: doc_id, domain; each doc_id's smallest domain counts."""
    known = labels.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    total = known.count()
    share = min(1.0, rows / max(1, total))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000)
    sample = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & chosen).join(known.where(chosen), "doc_id")
    # Near copies would make their own words look telling: of copies one is learned from.
    sample = sample.withColumn("copy", _copy_key(F.col("text")))
    sample = sample.groupBy("copy").agg(F.min_by(F.struct("doc_id", "text", "domain"), F.col("doc_id")).alias("one")).select("one.*")
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    found = materialize(_evidence_rows(sample.withColumn("half", half), ["doc_id", "domain", "half"]).distinct(), "training")
    sentinel = F.xxhash64(F.lit("word"), F.lit(_SENTINEL))
    flags = [F.sum((F.col("domain") == d).cast("long")).alias(f"n{i}") for i, d in enumerate(domains)]
    first = found.where("half = 0")
    counts = first.where(F.col("feature") == sentinel).agg(*flags).first()
    n = [counts[f"n{i}"] or 0 for i in range(len(domains))]
    seen = first.groupBy("feature").agg(F.count("*").alias("support"), *flags).where(F.col("support") >= MIN_SUPPORT)
    weights = []
    for i in range(len(domains)):
        inside, outside = F.col(f"n{i}") + 0.5, F.col("support") - F.col(f"n{i}") + 0.5
        ratio = F.log(inside / F.lit(n[i] + 1.0)) - F.log(outside / F.lit(sum(n) - n[i] + 1.0))
        k, m, expected = F.col(f"n{i}"), F.col("support"), n[i] / max(1, sum(n))
        statistic = 2 * (_xlogx(k, m * expected) + _xlogx(m - k, m * (1 - expected)))
        clear = (ratio >= MIN_LOG_RATIO) & (statistic >= MIN_STATISTIC) & (F.col("feature") != sentinel)
        weights.append(F.when(clear, ratio).otherwise(0.0).alias(f"w{i}"))
    speaking = seen.select("feature", *weights).where(_sum_of([F.col(f"w{i}") for i in range(len(domains))]) > 0)
    zero = docs.sparkSession.range(1).select(sentinel.alias("feature"), *[F.lit(0.0).alias(f"w{i}") for i in range(len(domains))])
    table = materialize(speaking.unionByName(zero), "weights")
    evidence = [F.col(f"s{i}") for i in range(len(domains))]
    second = _evidence(found.where("half = 1"), table, ["doc_id", "domain"], domains)
    met = second.groupBy("domain", *evidence).agg(F.count("*").alias("n")).collect()  # within the bound on labelled rows
    inputs = 1 + 3 * len(domains)
    if not met:
        return Model(table, np.zeros((len(domains), inputs)))
    x = np.array([[1.0, *[v for i in range(len(domains)) for v in (r[f"s{i}"], float(r[f"s{i}"] > 0), float(r[f"s{i}"] >= STRONG))]] for r in met])
    return Model(table, softmax_fit(x, np.array([domains.index(r.domain) for r in met]), np.array([float(r.n) for r in met]), len(domains)))


def _evidence(rows: DataFrame, weights: DataFrame, keys: list[str], domains: list[str]) -> DataFrame:
    """keys, n_tokens, copies and s<i>: the evidence for each domain."""
    sentinel = F.xxhash64(F.lit("word"), F.lit(_SENTINEL))
    small = small_enough(weights, BROADCAST_ROWS)
    if small:
        joined = rows.join(F.broadcast(weights), "feature")
    else:  # the sentinels, a row a document, stay off the shuffle by feature
        zeros = [F.lit(0.0).alias(f"w{i}") for i in range(len(domains))]
        joined = rows.where(F.col("feature") != sentinel).join(weights, "feature").unionByName(rows.where(F.col("feature") == sentinel).select("*", *zeros))
    met = joined.groupBy(*keys, "n_tokens", "feature").agg(F.count("*").alias("c"), *[F.first(f"w{i}").alias(f"w{i}") for i in range(len(domains))])
    sums = met.groupBy(*keys, "n_tokens").agg(F.max(F.when(F.col("feature") == sentinel, F.col("c"))).alias("copies"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(len(domains))])
    return sums.select(*keys, "n_tokens", "copies", *[F.least(F.lit(MOST_EVIDENCE), F.round(F.col(f"w{i}") * 2) / 2).alias(f"s{i}") for i in range(len(domains))])


def posteriors(docs: DataFrame, model: Model, domains: list[str]) -> DataFrame:
    """One row for each distinct (doc_id, text): doc_id, text_hash, n_tokens, copies, p (array, a number a domain)."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    got = _evidence(_evidence_rows(rows, ["doc_id", "text_hash"]), model.weights, ["doc_id", "text_hash"], domains)
    inputs = _inputs([F.col(f"s{i}") for i in range(len(domains))])
    scores = [_sum_of([c * F.lit(float(t)) for c, t in zip(inputs, terms, strict=True)]) for terms in model.terms]
    got = got.withColumn("z", F.array(*scores)).withColumn("e", F.transform("z", lambda v: F.exp(v - F.array_max("z"))))
    whole = F.aggregate("e", F.lit(0.0), lambda a, v: a + v)
    # Ten digits are enough, and make equal evidence one kind on every machine.
    return got.withColumn("whole", whole).select("doc_id", "text_hash", "n_tokens", "copies", F.transform("e", lambda v: F.round(v / F.col("whole"), 10)).alias("p"))


class _Descent:
    """Projected-gradient steps on a table of rates (p, share, rate), written anew each step."""

    def __init__(self, state: DataFrame, goal: np.ndarray, tolerance: float) -> None:
        self.goal, self.tolerance, self.size = goal, tolerance, len(goal)
        self.p = [F.element_at("p", i + 1) for i in range(self.size)]
        self._write(state)
        spread, axes = np.linalg.eigh(self.inside)
        self.axes, self.steepest = axes[:, spread > 1e-12 * spread[-1]], spread[-1]  # no document lies in other directions

    def _write(self, state: DataFrame) -> None:
        """Write the rates; in the same job, sum the expected shares and the second moments of the documents with a rate above 0, plain and by rate."""
        seen = Observation()
        at = [(i, j) for i in range(self.size) for j in range(i, self.size)]
        sums = [F.sum(F.col("share") * F.col("rate") * p).alias(f"now{i}") for i, p in enumerate(self.p)]
        for name, weight in (("in", F.when(F.col("rate") > 0, F.col("share")).otherwise(0.0)), ("by", F.col("share") * F.col("rate"))):
            sums += [F.sum(weight * self.p[i] * self.p[j]).alias(f"{name}{i}_{j}") for i, j in at]
        self.state = materialize(state.observe(seen, *sums), "rates")
        got = seen.get
        self.now = np.array([got[f"now{i}"] for i in range(self.size)])
        self.inside, self.by_rate = (np.array([[got[f"{n}{min(i, j)}_{max(i, j)}"] for j in range(self.size)] for i in range(self.size)]) for n in ("in", "by"))

    def off(self, now: np.ndarray) -> np.ndarray:
        return self.axes @ (self.axes.T @ (now - self.goal))

    def met(self) -> bool:
        return bool(np.all(np.abs(self.off(self.now)) <= self.tolerance * np.maximum(np.abs(self.goal), 1e-3)))

    def _scaled(self, moments: np.ndarray) -> np.ndarray:
        inverse = np.linalg.pinv(self.axes.T @ moments @ self.axes, 1e-9, hermitian=True)
        return self.axes @ (inverse @ (self.axes.T @ self.off(self.now)))

    def step(self) -> None:
        """Of three scalings of the gradient and of LENGTHS, take those whose projected rates miss the goal least, by one aggregation over all of them."""
        pulls = [self._scaled(self.inside), self._scaled(self.by_rate), self.off(self.now) / self.steepest]
        scales = [(F.col("rate") > 0).cast("double"), F.col("rate"), F.lit(1.0)]
        slopes = [scale * _sum_of([p * F.lit(float(v)) for p, v in zip(self.p, pull, strict=True)]) for scale, pull in zip(scales, pulls, strict=True)]
        tried = self.state.select("p", "share", "rate", F.posexplode(F.array(*slopes)).alias("way", "slope"))
        tried = tried.select("p", "share", "way", "slope", "rate", F.explode(F.array(*[F.lit(v) for v in LENGTHS])).alias("length"))
        rate = F.greatest(F.lit(0.0), F.col("rate") - F.col("length") * F.col("slope"))
        sums = tried.groupBy("way", "length").agg(*[F.sum(F.col("share") * rate * p).alias(f"e{i}") for i, p in enumerate(self.p)]).collect()  # a row a way and length
        # Nine digits, so that the order of a sum's terms does not choose between equal steps.
        missed = [(float(f"{np.linalg.norm(self.off(np.array([r[f'e{i}'] for i in range(self.size)]))):.9g}"), r.way, r.length) for r in sums]
        _, way, length = min(missed)
        self._write(self.state.select("p", "share", F.greatest(F.lit(0.0), F.col("rate") - F.lit(length) * slopes[way]).alias("rate")))

    def run(self) -> None:
        """Steps until the targets are met, or the distance from them falls no further."""
        distances: list[float] = []
        while not self.met():
            distances.append(float(np.linalg.norm(self.off(self.now))))
            if len(distances) > PATIENCE and distances[-1] >= (1 - SETTLED) * distances[-1 - PATIENCE]:
                return
            self.step()


def fit_rates(members: DataFrame, targets: list[float], tolerance: float = TOLERANCE) -> DataFrame:
    """members (n_tokens, copies, p, ...) with column rate: nonnegative rates whose expected domain tokens come closest to targets."""
    mass = F.sum((F.col("n_tokens") * F.col("copies")).cast("double")).alias("mass")
    kinds = materialize(members.groupBy("p").agg(mass), "kinds")  # rates depend on p alone
    whole = float(kinds.agg(F.sum("mass")).first()[0] or 0)
    if not whole:
        return members.withColumn("rate", F.lit(1.0))
    fit = _Descent(kinds.select("p", (F.col("mass") / whole).alias("share"), F.lit(1.0).alias("rate")), np.array(targets) / whole, tolerance)
    fit.run()
    return members.join(fit.state.select("p", "rate"), "p").select(*members.columns, "rate")


def residuals(fitted: DataFrame, targets: list[float]) -> list[float]:
    """Expected tokens of each domain under the rates, less the target."""
    sums = fitted.agg(*[F.sum(F.col("n_tokens") * F.col("copies") * F.col("rate") * F.element_at("p", i + 1)).alias(f"e{i}") for i in range(len(targets))]).first()
    return [(sums[f"e{i}"] or 0.0) - t for i, t in enumerate(targets)]


def mix(docs: DataFrame, labels: DataFrame, weights: DataFrame, keep: str, headroom: float = 1.02, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per distinct (doc_id, text): doc_id, text_hash, n_tokens, copies, p_<domain>, rate, draws.

    weights: the domains' target shares (domain, share). The mixture is sized so that domain keep has headroom
    times its present expected tokens. draws is the rate rounded up or down by a hash of the id, so
    that its mean is the rate: how many times the mixture holds the document.
    """
    shares = {r.domain: float(r.share) for r in weights.collect()}  # a row a domain
    domains = sorted(shares)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    members = materialize(posteriors(rows, learn(rows, labels, domains), domains), "posteriors")
    at = domains.index(keep)
    kept = members.agg(F.sum(F.col("n_tokens") * F.col("copies") * F.element_at("p", at + 1))).first()[0] or 0.0
    size = headroom * kept / shares[keep]
    fitted = fit_rates(members, [size * shares[d] for d in domains])
    chance = F.pmod(F.xxhash64("doc_id", "text_hash", F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return fitted.select(
        "doc_id", "text_hash", "n_tokens", "copies", *[F.element_at("p", i + 1).alias(f"p_{d}") for i, d in enumerate(domains)],
        "rate", F.floor(F.col("rate") + chance).cast("long").alias("draws"),
    )


def mixed(docs: DataFrame, labels: DataFrame, weights: DataFrame, keep: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the mixture holds at least once, each as it was."""
    out = mix(docs, labels, weights, keep, id_col=id_col, text_col=text_col).where("draws = 0").select("doc_id", "text_hash")
    return docs.join(out, docs[id_col].eqNullSafe(out["doc_id"]) & F.xxhash64(docs[text_col]).eqNullSafe(out["text_hash"]), "left_anti")
