"""Mixing to target weights with soft domain membership, in DataFrame operations only.

A softmax regression over the presence of words, fitted on labelled rows, gives every document a
posterior for each domain. Projected-gradient least squares then fits one nonnegative rate a
document such that the expected domain token totals, sum of rate * tokens * posterior, match the
targets. The gradient of a document's rate depends on the few domain residuals alone, so a round is
one aggregation, and a rate is a fold of the rounds' residuals over the document's own posterior.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from batchtrace.llm.shared import store, words

#: Words the classifier keeps, labelled rows it is fitted on (about), rounds of the fit of the rates.
MAX_WORDS, MAX_LABELLED, MAX_ROUNDS, TOLERANCE = 512, 20_000, 40, 1e-4


def _array(values) -> Column:
    """A literal array of doubles (folded from one string when the plan is made)."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], max_labelled: int = MAX_LABELLED,
                   max_words: int = MAX_WORDS) -> tuple[list[float], list[str], np.ndarray]:
    """(bias, words, weights): a document's score for domain d is bias[d] plus weights[d, w] of each
    word w it holds; the softmax of the scores is its posterior.

    The words are the ``max_words`` whose presence tells the domains apart best (likelihood ratio;
    ties in order of the words). Fitted on about ``max_labelled`` rows of ``labelled`` (doc_id,
    domain), chosen by a hash of doc_id; rows with nulls or other domains are left out. Each doc_id
    counts once, however often it is labelled or stands in ``docs``: with the first of its
    domains, and the first of its texts in text order. What reaches the driver is bounded by the two
    parameters: the kept words and, for each row of the sample, which of them it holds."""
    place = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain"))
    labelled = (labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
                .groupBy("doc_id").agg(F.min(place).alias("place")))
    share = min(1.0, max_labelled / max(1, labelled.count()))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 20)) < int(share * (1 << 20)))
    domain = F.get(F.array(*[F.lit(d) for d in domains]), (F.col("place") - 1).cast("int")).alias("domain")
    rows = store(docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id", "place").agg(F.min("text").alias("text"))
                 .select(domain, F.array_distinct(words(F.col("text"))).alias("w")), "mix-labelled")
    found = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    seen = np.array([found.get(d, 0) for d in domains], float)
    held = [F.sum((F.col("domain") == d).cast("long")).cast("double").alias(f"n{i}") for i, d in enumerate(domains)]
    counts = rows.select("domain", F.explode("w").alias("word")).groupBy("word").agg(*held)
    n = sum((F.col(f"n{i}") for i in range(1, len(domains))), F.col("n0"))
    ratio = F.lit(0.0)
    for i, total in enumerate(seen):
        for have, expect in ((F.col(f"n{i}"), n * (total / max(1.0, seen.sum()))),
                             (F.lit(total) - F.col(f"n{i}"), (F.lit(seen.sum()) - n) * (total / max(1.0, seen.sum())))):
            ratio = ratio + F.when(have > 0, have * F.log(have / expect)).otherwise(0.0)
    kept = counts.withColumn("ratio", ratio).orderBy(F.desc("ratio"), "word").limit(max_words).collect()
    # frequent words first, as they are looked up in this order
    kept = [r["word"] for r in sorted(kept, key=lambda r: (-sum(r[f"n{i}"] for i in range(len(domains))), r["word"]))]
    if not kept:
        return np.log((seen + 1) / (seen.sum() + len(domains))).tolist(), [], np.zeros((len(domains), 0))
    listed = F.array(*[F.lit(w) for w in kept])
    held = F.transform(F.filter("w", lambda w: w.isin(kept)), lambda w: F.array_position(listed, w).cast("int") - 1)
    sample_rows = rows.select("domain", held.alias("held")).collect()
    x, y = np.zeros((len(sample_rows), len(kept)), np.float32), np.zeros((len(sample_rows), len(domains)), np.float32)
    for k, r in enumerate(sample_rows):
        x[k, r["held"]] = 1
        y[k, domains.index(r["domain"])] = 1
    bias, weights = softmax_regression(x, y)
    return bias.tolist(), kept, weights


def softmax_regression(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """(bias, weights) of the penalised fit, by accelerated gradient descent from zero."""
    n = len(x)
    x = np.hstack([x, np.ones((n, 1), np.float32)])
    step = 1 / (0.5 * float(np.linalg.eigvalsh(x.T @ x / n)[-1]) + penalty)
    w = before = np.zeros((y.shape[1], x.shape[1]))
    for k in range(rounds):
        v = w + (k / (k + 3)) * (w - before)
        z = x @ v.T.astype(np.float32)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        grad = ((p / p.sum(axis=1, keepdims=True) - y).T @ x) / n + penalty * v
        before, w = w, v - step * grad
    return w[:, -1], w[:, :-1]


def posteriors(held: Column, bias: list[float], kept: list[str], weights: np.ndarray) -> tuple[Column, object]:
    """The softmax of the domains' log scores in two steps: exponentials, then their shares.
    ``held`` has the places in ``kept`` of the words a document holds, each once."""
    def relative(d: int) -> Column:
        w = _array(weights[d] - weights[0]) if kept else F.array().cast("array<double>")
        return F.aggregate(held, F.lit(bias[d] - bias[0]), lambda a, x: a + F.get(w, x))

    score = F.array(F.lit(0.0), *[relative(d) for d in range(1, len(bias))])
    grown = F.transform(score, lambda s: F.exp(s - F.array_max(score)))
    return grown, lambda g: F.transform(g, lambda e: e / F.aggregate(g, F.lit(0.0), lambda a, x: a + x))


def rate(p: Column, steps: list[list[float]]) -> Column:
    """A document's rate after these gradient steps, from 1 and never below 0."""
    out = F.lit(1.0)
    for step in steps:
        down = F.lit(0.0)
        for d, x in enumerate(step):
            down = down + p[d] * F.lit(x)
        out = F.greatest(F.lit(0.0), out - down)
    return out


def fit_rates(rows: DataFrame, targets: list[float], max_rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE) -> list[list[float]]:
    """Projected-gradient steps of the least squares fit of sum(rate * n_tokens * p) to ``targets`` shares.

    Minimises the squared residuals relative to each domain's own tokens, in the metric that weighs
    a document by its tokens. Each round scales the gradient by the inverse of the domains' Gram
    matrix over the documents whose rate is above 0, and halves the step if the fit got worse, so
    a few rounds do. The targets' scale is that at which the first domain keeps its tokens (if it
    has none, the largest at which no domain has to grow). Only a few sums a round reach the driver."""
    d = len(targets)
    p = [F.col("p")[i] for i in range(d)]

    def sums(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """Expected domain tokens under the steps, and the Gram matrix of the rows with a rate."""
        rated = rows.select("n_tokens", "p", rate(F.col("p"), steps).alias("r"))
        w = F.when(F.col("r") > 0, F.col("n_tokens")).otherwise(0)
        got = rated.agg(*[F.sum(F.col("n_tokens") * F.col("r") * a) for a in p],
                        *[F.sum(w * p[i] * p[j]) for i in range(d) for j in range(d)]).first()
        got = [x or 0.0 for x in got]
        return np.array(got[:d]), np.array(got[d:]).reshape(d, d)

    total, gram = sums([])
    live = [i for i in range(d) if total[i] > 0 and targets[i] > 0]
    if not live:
        return []
    goal = np.array(targets) * (total[0] / targets[0] if live[0] == 0 else min(total[i] / targets[i] for i in live))
    unit = np.where(total > 0, total, 1.0)
    steps: list[list[float]] = []
    best = float("inf")
    for _ in range(max_rounds):
        residual = total - goal
        error = float((((residual / unit) ** 2).sum()))
        if steps and error > best:  # too far: half of the last step from where it began
            steps[-1] = [x / 2 for x in steps[-1]]
        elif (np.abs(residual) <= tolerance * np.maximum(goal, 1e-3 * unit.sum())).all() or error > best * (1 - 1e-9):
            break
        else:
            best = error
            scaled = np.linalg.pinv(gram + 1e-12 * np.diag(unit), rcond=1e-10) @ residual
            steps.append([float(x) for x in scaled])
        total, gram = sums(steps)
    else:
        warnings.warn(f"rates did not settle in {max_rounds} rounds: domain tokens {total.round(1).tolist()}, targets "
                      f"{goal.round(1).tolist()}", stacklevel=2)
    return steps


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], carry: list[str] | None = None,
        max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``carry`` columns (default: all) plus n_tokens, domain, p_<domain> for each target, rate, copies.

    ``labelled`` has doc_id and domain; ``targets`` the share of tokens each domain is to have.
    n_tokens counts words. domain is the most probable one (ties: first in ``targets``). copies is
    the rate rounded up or down by a hash of doc_id and text, so its mean over documents is the
    rate. Null and empty texts have no tokens and a posterior from the bias alone. Repeated rows count
    each and get equal rates and copies. No labelled row: even posteriors. Empty table: empty
    result. Input columns with the names of result columns are replaced.
    """
    domains = list(targets)
    added = ["n_tokens", "domain", *[f"p_{d}" for d in domains], "rate", "copies"]
    cols = [c for c in (docs.columns if carry is None else carry) if c not in added]
    bias, kept, weights = fit_classifier(docs, labelled, domains, max_labelled)
    grown, shares = posteriors(F.col("_f"), bias, kept, weights)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), words(F.col("text")).alias("_w"),
                       F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("_u"))
    listed = F.array(*[F.lit(w) for w in kept])
    held = F.array_distinct(F.filter("_w", lambda w: w.isin(kept))) if kept else F.array().cast("array<string>")
    held = F.transform(held, lambda w: F.array_position(listed, w).cast("int") - 1) if kept else held.cast("array<int>")
    rows = rows.withColumn("_f", held).withColumn("_g", grown).select(
        "_row", "_u", F.size("_w").cast("long").alias("n_tokens"), shares(F.col("_g")).alias("p"))
    rows = store(rows, "mix-rows")
    steps = fit_rates(rows, [targets[d] for d in domains])
    out = rows.withColumn("rate", rate(F.col("p"), steps))
    best = F.get(F.array(*[F.lit(d) for d in domains]), (F.array_position("p", F.array_max("p")) - 1).cast("int"))
    return out.select("_row.*", "n_tokens", best.alias("domain"), *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)],
                      "rate", F.floor(F.col("rate") + F.col("_u") / float(1 << 30)).cast("int").alias("copies"))
