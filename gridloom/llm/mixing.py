"""Mixing sources to target weights by soft membership, in DataFrame functions only.

A classifier learnt from the labelled table gives every document posteriors over the
domains (one domain for each combination of labels). Nonnegative document rates are
then fitted so that the expected tokens of each domain, ``sum(rate * tokens *
posterior)``, match the targets: least squares, solved by projected gradient. A step
is one distributed sum of a few numbers over the feature table; rates are never
stored, as the rate of a document is a function of its posteriors and of the steps'
few multipliers, which the driver holds.

Classifier: naive Bayes over hashed words (``BUCKETS``) and their last characters,
learnt from at most ``TRAIN_ROWS`` labelled rows, those with the least hashes. Its
evidence counts as that of at most ``EVIDENCE`` words, which keeps posteriors soft.

The least squares weigh the domains' misfits by their damped inverse Gram matrix
(domains times domains, summed in one pass), and the gradient is taken in the metric
of the documents' tokens; so the step length is one, and rates depend on posteriors
alone, not on a document's length.

Defined results: a null or empty text has no tokens and the prior as posteriors;
documents without a label, or with null labels, are scored but not learnt from; with
no labelled row at all there is one domain ``all`` that every document belongs to;
targets that cannot be met are met as well as least squares can; repeated rows each
have their rate; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import SPACE_CLASS, documents, materialize

BUCKETS, TRAIN_ROWS, EVIDENCE, SMOOTHING, STEPS, TOLERANCE = 8192, 8000, 400, 0.5, 40, 1e-6
SEED = 20240229
#: Target shares of tokens by domain; q: quality label, t: toxic label.
TARGETS = {"q1t0": 0.93, "q1t1": 0.02, "q0t0": 0.04, "q0t1": 0.01}


@dataclass(frozen=True)
class DomainModel:
    """Log-ratios of each bucket against the first domain, and the domains' log-priors."""

    domains: tuple[str, ...]
    ratios: np.ndarray
    priors: np.ndarray


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+"), "")


def word_bucket(w: Column) -> Column:
    """A word's number; the upper half of the buckets is for its last character."""
    return F.pmod(F.xxhash64(w), F.lit(BUCKETS // 2)).cast("int")


def last_bucket(w: Column) -> Column:
    return (F.pmod(F.xxhash64(F.right(w, F.lit(1))), F.lit(BUCKETS // 2)) + BUCKETS // 2).cast("int")


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_cols: tuple[str, ...] = ("quality", "toxic")) -> DataFrame:
    """``__text, __domain`` of the labelled documents to learn from."""
    known = labels.where(" AND ".join(f"`{c}` IS NOT NULL" for c in label_cols))
    name = F.concat(*[x for c in label_cols for x in (F.lit(c[0]), F.col(c).cast("string"))])
    known = known.select(F.col(id_col).alias("__label_id"), name.alias("__domain")).dropDuplicates(["__label_id"])
    picked = known.orderBy(F.xxhash64(F.lit(SEED), "__label_id"), "__label_id").limit(TRAIN_ROWS)
    # At most TRAIN_ROWS ids, whatever the size of the tables; so texts of other rows are not moved.
    return docs.select(F.col(id_col).alias("__id"), F.col("text").alias("__text")).join(F.broadcast(picked), F.col("__id") == F.col("__label_id")).select("__text", "__domain")


def fit_domains(train: DataFrame) -> DomainModel:
    """Bucket counts by domain: at most domains times ``BUCKETS`` numbers come to the driver."""
    train = train.persist()
    try:
        sizes = {r["__domain"]: r["n"] for r in train.groupBy("__domain").agg(F.count("*").alias("n")).collect()}
        if not sizes:
            return DomainModel(("all",), np.zeros((0, BUCKETS)), np.zeros(1))
        seen = train.select("__domain", F.explode(words(F.col("__text"))).alias("w"))
        seen = seen.select("__domain", F.explode(F.array(word_bucket(F.col("w")), last_bucket(F.col("w")))).alias("bucket"))
        found = seen.groupBy("__domain", "bucket").agg(F.count("*").alias("n")).collect()
    finally:
        train.unpersist()
    domains = tuple(sorted(sizes, key=lambda d: (-sizes[d], d)))
    counts = np.full((len(domains), BUCKETS), SMOOTHING)
    for r in found:
        counts[domains.index(r["__domain"]), r["bucket"]] += r["n"]
    half = BUCKETS // 2
    logs = np.hstack([np.log(part / part.sum(1, keepdims=True)) for part in (counts[:, :half], counts[:, half:])])
    priors = np.log(np.array([sizes[d] for d in domains]) / sum(sizes.values()))
    return DomainModel(domains, logs[1:] - logs[0], priors)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _adder(table: Column):
    return lambda s, b: s + F.get(table, b)


def posteriors(model: DomainModel, text: Column) -> tuple[Column, Column]:
    """Number of words, and an array of the domains' posteriors."""
    own = words(text)
    if len(model.domains) == 1:
        return F.size(own), F.array(F.lit(1.0))

    def scores(both: Column) -> Column:
        n = F.size(both["w"])
        share = F.least(F.lit(1.0), F.lit(float(EVIDENCE)) / F.greatest(n, F.lit(1)))
        out = [F.lit(float(model.priors[0]))]
        for prior, ratio in zip(model.priors[1:], model.ratios, strict=True):
            add = _adder(F.lit(np.ascontiguousarray(ratio)))
            total = F.aggregate(both["w"], F.lit(0.0), add) + F.aggregate(both["c"], F.lit(0.0), add)
            out.append(F.lit(float(prior)) + total * share)
        return F.array(*out)

    def softmax(z: Column) -> Column:
        e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
        return _let(e, lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda s, v: s + v)))

    buckets = _let(own, lambda w: F.struct(F.transform(w, word_bucket).alias("w"), F.transform(w, last_bucket).alias("c")))
    return F.size(own), _let(_let(buckets, scores), softmax)


def features(docs: DataFrame, model: DomainModel, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The kept columns with ``n_tokens`` (words) and ``p_<domain>``; stored, as each step reads it."""
    size, p = posteriors(model, F.col(text_col))
    made = docs.select(*keep, size.cast("long").alias("n_tokens"), p.alias("__p"))
    kept = [c for c in made.columns if c not in ("n_tokens", "__p")]
    return materialize(made.select(*kept, "n_tokens", *[F.col("__p")[k].alias(f"p_{d}") for k, d in enumerate(model.domains)]), "mixing")


def rate_column(features: list[Column], steps: list[np.ndarray], most: float | None) -> Column:
    """A document's rate after the steps: from 1, each goes down the gradient and back to what is allowed."""
    rate = F.lit(1.0)
    for multipliers in steps:
        moved = rate
        for f, m in zip(features, multipliers, strict=True):
            moved = moved - f * F.lit(float(m))
        rate = F.greatest(moved, F.lit(0.0))
        rate = F.least(rate, F.lit(float(most))) if most is not None else rate
    return rate


def fit_rates(table: DataFrame, domains: tuple[str, ...], weights: Mapping[str, float], total: float | None = None) -> Column:
    """The rate as an expression over ``table``.

    ``weights``: the domains' shares of ``total`` expected tokens (the table's own
    total if None).
    """
    k = len(domains)
    p = [F.col(f"p_{d}") for d in domains]
    t = F.col("n_tokens").cast("double")
    gram = [F.sum(t * p[i] * p[j]) for i in range(k) for j in range(i, k)]
    sums = table.agg(*[F.sum(t * x) for x in p], *gram).first()
    there = np.array([x or 0.0 for x in sums[:k]])
    g = np.zeros((k, k))
    g[np.triu_indices(k)] = [x or 0.0 for x in sums[k:]]
    whiten = misfit_weights(g + np.triu(g, 1).T)
    total = there.sum() if total is None else total
    target = shares_of(domains, weights) * total
    steps: list[np.ndarray] = []
    expected = there
    for _ in range(STEPS):
        rest = expected - target
        if np.abs(rest).max() <= TOLERANCE * max(1.0, total):
            break
        steps.append(whiten @ rest)
        rate = rate_column(p, steps, None)
        before, expected = expected, np.array([x or 0.0 for x in table.agg(*[F.sum(rate * t * x) for x in p]).first()])
        if np.abs(expected - before).max() <= 1e-9 * max(1.0, total):
            break
    else:
        unsettled(np.abs(expected - before).max() / max(1.0, total))
    return rate_column(p, steps, None)


def misfit_weights(gram: np.ndarray) -> np.ndarray:
    """What weighs the domains' misfits: the inverse Gram matrix, damped.

    In its metric a step of length one is safe whatever the posteriors. The damping
    keeps a domain of which there is next to nothing from outweighing the others by
    more than about a thousand to one.
    """
    k = len(gram)
    return np.linalg.inv(gram + np.eye(k) * max(1e-3 * np.trace(gram) / k, 1e-12)) if k else gram


def unsettled(change: float) -> None:
    """Says so if the steps end before the totals stand still to a ten-thousandth."""
    if change > 1e-4:
        warnings.warn(f"rates still change the expected totals by {change:.1e} of all tokens after {STEPS} steps", stacklevel=3)


def shares_of(domains: tuple[str, ...], weights: Mapping[str, float]) -> np.ndarray:
    shares = np.array([max(0.0, weights.get(d, 0.0)) for d in domains])
    return shares / shares.sum() if shares.sum() else np.full(len(domains), 1 / len(domains))


def fit_draw(table: DataFrame, domains: tuple[str, ...], weights: Mapping[str, float]) -> Column:
    """Rates of one at most, as a draw without replacement has them.

    Rows whose likeliest domain is the one of the largest share have rate one. The
    others' rates bring each other domain to its share relative to that one, hence the
    total follows from the data: with ``q = p_d - p_largest * share_d / share_largest``
    the sum of ``rate * tokens * q`` shall be zero, by the same projected gradient.
    Where the rows of rate one hold more of a domain than its share, what is left is
    as small as least squares can make it.
    """
    shares = shares_of(domains, weights)
    top = int(shares.argmax())
    others = [i for i in range(len(domains)) if i != top]
    if not others:
        return F.lit(1.0)
    p = [F.col(f"p_{d}") for d in domains]
    q = [p[i] - p[top] * F.lit(float(shares[i] / shares[top])) for i in others]
    fixed = p[top] >= F.greatest(*[p[i] for i in others]) if len(others) > 1 else p[top] >= p[others[0]]
    t, k = F.col("n_tokens").cast("double"), len(others)
    free = F.when(fixed, F.lit(0.0)).otherwise(t)
    sums = table.agg(F.sum(t), *[F.sum(t * x) for x in q], *[F.sum(free * q[i] * q[j]) for i in range(k) for j in range(i, k)]).first()
    total, rest = sums[0] or 0.0, np.array([x or 0.0 for x in sums[1 : k + 1]])
    g = np.zeros((k, k))
    g[np.triu_indices(k)] = [x or 0.0 for x in sums[k + 1 :]]
    whiten = misfit_weights(g + np.triu(g, 1).T)
    steps: list[np.ndarray] = []
    rate = F.lit(1.0)
    for _ in range(STEPS):
        if np.abs(rest).max() <= TOLERANCE * max(1.0, total):
            break
        steps.append(whiten @ rest)
        rate = F.when(fixed, F.lit(1.0)).otherwise(rate_column(q, steps, 1.0))
        before, rest = rest, np.array([x or 0.0 for x in table.agg(*[F.sum(rate * t * x) for x in q]).first()])
        if np.abs(rest - before).max() <= 1e-9 * max(1.0, total):
            break
    else:
        unsettled(np.abs(rest - before).max() / max(1.0, total))
    return rate


def mixing_rates(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float] = TARGETS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``id, source, n_tokens, p_<domain> ..., rate`` for each document."""
    model = fit_domains(labelled(docs, labels, id_col))
    table = features(docs, model, [F.col(id_col), F.col(source_col)])
    return table.withColumn("rate", fit_rates(table, model.domains, weights))


def mixed_documents(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float] = TARGETS, id_col: str = "doc_id") -> DataFrame:
    """The rows, with all their columns, drawn without replacement at their rates.

    A rate of one keeps the document; the draw is a hash of its id and text, so it is
    the same on every run. Only labels of these documents are learnt from.
    """
    model = fit_domains(labelled(docs, labels.join(docs.select(id_col), id_col, "left_semi"), id_col))
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col(id_col), F.col("text")), 11) / F.lit(float(1 << 53))).alias("__draw")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    table = features(docs, model, [whole, draw])
    return table.where(F.col("__draw") < fit_draw(table, model.domains, weights)).select("__row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
