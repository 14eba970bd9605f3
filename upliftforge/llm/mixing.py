"""Mixing a corpus to target weights with soft domain membership.

A classifier fitted on the labelled table (hashed word class models, at most ``max_labelled``
labelled documents, a fifth of them for calibration) gives every document a posterior over domains.  Projected-gradient least squares
then fits nonnegative document rates so that the expected token totals of the domains match the
targets.  The state of the iteration is the short list of past steps: a document's rate is a fold of
these over its posterior, so each iteration is one aggregation over a table of a few numbers per
document and the driver sees one total for each domain.

A document with rate r is emitted floor(r) times and once more with probability r - floor(r), by a
hash of its id and text, so rows without an id are drawn apart; the hash is salted, so that the draw does not
depend on that of importance resampling, which hashes the same.

Null and blank texts have no tokens and the posterior of a text without telling words.  Rows that agree in
id and text get the same result; extra columns are ignored by :func:`mix` and kept by
:func:`emit_copies`, whatever their names; an empty table gives an empty result.  Without labels all
posteriors are the same.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .common import fresh, join_checked, materialize, release

#: Domains, told by ``labels``: good text, text of low quality, toxic text.
DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.90, "low": 0.04, "toxic": 0.06}
MOST_RATE = 4.0  # epochs of a document at most; None for no bound
MISS = 0.01
TEMPERATURE = 0.5  # before calibration
ORDER = 1  # n-grams of the classifier
STEPS = 25
TOLERANCE = 1e-4
SEED = 42


def domain_kind() -> Column:
    toxic = F.coalesce("toxic", F.lit(0)) == 1
    return F.when(F.col("quality").isNull(), None).when(toxic, 2).when(F.col("quality") == 0, 1).otherwise(0)


def calibrate(scores: np.ndarray, kinds: np.ndarray, prior: np.ndarray, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Temperature and offsets with which the softmax of the scores fits held-out labels best:
    gradient descent on the cross-entropy, drawn a little towards the prior."""
    n = len(prior)
    log_temperature, offsets = np.log(TEMPERATURE), np.log(prior)
    if not len(kinds):
        return TEMPERATURE, offsets
    scores, own = np.clip(scores, -60, 60), np.eye(n)[kinds]
    for r in range(rounds):
        t = np.exp(log_temperature)
        p = _softmax(offsets + t * scores)
        slip = (p - own) / len(kinds)
        pull = 0.001 * (offsets - np.log(prior))
        step = 2.0 if r < rounds // 2 else 0.5
        offsets = offsets - step * (slip.sum(0) + pull)
        log_temperature = np.clip(log_temperature - step * 0.1 * t * (slip * scores).sum(), np.log(0.05), np.log(2.0))
    return float(np.exp(log_temperature)), offsets - offsets.mean()


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def posterior_columns(temperature: float, offsets: Sequence[float]) -> list[Column]:
    """Softmax of the columns ``s0, s1, ...``."""
    n = len(offsets)
    x = [F.lit(float(offsets[k])) + F.lit(temperature) * F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col(f"s{k}"))) for k in range(n)]
    top = F.greatest(*x) if n > 1 else x[0]
    weights = [F.exp(v - top) for v in x]
    whole = sum(weights[1:], weights[0])
    return [(w / whole).alias(f"p{k}") for k, w in enumerate(weights)]


def _scores(ratios, n: int):
    def run(batches):
        table = ratios.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = [ngrams.score(t, table, ORDER)[1] for t in texts]
            tokens = [len((t or "").encode().split()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(tokens, pa.int64()), *[pa.array([f[k] for f in found], pa.float64()) for k in range(n)]],
                names=["doc_id", "th", "kind", "fold", "tokens", *(f"s{k}" for k in range(n))],
            )
        release()

    return run


def rate_column(steps: Sequence[Sequence[float]], most: float | None, domains: int) -> Column:
    """Rate after the given steps: from 1, less the posterior's share of each step, kept in bounds."""
    rate = F.lit(1.0)
    for step in steps:
        move = sum((F.col(f"p{k}") * F.lit(float(step[k])) for k in range(domains)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate - move)
        rate = rate if most is None else F.least(F.lit(float(most)), rate)
    return rate


@dataclass(frozen=True)
class Fit:
    """Steps that make the rates, expected totals by domain wanted and reached, and why it stopped:
    ``matched``, ``bounds`` (the bounds on rates allow no closer match), ``steps`` (the most steps were
    taken) or ``empty``."""

    steps: list[list[float]]
    goal: list[float]
    reached: list[float]
    reason: str

    @property
    def error(self) -> float:
        """Largest miss of a domain as a share of the whole target."""
        return max((abs(g - r) for g, r in zip(self.goal, self.reached, strict=True)), default=0.0) / (sum(self.goal) or 1.0)


def fit_rates(members: DataFrame, shares: Sequence[float], most: float | None = MOST_RATE, budget: float | None = None) -> Fit:
    """Projected gradient for ``members`` (``tokens, p0, p1, ...``).  ``budget`` is the total of the
    targets, by default that of the corpus."""
    n = len(shares)
    total = lambda e: F.coalesce(F.sum(F.col("tokens") * e), F.lit(0.0))
    first = members.agg(*[total(F.col(f"p{i}") * F.col(f"p{j}")) for i in range(n) for j in range(n)], total(F.lit(1.0))).first()
    size = float(first[n * n])
    if not size:
        return Fit([], [0.0] * n, [0.0] * n, "empty")
    goal = np.array(shares, float) / sum(shares) * (size if budget is None else budget)
    # Scaling each document by its tokens and the domains by this inverse makes steps near-exact.
    metric = np.linalg.inv(np.array(first[: n * n], float).reshape(n, n) + np.eye(n) * size * 1e-9)
    steps: list[list[float]] = []
    best, kept, improved, reached, reason = np.inf, 0, 0, goal, "steps"
    for _ in range(STEPS):
        rate = rate_column(steps, most, n)
        now = np.array(members.agg(*[total(F.col(f"p{k}") * rate) for k in range(n)]).first(), float)
        error = float(np.abs(now - goal).max() / goal.sum())
        if error < best:
            kept, reached = len(steps), now
        if error < TOLERANCE:
            reason = "matched"
            break
        if error >= best - TOLERANCE / 10 and len(steps) - improved >= 4:
            reason = "bounds"
            break
        if error < best - TOLERANCE / 10:
            improved = len(steps)
        best = min(best, error)
        steps.append((metric @ (now - goal)).tolist())
    return Fit(steps[:kept], goal.tolist(), reached.tolist(), reason)


def classify(docs: DataFrame, labels: DataFrame, max_labelled: int = ngrams.MAX_LABELLED) -> DataFrame:
    """``doc_id, th, tokens`` and posteriors ``p0, p1, ...`` of every row (``doc_id, text``)."""
    n = len(DOMAINS)
    sample = materialize(ngrams.labelled_sample(labels, domain_kind(), max_labelled), "labelled")
    sizes = dict(sample.groupBy("kind").count().collect())
    prior = np.array([sizes.get(k, 0) + 1.0 for k in range(n)]) / (sum(sizes.values()) + n)
    ratios = ngrams.log_ratios(ngrams.gram_counts(docs, sample, n, ORDER))
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(ratios.transpose(1, 2, 0), np.float32))  # a model of fixed size
    schema = "doc_id long, th long, kind int, fold int, tokens long, " + ", ".join(f"s{k} double" for k in range(n))
    known = docs.join(F.broadcast(sample), "doc_id", "left").select("doc_id", F.xxhash64("text").alias("th"), "text", "kind", "fold")
    scored = materialize(known.mapInArrow(_scores(shared, n), schema), "scores")
    held = scored.where("fold = 1").groupBy("doc_id").agg(F.min("kind").alias("kind"), *[F.min(f"s{k}").alias(f"s{k}") for k in range(n)]).collect()  # the sample at most
    temperature, offsets = calibrate(np.array([r[2:] for r in held], float).reshape(-1, n), np.array([r["kind"] for r in held], int), prior)
    return materialize(scored.select("doc_id", "th", "tokens", *posterior_columns(temperature, offsets)), "members")


def mix(
    docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, most_rate: float | None = MOST_RATE, first_scale: float | None = None,
    max_labelled: int = ngrams.MAX_LABELLED, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, th, tokens, p_<domain>..., rate, copies`` of every row.

    The targets' total is that of the corpus or, with ``first_scale``, such that the first domain gets
    so many times the tokens that the corpus has of it: from 1 on its documents stay and are repeated,
    and only the others are thinned to their share of it.  Warns if the bounds on rates leave a domain
    more than ``MISS`` of the total away from its target."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    members = classify(rows, labels, max_labelled)
    shares = [float(targets.get(d, 0.0)) for d in DOMAINS]
    budget = None
    if first_scale is not None and shares[0] > 0:
        held = members.agg(F.coalesce(F.sum(F.col("tokens") * F.col("p0")), F.lit(0.0))).first()[0]
        budget = first_scale * float(held) / shares[0] * sum(shares)
    fit = fit_rates(members, shares, most_rate, budget)
    if fit.error > MISS:
        warnings.warn(f"targets missed by {fit.error:.1%} of the total ({fit.reason}): wanted {fit.goal}, reached {fit.reached}", stacklevel=2)
    uniform = F.pmod(F.xxhash64(F.lit("mixing"), "doc_id", "th", F.lit(seed)), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))
    rated = members.withColumn("rate", rate_column(fit.steps, most_rate, len(DOMAINS)))
    copies = (F.floor("rate") + F.when(uniform < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long")
    return rated.select("doc_id", "th", "tokens", *[F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", copies.alias("copies"))


def emit_copies(docs: DataFrame, rated: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` as often as :func:`mix` says, with all their columns."""
    i, h, n = fresh(docs, "mixed", "th", "copies")
    changed = rated.where("copies <> 1").select(F.col("doc_id").alias(i), F.col("th").alias(h), F.col("copies").alias(n)).distinct()
    changed = materialize(changed, "copies")
    on = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col(h))
    joined = join_checked(docs, changed, on, "left")
    times = F.array_repeat(F.lit(0), F.coalesce(n, F.lit(1)).cast("int"))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(times).alias(n)).drop(n)
