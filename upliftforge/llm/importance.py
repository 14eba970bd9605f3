"""Quality classifier by importance resampling.

A document's weight is the ratio of two hashed n-gram generative models, one of the target text
(labelled good and not toxic) and one of all raw text: the log weight is the sum, over every occurrence
of a word or bigram in it, of the log ratio of their probabilities.  Documents are then drawn without
replacement by Gumbel top-k: the ``k`` largest sums of log weight and standard Gumbel noise stay.

``k`` is a stated count, or a stated share of the documents with words.  By default that share is the
labelled documents' share of good quality, at the upper end of its 99 % interval, so that the sampling
error of a short table of labels rejects no target text.  (Toxic documents of good quality count in the
share, but not in the target: they differ from it by a few words.)

Words are runs of letters, digits and bytes beyond ASCII, or runs of other marks; case counts.  Both
models count occurrences in ``BUCKETS`` buckets and are smoothed by ``PSEUDO`` occurrences of each bucket
at the raw rate, so that a bucket of which the labels say nothing has ratio one.  The target model is
fitted on at most ``max_labelled`` labelled documents; the raw model, the weights and the draw cover all
documents.  The k-th key is found by narrowing histograms of fixed size.

Weights of whole texts are sums over all their words, so that few documents may carry nearly all weight;
:func:`effective_sizes` tells how many.  With a ``temperature`` above one, documents are drawn in proportion to the
weight's root of that order: the same order on average, with chance deciding among more documents.

Texts without a word (null and empty ones too) have weight minus infinity and are rejected.  Rows that tie
with the last key are kept; rows with the same id and text get the same result; extra columns are ignored
by :func:`resample` and kept by :func:`keep_drawn`, whatever their names; an empty table gives an empty result.  Without
a labelled target document, every document with text is kept.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .common import bound_batches, fresh, join_checked, materialize, release

SEED = 42
BITS = 18
BUCKETS = 1 << BITS
PSEUDO = 2.0
INTERVAL = 2.58  # standard errors to the end of a 99 % interval
BINS = 1024
SMALL_BIN = 5000
PART_BYTES = 1 << 20

TEMPERATURES = tuple(2.0**k for k in range(13))

SPACE, LETTER, MARK = 0, 1, 2
KIND = np.array([SPACE if chr(c) in " \t\n\x0b\x0c\r" else LETTER if c >= 0x80 or chr(c).isalnum() else MARK for c in range(256)], np.uint8)
MIX, TAIL = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


def target_kind() -> Column:
    """0 for target documents of ``labels``, 1 for other documents of good quality, 2 for the rest."""
    toxic = F.coalesce("toxic", F.lit(0)) == 1
    return F.when(F.col("quality").isNull(), None).when(F.col("quality") != 1, 2).when(toxic, 1).otherwise(0)


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words in order: the sum of the bytes weighed by their place, mixed."""
    codes = np.frombuffer(data, np.uint8)
    kind = KIND[codes]
    at = np.nonzero(kind)[0]
    if not len(at):
        return np.empty(0, np.uint64)
    first = np.ones(len(at), bool)
    first[1:] = (kind[at][1:] != kind[at][:-1]) | (np.diff(at) > 1)
    starts = np.nonzero(first)[0]
    place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    weighed = (codes[at].astype(np.uint64) + np.uint64(1)) * ngrams.POWERS[place & (ngrams.LONG_WORD - 1)]
    hashes = np.add.reduceat(weighed, starts)
    hashes ^= hashes >> np.uint64(31)
    return hashes * MIX


def occurrences(text: str | None) -> tuple[int, np.ndarray]:
    """Number of words of a whole text, and the bucket of each occurrence of a word or bigram."""
    whole = (text or "").encode()
    found, at = [], 0
    while at < len(whole):  # a very long text in parts that end at a space
        end = whole.find(b" ", at + PART_BYTES)
        end = len(whole) if end < 0 else end
        found.append(word_hashes(whole[at:end]))
        at = end
    words = np.concatenate(found) if found else np.empty(0, np.uint64)
    pairs = (words[:-1] * TAIL + words[1:]) * MIX
    return len(words), (np.concatenate([words, pairs]) >> np.uint64(64 - BITS)).astype(np.int64)


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """For each bucket the log of its probability in the target model over that in the raw model, from
    occurrences in all text (row 0) and in the target text (row 1)."""
    raw, target = counts[0].astype(float), counts[1].astype(float)
    if not raw.sum() or not target.sum():
        return np.zeros(len(raw))
    ratio = (target + PSEUDO) / (raw * (target.sum() / raw.sum()) + PSEUDO)
    whole = (raw * ratio).sum() / raw.sum()  # so that the target model sums to one
    return np.log(ratio / whole)


def _count_batches(batches):
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for text, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            _, buckets = occurrences(text)
            np.add.at(counts[0], buckets, 1)
            if target:
                np.add.at(counts[1], buckets, 1)
    yield ngrams._vectors(counts)
    release()


def _score_batches(ratios):
    def run(batches):
        table = ratios.value
        for batch in batches:
            found = [occurrences(t) for t in batch.column(2).to_pylist()]
            weights = [float(table[b].sum()) if n else -math.inf for n, b in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array(weights, pa.float64())], names=["doc_id", "th", "n_words", "log_weight"]
            )
        release()

    return run


def importance_weights(rows: DataFrame, sample: DataFrame) -> DataFrame:
    """``doc_id, th, n_words, log_weight`` of every row of ``rows`` (``doc_id, text``); the target text is
    that of the sample's documents of kind 0."""
    spark = rows.sparkSession
    bound_batches(spark)
    target = sample.where("kind = 0").select("doc_id", F.lit(True).alias("target"))
    known = rows.join(F.broadcast(target), "doc_id", "left").select("text", "target")  # max_labelled rows at most
    ratios = log_ratios(ngrams.sum_vectors(known.mapInArrow(_count_batches, ngrams.VECTORS), 2, BUCKETS))
    shared = spark.sparkContext.broadcast(ratios)  # a model of fixed size
    hashed = rows.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return materialize(hashed.mapInArrow(_score_batches(shared), "doc_id long, th long, n_words long, log_weight double"), "weights")


def gumbel_key(seed: Column, temperature: float = 1.0) -> Column:
    """Log weight by temperature, with standard Gumbel noise, which is a function of the document and the seed."""
    uniform = (F.pmod(F.xxhash64("doc_id", "th", seed), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))
    weight = F.col("log_weight") if temperature == 1.0 else F.col("log_weight") / F.lit(float(temperature))
    return weight - F.ln(-F.ln(uniform))


def effective_sizes(weights: DataFrame, temperatures: Sequence[float] = TEMPERATURES) -> DataFrame:
    """``temperature, documents, effective``: for each temperature the squared sum of the documents' weights over the
    sum of their squares, which is the number of documents with words if all weigh the same and one if one outweighs
    the rest.  ``weights`` is a result of :func:`resample` or :func:`importance_weights`; NULL without such documents."""
    check_temperatures(temperatures)
    known = weights.where("n_words > 0").select("log_weight")
    top = F.lit(known.agg(F.max("log_weight")).first()[0]).cast("double")
    sums = [F.sum(F.exp(times * (F.col("log_weight") - top) / F.lit(float(t)))).alias(f"s{times}_{k}") for k, t in enumerate(temperatures) for times in (1, 2)]
    row = known.agg(F.count("*").alias("documents"), *sums)
    each = [F.struct(F.lit(float(t)).alias("temperature"), "documents", (F.col(f"s1_{k}") * F.col(f"s1_{k}") / F.col(f"s2_{k}")).alias("effective")) for k, t in enumerate(temperatures)]
    return row.select(F.explode(F.array(*each)).alias("e")).select("e.*")


def check_temperatures(temperatures: Sequence[float]) -> None:
    if not all(math.isfinite(t) and t > 0 for t in temperatures):
        raise ValueError("a temperature must be positive and finite")


def kth_largest(rows: DataFrame, k: int, name: str = "key") -> float:
    """The k-th largest value of a column, from histograms of at most ``BINS`` rows at a time."""
    low, high = rows.agg(F.min(name), F.max(name)).first()
    while True:
        inside = rows.where(F.col(name).between(low, high))
        if high <= low:
            return high
        place = F.least(F.floor((F.col(name) - low) / F.lit((high - low) / BINS)), F.lit(BINS - 1)).cast("int")
        bins = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(name).alias("lo"), F.max(name).alias("hi")).collect()
        for b in sorted(bins, key=lambda b: -b["bin"]):
            if k <= b["n"]:
                low, high, n = b["lo"], b["hi"], b["n"]
                break
            k -= b["n"]
        if n <= SMALL_BIN:
            values = inside.where(F.col(name).between(low, high)).orderBy(F.desc(name)).limit(k).select(name).collect()
            return values[-1][0]


def good_share(sample: DataFrame) -> float:
    """Upper end of the 99 % interval of the share of good quality among the labelled documents."""
    n, good = sample.agg(F.count("*"), F.count_if(F.col("kind") < 2)).first()
    p = (good + 1) / (n + 2)
    return min(1.0, p + INTERVAL * math.sqrt(p * (1 - p) / (n + 2)))


def resample(
    docs: DataFrame, labels: DataFrame, share: float | None = None, k: int | None = None, max_labelled: int = ngrams.MAX_LABELLED, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
    temperature: float = 1.0,
) -> DataFrame:
    """``doc_id, th, n_words, log_weight, sample_key, kept`` of every row; ``th`` is the text's hash.  ``k``
    documents are drawn, or ``share`` of those with words."""
    check_temperatures([temperature])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = materialize(ngrams.labelled_sample(labels, target_kind(), max_labelled), "labelled")
    scored = importance_weights(rows, sample)
    drawn = scored.withColumn("sample_key", gumbel_key(F.lit(seed), temperature))
    with_words = drawn.where("n_words > 0")
    targets, n = sample.where("kind = 0").count(), with_words.count()
    if k is None:
        share = share if share is not None else good_share(sample) if targets else 1.0
        k = math.ceil(share * n)
    k = min(k, n)
    kept = F.lit(False)
    if k > 0:
        last = kth_largest(with_words.withColumnRenamed("sample_key", "key"), k)
        kept = (F.col("n_words") > 0) & (F.col("sample_key") >= F.lit(last))
    return drawn.select("doc_id", "th", "n_words", "log_weight", "sample_key", kept.alias("kept"))


def keep_drawn(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`resample` kept, with all their columns."""
    i, h = fresh(docs, "id", "th")
    rejected = decisions.where("not kept").select(F.col("doc_id").alias(i), F.col("th").alias(h)).distinct()
    rejected = materialize(rejected, "rejected")
    on = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col(h))
    return join_checked(docs, rejected, on, "left_anti")
