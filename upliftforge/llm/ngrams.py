"""Hashed n-gram generative models of classes of documents.

For each hashed word n-gram, the number of documents that hold it, over all documents and over a
bounded sample of labelled ones, gives for each class the log ratio of its model to that of all
text.  Documents are counted, not occurrences, because occurrences within one document are not
independent.  Words are runs of letters; each symbol is a word of its own.  The shares of symbols,
of bigrams that repeat a word and of capitals are features of their own, by level, with heavier weight.  A log
ratio within sampling error, or small, counts as zero, so long clean texts do not gather noise.
Each n-gram has a bucket in two tables and takes the milder of their ratios, so that a rare word
that shares a bucket with a telling one is not taken for it.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, release

#: Buckets of a table for words, for longer n-grams, and for the shape of a text.
WORD_BUCKETS, GRAM_BUCKETS = 1 << 18, 1 << 17
LEVELS = (0.02, 0.1, 0.3, 0.6)  # shares at which a shape changes
SHAPES = 3 * (len(LEVELS) + 1)
BUCKETS = WORD_BUCKETS + GRAM_BUCKETS + SHAPES
CHUNK = 1 << 13
#: At most so many labelled documents are fitted on or calibrated with, those of least hash.
MAX_LABELLED = 20_000
PSEUDO = 2.0
LEAST_RATIO = 0.7
LEAST_Z = 2.5
SHAPE_WEIGHT = 2.0
SHAPE_WORDS = 8  # shorter texts have no shape
PART_BYTES = 1 << 20

#: Symbols that are words; digits and other marks separate words.
SYMBOLS = b"#$%&*|<>!"
SEPARATOR, LETTER, SYMBOL = 0, 1, 2
KIND = np.array([SYMBOL if c in SYMBOLS else LETTER if c >= 0x80 or chr(c).isalpha() else SEPARATOR for c in range(256)], np.uint8)
LOWER = np.array([c + 32 if ord("A") <= c <= ord("Z") else c for c in range(256)], np.uint64) + np.uint64(1)
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: Odd powers that weigh the bytes of a word by their place, used again after so many bytes.
LONG_WORD = 1 << 12
with np.errstate(over="ignore"):
    POWERS = np.cumprod(np.full(LONG_WORD, 0x9E3779B97F4A7C15, np.uint64))


def word_hashes(whole: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in ASCII lower case, in order, and which of them are symbols."""
    data = np.frombuffer(whole, np.uint8)
    kind = KIND[data]
    symbol, letter = kind == SYMBOL, kind == LETTER
    first = symbol | letter
    first[1:] &= symbol[1:] | ~letter[:-1]  # a letter after a letter goes on with its word
    at = np.nonzero(kind)[0]
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, bool)
    starts = np.nonzero(first[at])[0]
    sizes = np.diff(np.append(starts, len(at)))
    place = np.arange(len(at)) - np.repeat(starts, sizes)
    hashes = np.add.reduceat(LOWER[data[at]] * POWERS[place & (LONG_WORD - 1)], starts)
    hashes ^= hashes >> np.uint64(31)
    return hashes * np.uint64(0xD6E8FEB86659FD93), symbol[at[starts]]


def _spread(hashes: np.ndarray, span: int) -> np.ndarray:
    """Numbers below ``span`` from the upper halves of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(span)) >> np.uint64(32)


def present(text: str | None, order: int = 2) -> tuple[int, np.ndarray]:
    """Number of words of a whole text, and for each of its distinct n-grams up to ``order`` the
    buckets in the two tables."""
    whole = (text or "").encode()
    found, at = [], 0
    while at < len(whole):  # a very long text in parts that end at a space
        end = whole.find(b" ", at + PART_BYTES)
        end = len(whole) if end < 0 else end
        found.append(word_hashes(whole[at:end]))
        at = end
    hashes = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.uint64)
    n = len(hashes)
    if not n:
        return 0, np.empty((2, 0), np.int64)
    places, gram = [], hashes
    for k in range(order):
        if k:
            gram = gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:]
        one = np.unique(gram)
        two = (one ^ (one >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        start, span = (WORD_BUCKETS, GRAM_BUCKETS) if k else (0, WORD_BUCKETS)
        places.append(np.stack([_spread(one, span), _spread(two, span)]).astype(np.int64) + start)
    if n >= SHAPE_WORDS:
        symbols = sum(int(f[1].sum()) for f in found) / n
        repeats = float((hashes[1:] == hashes[:-1]).mean())
        capitals = 1 - len(whole.translate(None, CAPITALS)) / len(whole)
        base, step = WORD_BUCKETS + GRAM_BUCKETS, len(LEVELS) + 1
        shape = [base + k * step + bisect.bisect(LEVELS, share) for k, share in enumerate((symbols, repeats, capitals))]
        places.append(np.array([shape, shape]))
    return n, np.concatenate(places, axis=1)


def labelled_sample(labels: DataFrame, kind: Column, most: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, kind, fold``: labelled documents of least hash, one label each; ``fold`` 0 is for
    fitting, 1, a fifth, for calibration.  At most ``most`` rows, so it may be broadcast."""
    ids = F.col("doc_id").cast("long")
    named = labels.select(ids.alias("doc_id"), kind.cast("int").alias("kind")).where("doc_id is not null and kind is not null")
    one = named.groupBy("doc_id").agg(F.min("kind").alias("kind")).withColumn("hash", F.xxhash64("doc_id", F.lit("sample")))
    chosen = one.orderBy("hash", "doc_id").limit(most)
    return chosen.select("doc_id", "kind", (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)) == 0).cast("int").alias("fold"))


def _count_batches(classes: int, order: int):
    def run(batches):
        counts, documents = np.zeros((classes + 1, 2, BUCKETS), np.int64), np.zeros(classes + 1, np.int64)
        for batch in batches:
            for text, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, held = present(text, order)
                for row in [0] if kind is None else [0, kind + 1]:
                    np.add.at(counts[row, 0], held[0], 1)
                    np.add.at(counts[row, 1], held[1], 1)
                    documents[row] += n > 0
        flat = counts.reshape(classes + 1, 2 * BUCKETS)
        yield _vectors(np.hstack([flat, documents[:, None]]))
        release()

    return run


def _vectors(counts: np.ndarray) -> pa.RecordBatch:
    rows = [(r, c) for r in range(len(counts)) for c in range(0, counts.shape[1], CHUNK) if counts[r, c : c + CHUNK].any()]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r for r, _ in rows], pa.int32()),
            pa.array([c for _, c in rows], pa.int32()),
            pa.array([counts[r, c : c + CHUNK].astype(np.int32).tobytes() for r, c in rows], pa.binary()),
        ],
        names=["row", "chunk", "counts"],
    )


def _sum_batches(kind):
    """Add up count vectors as they stream by; memory is that of one model at most."""

    def run(batches):
        yield _summed(batches, kind)
        release()

    return run


def _summed(batches, kind) -> pa.RecordBatch:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for r, c, v in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            v = np.frombuffer(v, kind).astype(np.int64)
            sums[r, c] = sums[r, c] + v if (r, c) in sums else v
    keys = sorted(sums)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary())],
        names=["row", "chunk", "counts"],
    )


def gram_counts(docs: DataFrame, sample: DataFrame, classes: int, order: int = 2) -> np.ndarray:
    """Documents with each n-gram among all ``docs`` (row 0) and in each class of the sample's fold 0,
    by the buckets of both tables; the last column has the number of documents.  One pass; what
    reaches the driver has a fixed size."""
    bound_batches(docs.sparkSession)
    fit = sample.where("fold = 0").select("doc_id", "kind")
    known = docs.join(F.broadcast(fit), "doc_id", "left").select("text", "kind")
    return sum_vectors(known.mapInArrow(_count_batches(classes, order), VECTORS), classes + 1, 2 * BUCKETS + 1)


VECTORS = "row int, chunk int, counts binary"


def sum_vectors(vectors: DataFrame, rows: int, width: int) -> np.ndarray:
    """The sum of count vectors that tasks give in chunks (:func:`_vectors`), added up in two steps."""
    spark = vectors.sparkSession
    salted = vectors.withColumn("salt", F.spark_partition_id() % 16)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    once = salted.repartition(parts, "row", "chunk", "salt").drop("salt").mapInArrow(_sum_batches(np.int32), VECTORS)
    twice = once.repartition(parts, "row", "chunk").mapInArrow(_sum_batches(np.int64), VECTORS)
    counts = np.zeros((rows, width), np.int64)
    for r in twice.collect():  # rows * width numbers
        own = np.frombuffer(bytes(r["counts"]), np.int64)
        counts[r["row"], r["chunk"] : r["chunk"] + len(own)] += own
    return counts


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """For each class and bucket, the log of the class model over the model of all text."""
    total, raw = float(counts[0, -1]), counts[0, :-1].astype(float)
    out = np.zeros((len(counts) - 1, 2 * BUCKETS))
    for k, own in enumerate(counts[1:]):
        expected = own[-1] * raw / max(total, 1.0)
        ratio = np.log((own[:-1] + PSEUDO) / (expected + PSEUDO))
        z = np.abs(own[:-1] - expected) / np.sqrt(expected + PSEUDO)
        out[k] = np.where((np.abs(ratio) >= LEAST_RATIO) & (z >= LEAST_Z), ratio, 0.0)
    out = out.reshape(-1, 2, BUCKETS)
    out[:, :, -SHAPES:] *= SHAPE_WEIGHT
    return out


def score(text: str | None, ratios: np.ndarray, order: int = 2) -> tuple[int, np.ndarray]:
    """Number of words and the sum of log ratios for each class (``ratios``: table, bucket, class)."""
    n, held = present(text, order)
    one, two = ratios[0, held[0]], ratios[1, held[1]]
    milder = np.where(np.abs(one) <= np.abs(two), one, two)
    return n, np.where(one * two > 0, milder, 0.0).sum(0, dtype=float)
