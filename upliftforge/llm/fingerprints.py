"""Threshold-scaled document sketches.

A sketch keeps every hash of a text's word shingles that lies below a fixed share of the hash range, so its size
follows the text's, a union of sketches is the sketch of the union, and containment can be estimated between texts of
very different lengths.  So that short texts are told apart too, the ``least`` smallest hashes are always
kept; that rule survives unions as well.  A sketch with more hashes than ``least`` is complete below the
share, one with fewer holds all hashes, and one with just ``least`` is complete up to its largest; two sketches
are compared below the lesser of their bounds.

:func:`compare_edits` gives each document and its edited text, which borrows from the next document.  Texts are shuffled once,
into ranges of descending id whose first keys are exact; each first document is sent to the range before it
too, so every task meets a document's successor right behind it and holds two texts at a time.

Null texts count as empty.  Texts with fewer words than a shingle give one hash of all their words, those without words an empty sketch,
which is as good as another empty one (1) and like no other (0).  Rows without an id come last; rows with the same id follow the hash of
their texts, and repeated rows each other.  Extra columns are ignored; an empty table gives an empty result; a single document is its own successor.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, join_checked, release

WORDS, SCALE, LEAST, SEED = 5, 8, 8, 42
RANGE_BYTES = 64 << 20
EMPTY = np.zeros(0, np.uint64)
RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "jaccard_edited double, jaccard_next double"
)


def sketch(text: str | None, words: int = WORDS, scale: int = SCALE, least: int = LEAST, seed: int = SEED) -> np.ndarray:
    """Kept hashes in order: XXH64 of shingles of lower-cased (A-Z) words between ASCII white space."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return EMPTY
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, seed)], np.uint64)
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    begin = (end - size)[: len(found) - words + 1].tolist()
    hashes = np.unique(np.array([digest(joined[s:e], seed) for s, e in zip(begin, end[words - 1 :].tolist(), strict=True)], np.uint64))
    return hashes[: max(int(np.searchsorted(hashes, np.uint64((1 << 64) // scale))), min(least, len(hashes)))]


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE, least: int = LEAST) -> np.ndarray:
    """The sketch of two texts' shingles together."""
    both = np.union1d(a, b)
    return both[: max(int(np.searchsorted(both, np.uint64((1 << 64) // scale))), min(least, len(both)))]


def _bound(a: np.ndarray, scale: int, least: int) -> int:
    """The sketch holds all hashes of its text up to this one."""
    below = (1 << 64) // scale - 1
    if len(a) < least:
        return (1 << 64) - 1
    return max(below, int(a[least - 1])) if len(a) == least else below


def likeness(a: np.ndarray, b: np.ndarray, scale: int = SCALE, least: int = LEAST) -> tuple[float, float]:
    """Estimated containment of the smaller in the larger set of shingles, and Jaccard similarity."""
    if len(a) == len(b) and (a == b).all():
        return 1.0, 1.0
    bound = np.uint64(min(_bound(a, scale, least), _bound(b, scale, least)))
    a, b = a[: np.searchsorted(a, bound, "right")], b[: np.searchsorted(b, bound, "right")]
    if not len(a) or not len(b):
        return 0.0, 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / min(len(a), len(b)), common / (len(a) + len(b) - common)


def to_text(a: np.ndarray) -> str:
    """Sixteen lower-case hexadecimal digits for each hash, in order."""
    return a.astype(">u8").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def edited_text(text: str, following: str) -> str:
    """The text with its last third, rounded down, replaced by as much of the following one's beginning."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def fingerprints(docs: DataFrame, words: int = WORDS, scale: int = SCALE, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every row."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            prints = [to_text(sketch(t.as_py(), words, scale, least)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])
        release()

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def hashes(prints: DataFrame, *keep: str, fingerprint_col: str = "fingerprint") -> DataFrame:
    """The columns ``keep`` and one ``hash`` of sixteen digits a row."""
    digits = F.expr(f"transform(sequence(0, cast(length(`{fingerprint_col}`) / 16 as int) - 1), k -> substring(`{fingerprint_col}`, 16 * k + 1, 16))")
    return prints.where(F.length(fingerprint_col) > 0).select(*keep, F.explode(digits).alias("hash"))


def merged(prints: DataFrame, *by: str, scale: int = SCALE) -> DataFrame:
    """Sketches of whole groups (sources, languages), as rows ``by, hash`` below the fixed share: a union, so groups of
    any size are merged by a shuffle and none is held in one place."""
    return hashes(prints, *by).where(F.col("hash") < f"{(1 << 64) // scale:016x}").distinct()


def contained(prints: DataFrame, group: DataFrame, key: str = "doc_id", scale: int = SCALE) -> DataFrame:
    """``key, n_hashes, contained``: the estimated share of each document's shingles that a merged sketch ``group``
    (``hash``) holds, for documents with hashes below the fixed share."""
    own = hashes(prints, key).where(F.col("hash") < f"{(1 << 64) // scale:016x}")
    found = join_checked(own, group.select("hash").distinct().withColumn("hit", F.lit(1)), "hash", "left")
    return found.groupBy(key).agg(F.count("*").alias("n_hashes"), (F.count("hit") / F.count("*")).alias("contained"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def _firsts(keys: DataFrame, ranges: int) -> list[tuple[int, int, int]]:
    """The first key of each range when the keys, in order, are cut into so many of about the same size: a row for each range comes to
    the driver."""
    ordered = keys.repartitionByRange(ranges, "absent", "down", "th").groupBy(F.spark_partition_id()).agg(F.min(F.struct("absent", "down", "th")).alias("first"))
    return sorted(tuple(r["first"]) for r in ordered.collect())


def _place(firsts: list[tuple[int, int, int]]):
    """Rows with their range; the first ones go to the end of the range before, too."""

    def run(batches):
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            at = [bisect_right(firsts, key) - 1 for key in keys]
            took, ranges, ahead, sent = list(range(len(keys))), list(at), [False] * len(keys), set()
            for k, (key, a) in enumerate(zip(keys, at, strict=True)):
                if firsts[a] == key and key not in sent:
                    sent.add(key)
                    took.append(k)
                    ranges.append((a - 1) % len(firsts))
                    ahead.append(True)
            out = batch.take(pa.array(took, pa.int64())) if len(took) > len(keys) else batch
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(ahead), *out.columns], names=["range", "ahead", *batch.schema.names])

    return run


def compare_edits(
    docs: DataFrame, words: int = WORDS, scale: int = SCALE, least: int = LEAST, range_bytes: int = RANGE_BYTES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, jaccard_edited,
    jaccard_next`` of every row; ``near_*`` is the containment of the smaller sketch in the larger."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = _rows(docs, id_col, text_col)
    keyed = rows.select(
        F.col("doc_id").isNull().cast("int").alias("absent"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long")).alias("down"), F.xxhash64("text").alias("th"), "doc_id", "text"
    )
    taken = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-taken // range_bytes))
    firsts = _firsts(keyed.select("absent", "down", "th"), 4 * parts)
    if not firsts:
        return spark.createDataFrame([], RESULT)

    def done(doc_id: int | None, text: str, own: np.ndarray, following: str, other: np.ndarray) -> tuple:
        changed = edited_text(text, following)
        edited = own if changed == text else sketch(changed, words, scale, least)
        (near_e, jaccard_e), (near_n, jaccard_n) = likeness(own, edited, scale, least), likeness(own, other, scale, least)
        return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), to_text(own), to_text(edited), near_e, near_n, jaccard_e, jaccard_n

    def run(batches) -> Iterator[pa.RecordBatch]:
        held = None  # range, id, text and sketch of the row before
        for batch in batches:
            out = []
            for at, ahead, doc_id, text in zip(*(batch.column(c) for c in ("range", "ahead", "doc_id", "text")), strict=True):
                at, ahead, doc_id, text = at.as_py(), ahead.as_py(), doc_id.as_py(), text.as_py()
                if ahead and (held is None or held[0] != at):  # a second copy of a repeated first row
                    continue
                own = held[3] if held is not None and held[2] == text else sketch(text, words, scale, least)
                if held is not None and held[0] == at:
                    out.append(done(*held[1:], text, own))
                held = None if ahead else (at, doc_id, text, own)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(_TYPES), _TYPES, strict=True)], names=_NAMES)
        release()

    placed = keyed.mapInArrow(_place(firsts), "range int, ahead boolean, absent int, down long, th long, doc_id long, text string")
    ordered = placed.repartition(parts, "range").sortWithinPartitions("range", "ahead", "absent", "down", "th", "text").select("range", "ahead", "doc_id", "text")
    return ordered.mapInArrow(run, RESULT)


_NAMES = [c.split()[0] for c in RESULT.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in RESULT.split(", ")]
