"""Token counts with a digest cache.

The digest of a text's normal form and the digest of the tokenizer's file are the key of a stored
count.  What is shuffled are digests, not texts: the rows' digests are grouped, looked up in the cache, and
one row of each that the cache lacks is named.  These rows are encoded where they are read, provided that
the shorter of two lists, of the rows to encode or of the rows to pass over, is small enough for a
broadcast; beyond that bound the texts to encode are found by a shuffled join.  Their counts are appended
to the cache, and every document takes its count from there.

The cache is a folder of batches.  A run writes its batch under a hidden name and renames it when it is
complete, so runs side by side and runs that break off leave whole batches only; a digest that two runs
have counted is there twice with the same count.

The normal form keeps the count: for tokenizers that drop white space between words and lower-case letters
(this is read from the file), runs of ASCII white space become one space and A-Z become a-z.  Texts that
hold ``<|``, which all strings of special tokens must hold for that, or a combining mark, which may compose
with the letter before it, are their own form, and so is every text for other tokenizers.

Null texts count as empty (0 tokens).  Repeated rows give repeated results, extra columns are
ignored, an empty table gives an empty result.  Very long texts are encoded in parts that end at
spaces, which no token crosses (whole, for other tokenizers).
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Iterator
from importlib import metadata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bound_batches, join_checked, materialize, release, row_bytes

CACHE_SCHEMA = "version string, digest binary, n_tokens long"
NORMAL_FORM = "ascii-space-case/2"
SPECIAL = "<|"
PART_CHARS = 50_000
MEMO_WORDS = 500_000
MEMO_CHARS = 48


def specials(spec: dict) -> list[str]:
    """Strings that the tokenizer takes out of a text before anything else."""
    return [t["content"] for t in spec.get("added_tokens") or [] if t["content"]]


def folds(spec: dict) -> bool:
    """Whether a tokenizer lower-cases letters and takes white space for a mere separator, and all its special strings
    hold the mark by which texts with them are told."""
    if any(SPECIAL not in s for s in specials(spec)):
        return False
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    spaces = any(s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " " for s in steps)
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    words = first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))
    return spaces and words and any(s["type"] == "Lowercase" for s in steps)


def normal_form(text):
    folded = F.translate(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.contains(text, F.lit(SPECIAL)) | text.rlike(r"\p{M}"), text).otherwise(folded)


def parts(text: str, most: int = PART_CHARS) -> Iterator[str]:
    """The text in parts of about ``most`` characters that end before a space, if there is any."""
    at = 0
    while len(text) - at > most:
        cut = text.find(" ", at + most)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


class _Counter:
    """Counts by word: no token crosses a space, so a text's count is the sum over its words, and
    each word is encoded once as long as the bounded memo keeps it."""

    def __init__(self, blob: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(blob.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_word = folds(json.loads(blob))
        self.memo: dict[str, int] = {}

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, form: str) -> int:
        if not self.by_word:
            return self._encode([form])[0]
        if SPECIAL in form:
            return sum(self._encode([part])[0] for part in parts(form))
        words = form.split(" ")
        memo = self.memo
        new = list({w for w in words if w not in memo})
        long = {w for w in new if len(w) > MEMO_CHARS}
        if len(memo) + len(new) > MEMO_WORDS:
            memo.clear()
            new = list(set(words))
        for at in range(0, len(new), 1000):
            memo.update(zip(new[at : at + 1000], self._encode(new[at : at + 1000]), strict=True))
        total = sum(map(memo.__getitem__, words))
        for w in long:
            memo.pop(w, None)
        return total

    def counts(self, forms: list[str]) -> list[int]:
        return [self.count(f) for f in forms]


_COUNTERS: dict[str, _Counter] = {}


def _counter(blob: bytes) -> _Counter:
    key = hashlib.sha256(blob).hexdigest()
    if key not in _COUNTERS:
        _COUNTERS[key] = _Counter(blob)
    return _COUNTERS[key]


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored_counts(spark: SparkSession, cache_path: str, version: str) -> DataFrame | None:
    """``digest, n_tokens`` of the cache's whole batches, or None if it has none."""
    batches = f"{cache_path}/batch-*"
    pattern, fs = _file_system(spark, batches)
    if not len(fs.globStatus(pattern) or ()):
        return None
    return spark.read.schema(CACHE_SCHEMA).parquet(batches).where(F.col("version") == version).select("digest", "n_tokens")


#: Settled batches beyond this are written as one; one is settled when no run that began before it can still be reading.
MOST_BATCHES, SETTLED_SECONDS = 16, 86_400


def compact(spark: SparkSession, cache_path: str, most: int = MOST_BATCHES, settled: float = SETTLED_SECONDS) -> None:
    """Write the settled batches as one if there are over ``most``, and remove hidden folders of runs that broke off as long
    ago.  The one is whole before the others go, so readers find each digest, some of them twice."""
    pattern, fs = _file_system(spark, f"{cache_path}/batch-*")
    before = (time.time() - settled) * 1000
    old = lambda found: [str(f.getPath()) for f in found or () if f.getModificationTime() <= before]
    batches, left = old(fs.globStatus(pattern)), old(fs.globStatus(_file_system(spark, f"{cache_path}/.writing-*")[0]))
    if len(batches) > most:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(*batches)
        append_counts(stored.groupBy("version", "digest").agg(F.max("n_tokens").alias("n_tokens")), cache_path)
        left += batches
    for path in left:
        fs.delete(_file_system(spark, path)[0], True)


def append_counts(counts: DataFrame, cache_path: str) -> DataFrame:
    """Add a batch to the cache: written under a hidden name, then renamed."""
    spark, name = counts.sparkSession, uuid.uuid4().hex
    hidden, whole = f"{cache_path}/.writing-{name}", f"{cache_path}/batch-{name}"
    counts.write.parquet(hidden)
    source, fs = _file_system(spark, hidden)
    target, _ = _file_system(spark, whole)
    if not fs.rename(source, target):
        raise OSError(f"could not rename {hidden}")
    return spark.read.schema(CACHE_SCHEMA).parquet(whole)


def count_tokens(
    docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row; fills the cache on the way."""
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as file:  # a fixed file of the installation, under two megabytes
        blob = file.read()
    version = hashlib.sha256(blob + f"{NORMAL_FORM} {metadata.version('tokenizers')}".encode()).hexdigest()
    shared = spark.sparkContext.broadcast(blob)
    bound_batches(spark)
    compact(spark, cache_path)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    form = normal_form(F.col("text")) if folds(json.loads(blob)) else F.col("text")
    digest = F.unhex(F.sha2(form, 256)).alias("digest")
    keys = rows.select("doc_id", F.xxhash64("text").alias("th"), F.octet_length("text").cast("long").alias("n_bytes"), digest)
    keys = materialize(keys, "digests")

    # One row of each digest, by its id and the hash of its text, and the count if it is stored.
    place = F.struct(F.col("doc_id").isNull().alias("anonymous"), "doc_id", "th")
    known = keys.groupBy("digest").agg(F.min(place).alias("first"))
    stored = stored_counts(spark, cache_path, version)
    if stored is None:
        known = known.withColumn("n_tokens", F.lit(None).cast("long"))
    else:
        known = known.join(stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "digest", "left")
    known = materialize(known, "known")
    misses = known.where("n_tokens is null").select("digest", F.col("first.doc_id").alias("i"), F.col("first.th").alias("h"))

    def encode(batches):
        counter = _counter(shared.value)
        for batch in batches:
            counts = counter.counts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(counts)), batch.column(0), pa.array(counts, pa.int64())], names=["version", "digest", "n_tokens"])
        counter.memo.clear()  # the worker may serve other stages next
        release()

    taken, skipped = misses.agg(F.sum(row_bytes(misses))).first()[0] or 0, None
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.xxhash64("text") == F.col("h"))
    if taken > most_bytes:
        other = join_checked(keys, misses, "digest", "left", most_bytes).where(F.col("h").isNull() | ~F.col("doc_id").eqNullSafe(F.col("i")) | (F.col("th") != F.col("h")))
        skipped = materialize(other.select(F.col("doc_id").alias("i"), F.col("th").alias("h")).distinct(), "skipped")
        if (skipped.agg(F.sum(row_bytes(skipped))).first()[0] or 0) > most_bytes:
            skipped = None
    if skipped is not None:
        texts = rows.join(F.broadcast(skipped), same, "left_anti").select(digest, form.alias("form"))
    else:
        texts = (rows.join(F.broadcast(misses) if taken <= most_bytes else misses, same)).select("digest", form.alias("form"))
    if taken:  # else nothing is missing, and no batch is added
        fresh = append_counts(texts.mapInArrow(encode, CACHE_SCHEMA), cache_path)
    else:
        fresh = spark.createDataFrame([], CACHE_SCHEMA)

    # Rows that repeat were encoded as often.  Written before it is joined, so that a text with very
    # many copies can be split.
    counts = known.where("n_tokens is not null").select("digest", "n_tokens").union(fresh.select("digest", "n_tokens"))
    counts = materialize(counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    out = keys.select("doc_id", "n_bytes", "digest").join(counts, "digest", "left")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
