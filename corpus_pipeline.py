"""Corpus pipeline: five operators of :mod:`upliftforge.llm` one after the other.

Each stage is a function of ``(spark, docs, sf_dir)``; what it returns is written as Parquet to the
shared folder and read again as the ``docs`` of the next.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upliftforge.llm import importance, line_dedup, mixing, simhash
from upliftforge.llm.common import fresh, materialize, table, tokenizer_path
from upliftforge.llm.pieces import encode_documents

#: Token shares by domain after mixing.  The stages before leave toxic text of good quality, some 12 %
#: on the test tables; it is thinned to half of that.
PIPELINE_TARGETS = {"clean": 0.93, "low": 0.01, "toxic": 0.06}
#: Clean text is repeated a little, so that no clean document has a rate below one.
CLEAN_SCALE, MOST_RATE = 1.05, 2.0


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling does not draw go."""
    return importance.keep_drawn(docs, importance.resample(docs, table(spark, sf_dir, "labels")))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents of which nothing is left."""
    n_lines, n_deleted = fresh(docs, "n_lines", "n_deleted")
    deduped = line_dedup.dedup_lines(docs, lines_col=n_lines, deleted_col=n_deleted)
    deduped = deduped.where((F.col(n_deleted) == 0) | (F.col(n_deleted) < F.col(n_lines)))
    if "n_chars" in docs.columns:
        deduped = deduped.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return deduped.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_first(docs, simhash.near_duplicates(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domains get their target share of the tokens: documents of those with too much are thinned,
    those of the others repeated."""
    rated = mixing.mix(docs, table(spark, sf_dir, "labels"), PIPELINE_TARGETS, MOST_RATE, CLEAN_SCALE)
    return mixing.emit_copies(docs, rated)


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with digests of the ids and of the text decoded from them.  The memo is
    smaller than by default, because the executors have the memory of earlier stages to bear."""
    return encode_documents(docs, tokenizer_path("piece_bpe_32k.model"), with_ids=True, memo_entries=80_000).drop("decoded")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("SimHash near-dedup", near_deduplication),
    ("mixing", source_mixing),
    ("SentencePiece", tokenization),
]

#: Fitted models and greedy merging are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs
