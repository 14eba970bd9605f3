"""Queries of this subpackage: one ``opN_<name>`` per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, fingerprints, importance, line_dedup, mixing, mtree, pii, quality_rules, spelling
from .common import store_dir, table, tokenizer_path
from .pieces import encode_documents
from .secrets import scan_secrets
from .simhash import near_duplicates
from .token_counts import count_tokens


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("th", "is_first")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = f"{store_dir(spark)}/token-counts"  # kept: later runs encode only what no run before has counted
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), cache)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_documents(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return deduped.select("doc_id", "text", "n_lines", "n_deleted")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("th")


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("th")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_simhash": op2_simhash,
        "op3_token_counts": op3_token_counts,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_mtree_topk": op5_mtree_topk,
        "op6_quality_rules": op6_quality_rules,
        "op7_pii": op7_pii,
        "op8_line_dedup": op8_line_dedup,
        "op9_mixing": op9_mixing,
        "op10_importance_resampling": op10_importance_resampling,
        "op11_fingerprints": op11_fingerprints,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_token_alignment": op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_mtree_topk": mtree.ORACLE_SQL,
        "op6_quality_rules": quality_rules.ORACLE_SQL,
        "op7_pii": pii.ORACLE_SQL,
        "op8_line_dedup": line_dedup.ORACLE_SQL,
    }
