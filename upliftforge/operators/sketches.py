"""Stored sketches of feature values: quantiles (KLL) and distinct values (HyperLogLog) by partition.

A table's sketches are a few kilobytes for each feature and partition.  They merge in any order, so the
profile of new partitions, or of any selection of them, needs no row of the others again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio, stack
from ..roles import FEATURES, QUANTILES
from .profile import unpivot

#: Sizes of the sketches, and errors that they keep with a margin: of ranks as a share of the values, and
#: of distinct counts relative to them (six standard errors).
KLL_K, HLL_K = 1600, 12
RANK_ERROR, DISTINCT_ERROR = 0.005, 0.1


def sketch_features(df: DataFrame, by: Sequence[str] = (), features: Sequence[str] = FEATURES) -> DataFrame:
    """``by, feature, n, missing, quantile_sketch, distinct_sketch``: one pass, rows are folded into sketches where
    they are read.  ``-0.0`` counts as ``0.0``; missing values are counted only."""
    wide = []
    for f in features:
        value = F.col(f).cast("double") + F.lit(0.0)
        wide += [
            F.count("*").alias(f"n_{f}"), F.count_if(F.col(f).isNull()).alias(f"m_{f}"),
            F.kll_sketch_agg_double(value, KLL_K).alias(f"q_{f}"), F.hll_sketch_agg(F.when(F.col(f).isNotNull(), F.xxhash64(value)), HLL_K).alias(f"d_{f}"),
        ]
    return stack(df.groupBy(*by).agg(*wide), list(by), features, {"n": "n_{}", "missing": "m_{}", "quantile_sketch": "q_{}", "distinct_sketch": "d_{}"})


def merge_sketches(stored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of coarser groups, or of all rows, from stored ones."""
    return stored.groupBy(*by, "feature").agg(
        F.sum("n").alias("n"), F.sum("missing").alias("missing"),
        F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
    )


def sketched_quantiles(sketches: DataFrame, probabilities: Sequence[float] = QUANTILES, by: Sequence[str] = ()) -> DataFrame:
    """``by, feature, probability, value``; NULL for a feature without values."""
    at = F.array(*[F.lit(float(p)) for p in probabilities])
    values = F.when(F.col("n") > F.col("missing"), F.kll_sketch_get_quantile_double("quantile_sketch", at))
    rows = sketches.select(*by, "feature", F.posexplode(at).alias("_k", "probability"), values.alias("_v"))
    return rows.select(*by, "feature", "probability", F.get("_v", F.col("_k")).alias("value"))


def sketched_distinct(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, feature, n, missing, distinct``: the distinct count is an estimate."""
    return sketches.select(*by, "feature", "n", "missing", F.hll_sketch_estimate("distinct_sketch").alias("distinct"))


def quantiles_in_bounds(df: DataFrame, estimates: DataFrame, error: float = RANK_ERROR) -> DataFrame:
    """``feature, probability, in_bounds``: whether the estimate's exact ranks in the table reach the probability
    but for ``error``.  Rows are compared with a few estimates where they are read; only counts are shuffled."""
    values = unpivot(df, features=FEATURES).where(F.col("value").isNotNull())
    counts = values.join(F.broadcast(estimates.withColumnRenamed("value", "v")), "feature").groupBy("feature", "probability")
    counts = counts.agg(F.count("*").alias("n"), F.count_if(F.col("value") < F.col("v")).alias("below"), F.count_if(F.col("value") <= F.col("v")).alias("upto"))
    p = F.col("probability")
    return counts.select("feature", "probability", ((ratio(F.col("below"), F.col("n")) <= p + error) & (ratio(F.col("upto"), F.col("n")) >= p - error)).alias("in_bounds"))
