"""Joins by row id with the gates that position-based alignment would need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..roles import ROW_ID, TREATMENT, ContractError


def with_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    return df.join(labels, ROW_ID, "inner")


def one_to_one(left: DataFrame, right: DataFrame, key: str = ROW_ID) -> DataFrame:
    """Inner join of two frames that must hold the same keys, once each."""
    repeated = [side for side, f in (("left", left), ("right", right)) if not f.groupBy(key).count().where("count > 1").isEmpty()]
    if repeated:
        raise ContractError(f"keys repeat on the {' and '.join(repeated)}")
    if not left.join(right, key, "left_anti").isEmpty() or not right.join(left, key, "left_anti").isEmpty():
        raise ContractError("the sides hold different keys")
    return left.join(right, key)


def alignment(expected: DataFrame, *others: DataFrame, key: str = ROW_ID) -> DataFrame:
    """One row: ids of each prediction set that are missing or not expected."""
    base = expected.select(key, F.lit(0).alias("_set"))
    for k, o in enumerate(others, 1):
        base = base.unionByName(o.select(key, F.lit(k).alias("_set")))
    sets = base.groupBy(key).agg(*[F.count_if(F.col("_set") == k).alias(f"_n{k}") for k in range(len(others) + 1)])
    off = [F.count_if(F.col(f"_n{k}") != F.col("_n0")).alias(f"misaligned_{k}") for k in range(1, len(others) + 1)]
    return sets.agg(F.count_if(F.col("_n0") > 0).alias("expected"), *off)


def replace_treatment(df: DataFrame, permuted: DataFrame) -> DataFrame:
    """The frame with treatment taken from a permutation map."""
    moved = permuted.select(ROW_ID, F.col("t_perm").cast("long").alias(TREATMENT))
    return df.drop(TREATMENT).join(moved, ROW_ID)


def rows_in(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select(ROW_ID), ROW_ID, "left_semi")


def rows_of_profiles(df: DataFrame, profiles: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose profile is in the set; missing values match each other."""
    p = profiles.select(*[F.col(c).alias(f"_p_{c}") for c in columns])
    on = F.lit(True)
    for c in columns:
        on = on & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    return df.join(p, on, "left_semi")


def id_sets(a: DataFrame, b: DataFrame, key: str = ROW_ID) -> DataFrame:
    """One row: sizes of the intersection and of both differences, and the relations they imply."""
    both = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    out = both.agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("common"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b")
    )
    return out.select("*", (F.col("common") == 0).alias("disjoint"), (F.col("only_a") == 0).alias("a_within_b"), ((F.col("only_a") == 0) & (F.col("only_b") == 0)).alias("equal"))
