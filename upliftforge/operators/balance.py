"""Covariate balance between arms: moments, standardized mean differences, KS distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio, stack
from ..plans.prefix import prefix_sums
from ..roles import FEATURES, QUANTILES, TREATMENT
from .profile import unpivot, value_profile

CONSTANT, ZERO_SD, TOO_FEW, DEFINED = "UNDEFINED_GLOBAL_CONSTANT", "UNDEFINED_ZERO_POOLED_SD", "UNDEFINED_INSUFFICIENT_NONMISSING_SUPPORT", "DEFINED"


def arm_moments(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Count, mean and sample variance of every feature in each arm, in one pass."""
    parts = {"non_missing": F.count, "mean": F.avg, "variance": F.var_samp}
    wide = df.groupBy(TREATMENT).agg(*[fn(f).alias(f"{k}_{f}") for f in features for k, fn in parts.items()])
    return stack(wide, [TREATMENT], features, {k: f"{k}_{{}}" for k in parts})


def smd_balance(df: DataFrame, features: Sequence[str] = FEATURES, with_shifts: bool = True) -> DataFrame:
    """Signed and absolute SMD with equal-arm weighting, variance ratio, status and, unless they are not
    wanted, the shifts of the arms' quantiles."""
    if with_shifts:
        each = value_profile(df, [TREATMENT], features, QUANTILES).withColumnRenamed("n", "rows").withColumnRenamed("non_missing", "n")
    else:
        parts = {"n": F.count, "mean": F.avg, "variance": F.var_samp, "min": F.min, "max": F.max}
        wide = df.groupBy(TREATMENT).agg(F.count("*").alias("rows"), *[fn(f).alias(f"{k}_{f}") for f in features for k, fn in parts.items()])
        each = stack(wide, [TREATMENT, "rows"], features, {k: f"{k}_{{}}" for k in parts})
    measures = ["rows", "n", "mean", "variance", "min", "max", *["q"] * with_shifts]
    rows = each.groupBy("feature").agg(*[F.max(F.when(F.col(TREATMENT) == a, F.col(k))).alias(f"{k}{a}") for k in measures for a in (0, 1)])  # two rows a feature
    rows = rows.withColumns({f"{k}{a}": F.coalesce(f"{k}{a}", F.lit(0)) for k in ("rows", "n") for a in (0, 1)})
    sd = F.sqrt((F.col("variance1") + F.col("variance0")) / 2)
    constant = (F.col("min0") == F.col("max0")) & (F.col("min1") == F.col("max1")) & (F.col("min0") == F.col("min1"))
    status = F.when((F.col("n0") < 2) | (F.col("n1") < 2), TOO_FEW).when((sd == 0) & constant, CONSTANT).when(sd == 0, ZERO_SD).otherwise(DEFINED)
    rows = rows.withColumn("pooled_sd", sd).withColumn("status", status)
    signed = F.when(F.col("status") == DEFINED, ratio(F.col("mean1") - F.col("mean0"), F.col("pooled_sd")))
    spread = F.when(F.col("status") == DEFINED, ratio(F.col("variance1"), F.col("variance0")))
    label = lambda q: f"q{round(q * 100):02d}"
    shifts = [(F.element_at("q1", k + 1) - F.element_at("q0", k + 1)).alias(f"shift_{label(q)}") for k, q in enumerate(QUANTILES) if with_shifts]
    return rows.select(
        "feature", F.col("n0").alias("control_n"), F.col("n1").alias("treated_n"), (F.col("rows0") - F.col("n0")).alias("control_missing"), (F.col("rows1") - F.col("n1")).alias("treated_missing"),
        F.col("mean0").alias("control_mean"), F.col("mean1").alias("treated_mean"), "pooled_sd", "status", signed.alias("smd_signed"), F.abs(signed).alias("smd_absolute"),
        spread.alias("variance_ratio"), *shifts,
    )


def balance_summary(balance: DataFrame) -> DataFrame:
    """Largest absolute SMD among defined features; constants are left out, other undefined ones count."""
    defined = F.col("status") == DEFINED
    return balance.agg(
        F.max(F.when(defined, F.col("smd_absolute"))).alias("max_absolute_smd"), F.max_by("feature", F.when(defined, F.col("smd_absolute"))).alias("max_feature"),
        F.count_if(defined).alias("eligible"), F.count_if(F.col("status") == CONSTANT).alias("constants"), F.count_if(~F.col("status").isin(DEFINED, CONSTANT)).alias("invalid"),
    )


def ks_distances(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Largest gap of the arms' empirical distributions: values are counted first, then summed up in
    order across partitions."""
    values = unpivot(df, [TREATMENT], features).where("value is not null")
    counts = values.groupBy("feature", "value").agg(F.count_if(F.col(TREATMENT) == 1).alias("t"), F.count_if(F.col(TREATMENT) == 0).alias("c"))
    run = prefix_sums(counts, [F.asc("value")], {"ct": F.col("t"), "cc": F.col("c")}, ["feature"])
    gap = F.abs(ratio(F.col("ct"), F.col("total_ct")) - ratio(F.col("cc"), F.col("total_cc")))
    return run.groupBy("feature").agg(F.max(gap).alias("ks_distance"))
