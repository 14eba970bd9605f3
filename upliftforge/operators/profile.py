"""Profiles of the population: counts, shares, descriptions, and repeated profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio, stack
from ..plans.prefix import exact_quantiles, prefix_sums, quantile_array, quantile_ends
from ..roles import AUDIT_ONLY, FEATURES, OUTCOME, QUANTILES, ROW_ID, SECONDARY, TREATMENT


def unpivot(df: DataFrame, keys: Sequence[str] = (), features: Sequence[str] = FEATURES) -> DataFrame:
    """One row for each feature value: ``keys, feature, value``."""
    return stack(df, keys, features, {"value": "{}"})


def arm_allocation(df: DataFrame) -> DataFrame:
    t = F.col(TREATMENT)
    return df.agg(F.count("*").alias("rows"), F.count_if(t == 1).alias("treated"), F.count_if(t == 0).alias("control"), F.avg(t).alias("treated_rate"))


def joint_counts(df: DataFrame, columns: Sequence[str] = (TREATMENT, OUTCOME)) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def complete_grid(counts: DataFrame, columns: Sequence[str] = (TREATMENT, OUTCOME)) -> DataFrame:
    """All 0/1 combinations, with count 0 where none was seen (a grid of fixed size)."""
    spark = counts.sparkSession
    grid = spark.range(1 << len(columns)).select(*[F.shiftright("id", len(columns) - 1 - k).bitwiseAND(F.lit(1)).alias(c) for k, c in enumerate(columns)])
    return F.broadcast(grid).join(counts, list(columns), "left").withColumn("n", F.coalesce("n", F.lit(0)))


def within_arm_share(df: DataFrame) -> DataFrame:
    """Joint counts with their share of the arm and of all rows."""
    joint = joint_counts(df)
    arm, everything = Window.partitionBy(TREATMENT), Window.partitionBy()
    return joint.select(
        TREATMENT, OUTCOME, "n", F.sum("n").over(arm).alias("arm_n"), ratio(F.col("n"), F.sum("n").over(arm)).alias("arm_share"),
        ratio(F.col("n"), F.sum("n").over(everything)).alias("joint_share"),
    )


def secondary_by_arm(df: DataFrame) -> DataFrame:
    wanted = [(c, f(c)) for c in (OUTCOME, SECONDARY, AUDIT_ONLY) for f in (F.sum, F.avg)]
    names = [f"{c}_{s}" for c in (OUTCOME, SECONDARY, AUDIT_ONLY) for s in ("sum", "rate")]
    return df.groupBy(TREATMENT).agg(F.count("*").alias("n"), *[e.alias(n) for (_, e), n in zip(wanted, names, strict=True)])


def crosstab(df: DataFrame, row: str = TREATMENT, column: str = AUDIT_ONLY) -> DataFrame:
    c = F.col(column)
    return df.groupBy(row).agg(F.count_if(c == 0).alias(f"{column}_0"), F.count_if(c == 1).alias(f"{column}_1"))


def quantiles(df: DataFrame, features: Sequence[str] = FEATURES, probabilities: Sequence[float] = QUANTILES) -> DataFrame:
    """Exact quantiles with linear interpolation: ``feature, probability, value``."""
    at = F.array(*[F.lit(p) for p in probabilities])
    rows = exact_quantiles(unpivot(df, features=features), probabilities, ["feature"])
    return rows.select("feature", F.posexplode("q").alias("k", "value")).select("feature", F.element_at(at, F.col("k") + 1).alias("probability"), "value")


def approximate_quantiles(df: DataFrame, features: Sequence[str] = FEATURES, probabilities: Sequence[float] = QUANTILES, accuracy: int = 10_000) -> DataFrame:
    at = F.array(*[F.lit(p) for p in probabilities])
    rows = stack(df.agg(*[F.percentile_approx(f, at, accuracy).alias(f"q_{f}") for f in features]), [], features, {"q": "q_{}"})
    return rows.select("feature", F.posexplode("q").alias("k", "value")).select("feature", F.element_at(at, F.col("k") + 1).alias("probability"), "value")


def approximate_distinct(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    return stack(df.agg(*[F.approx_count_distinct(f, 0.02).alias(f"d_{f}") for f in features]), [], features, {"distinct": "d_{}"})


def distinct_counts(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Distinct values and their share of the rows; values are grouped before they are counted."""
    values = unpivot(df, features=features).groupBy("feature", "value").agg(F.count("*").alias("n"))
    return values.groupBy("feature").agg(F.count("value").alias("distinct"), ratio(F.count("value"), F.sum("n")).alias("distinct_share"))


def value_profile(df: DataFrame, keys: Sequence[str], features: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """``keys, feature, n, non_missing, mean, variance, min, max, q`` of every feature from one pass over the
    rows: values are counted, and the rest is read off the counts, written once in their order."""
    group, present = [*keys, "feature"], F.col("value").isNotNull()
    counts = unpivot(df, keys, features).groupBy(*group, "value").agg(F.count("*").alias("_c"))
    run = prefix_sums(counts, [F.asc("value")], {"_upto": F.when(present, F.col("_c")).otherwise(0), "_gone": F.when(present, 0).otherwise(F.col("_c"))}, group)
    known, gone = F.col("total__upto"), F.col("total__gone")
    rows = run.groupBy(*group, "total__upto", "total__gone").agg(
        *quantile_ends(probabilities, present), (F.sum(F.col("_c") * F.col("value")) / known).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    rows = rows.select(*group, (known + gone).alias("n"), known.alias("non_missing"), "mean", "min", "max", quantile_array(probabilities).alias("q"))
    means = F.broadcast(rows.select(*group, "mean"))  # a row for each feature and key
    spread = run.where(present).join(means, group).groupBy(*group).agg(F.sum(F.col("_c") * (F.col("value") - F.col("mean")) * (F.col("value") - F.col("mean"))).alias("_s"))
    return rows.join(F.broadcast(spread), group, "left").withColumn("variance", F.try_divide(F.col("_s"), F.col("non_missing") - 1)).drop("_s")


def describe(df: DataFrame, features: Sequence[str] = FEATURES, by: str | None = None) -> DataFrame:
    """Rows, missing, mean, sample deviation, range and quartiles of each feature, by arm if asked."""
    keys = [by] if by else []
    rows = value_profile(df, keys, features, (0.25, 0.5, 0.75)).withColumn("sd", F.sqrt("variance"))
    q = lambda k: F.element_at("q", k)
    return rows.select(*keys, "feature", "n", "non_missing", (F.col("n") - F.col("non_missing")).alias("missing"), "mean", "sd", "min", "max", q(1).alias("q25"), q(2).alias("q50"), q(3).alias("q75"))


def range_overlap(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """The range that both arms share, for each feature."""
    side = lambda f, a, fn: fn(F.when(F.col(TREATMENT) == a, F.col(f)))
    wide = [e for f in features for e in (F.greatest(side(f, 0, F.min), side(f, 1, F.min)).alias(f"lo_{f}"), F.least(side(f, 0, F.max), side(f, 1, F.max)).alias(f"hi_{f}"))]
    rows = stack(df.agg(*wide), [], features, {"overlap_low": "lo_{}", "overlap_high": "hi_{}"})
    return rows.withColumn("overlaps", F.coalesce(F.col("overlap_low") <= F.col("overlap_high"), F.lit(False)))


def top_values(df: DataFrame, features: Sequence[str] = FEATURES, k: int = 5) -> DataFrame:
    """The ``k`` most frequent values of each feature, missing among them, ties to the smaller."""
    counts = unpivot(df, features=features).groupBy("feature", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("feature").orderBy(F.desc("n"), F.asc_nulls_last("value"))
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    total = df.agg(F.count("*").alias("total"))
    return ranked.crossJoin(F.broadcast(total)).select("feature", "rank", "value", "n", ratio(F.col("n"), F.col("total")).alias("share"))


# Repeated profiles


def duplicate_summary(df: DataFrame, definition: str, columns: Sequence[str | Column]) -> DataFrame:
    """Rows in repeated profiles, rows beyond the first, repeated groups, and the largest group."""
    sizes = df.groupBy(*columns).agg(F.count("*").alias("n"))
    many = F.col("n") > 1
    return sizes.agg(
        F.lit(definition).alias("definition"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("rows_in_groups"),
        F.coalesce(F.sum(F.when(many, F.col("n") - 1)), F.lit(0)).alias("rows_beyond_first"), F.count_if(many).alias("groups"),
        F.greatest(F.coalesce(F.max("n"), F.lit(1)), F.lit(1).cast("long")).alias("largest"),
    )


def duplicate_audit(df: DataFrame, definitions: Mapping[str, Sequence[str]]) -> DataFrame:
    parts = [duplicate_summary(df, k, v) for k, v in definitions.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def duplicate_rates(audit: DataFrame) -> DataFrame:
    return audit.select("definition", ratio(F.col("rows_in_groups"), F.col("rows")).alias("rate_in_groups"), ratio(F.col("rows_beyond_first"), F.col("rows")).alias("rate_beyond_first"))


def duplicate_disposition(audit: DataFrame, stopping: str = "DP-01") -> DataFrame:
    """A repeated row id stops; other repeated profiles warn."""
    repeated, stops = F.col("groups") > 0, F.col("definition") == stopping
    status = F.when(~repeated, "INFO").when(stops, "FAIL").otherwise("WARNING")
    action = F.when(~repeated, "PASS").when(stops, "STOP").otherwise("WARNING")
    return audit.select("definition", "groups", status.alias("evidence_status"), action.alias("required_action"))


def hashed_profiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """As :func:`duplicate_summary`, by a 64-bit hash of the profile: cheaper keys, may collide."""
    keyed = df.select(F.xxhash64(*columns).alias("h"))
    return duplicate_summary(keyed, "hashed", ["h"]).drop("definition")


def duplicate_characteristics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Repeated and single profiles side by side: groups, rows, treated, converted and their rates."""
    groups = df.groupBy(*columns).agg(F.count("*").alias("n"), F.sum(TREATMENT).alias("t"), F.sum(OUTCOME).alias("y"))
    total = F.sum("n")
    return groups.groupBy((F.col("n") > 1).alias("repeated")).agg(
        F.count("*").alias("groups"), total.alias("rows"), F.sum(F.col("n") - 1).alias("rows_beyond_first"), F.sum("t").alias("treated"), F.sum("y").alias("converted"),
        ratio(F.sum("t"), total).alias("treated_rate"), ratio(F.sum("y"), total).alias("converted_rate"),
    )


def float32_collisions(df: DataFrame, columns: Sequence[str] = ("f0",)) -> DataFrame:
    """Repeated values at double and at single precision, and how many rows only the latter repeats."""
    wide = duplicate_summary(df, "float64", list(columns))
    narrow = duplicate_summary(df, "float32", [F.col(c).cast("float").alias(c) for c in columns])
    both = wide.unionByName(narrow)
    side = lambda d: F.max(F.when(F.col("definition") == d, F.col("rows_beyond_first")))
    return both.agg(side("float64").alias("beyond_float64"), side("float32").alias("beyond_float32")).withColumn("extra", F.col("beyond_float32") - F.col("beyond_float64"))


def reconcile_precision(source: DataFrame, processed: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Rows of two tables with the same ids whose values differ or that one of them lacks."""
    a, b = source.select(ROW_ID, *columns).alias("a"), processed.select(ROW_ID, *columns).alias("b")
    joined = a.join(b, F.col(f"a.{ROW_ID}") == F.col(f"b.{ROW_ID}"), "full_outer")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns]
    lacks = F.col(f"a.{ROW_ID}").isNull() | F.col(f"b.{ROW_ID}").isNull()
    equal = F.lit(True)
    for s in same:
        equal = equal & s
    return joined.agg(F.count("*").alias("rows"), F.count_if(lacks).alias("unmatched"), F.count_if(~lacks & ~equal).alias("different"))


def cross_split_overlap(df: DataFrame, membership: DataFrame, columns: Sequence[str], splits: Sequence[str] = ("train", "validation")) -> DataFrame:
    """Profiles that stand in more than one of the requested splits; other splits are never read."""
    wanted = membership.where(F.col("split").isin(*splits))
    rows = df.join(wanted, ROW_ID)
    profiles = rows.groupBy(*columns).agg(F.count("*").alias("n"), F.count_distinct("split").alias("splits"))
    shared = F.col("splits") > 1
    return profiles.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_compared"), F.count_if(shared).alias("overlapping_profiles"), F.coalesce(F.sum(F.when(shared, F.col("n"))), F.lit(0)).alias("overlapping_rows")
    )


def support_findings(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Tidy findings: support of arms, of joint cells, and shared ranges of features."""
    arm = df.groupBy(TREATMENT).agg(F.count("*").alias("n")).select(F.lit("arm").alias("kind"), F.concat_ws("=", F.lit(TREATMENT), F.col(TREATMENT).cast("string")).alias("item"), "n")
    cell = complete_grid(joint_counts(df)).select(F.lit("cell").alias("kind"), F.concat(F.col(TREATMENT).cast("string"), F.lit("_"), F.col(OUTCOME).cast("string")).alias("item"), "n")
    overlap = range_overlap(df, features).select(F.lit("range").alias("kind"), F.col("feature").alias("item"), F.when(F.col("overlaps"), 1).otherwise(0).cast("long").alias("n"))
    found = arm.unionByName(cell).unionByName(overlap)
    return found.withColumn("status", F.when(F.col("n") > 0, "INFO").otherwise("FAIL")).withColumn("action", F.when(F.col("n") > 0, "PASS").otherwise("STOP"))


def first_per_group(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The value of a column that is constant within each group."""
    return df.groupBy(*keys).agg(F.any_value(column).alias(column))


def all_cells_supported(df: DataFrame) -> DataFrame:
    return complete_grid(joint_counts(df)).agg(F.bool_and(F.col("n") > 0).alias("supported"), F.min("n").alias("least"))


def treatment_rate(df: DataFrame) -> DataFrame:
    return df.agg(F.avg(TREATMENT).alias("g"))
