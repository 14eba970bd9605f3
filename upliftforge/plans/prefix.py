"""Ranks and running sums over a global order, without gathering the rows in one task.

Rows are range-partitioned in the wanted order and tagged with their partition, totals of the
partitions (a row each) give every partition its offset, and running sums are taken within
partitions.  The tagged rows are written once, because both steps must see the same partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize


def prefix_sums(df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column], by: Sequence[str] = (), totals: bool = True) -> DataFrame:
    """``df`` with ``r``, the 1-based rank in ``order`` (which must end with a unique key), for each
    entry of ``sums`` the running sum under its name, and with ``totals`` the group's row count
    ``n`` and the whole sums as ``total_<name>``.  ``by`` ranks within groups of any size."""
    spark, by = df.sparkSession, list(by)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    values = {f"_v_{k}": c for k, c in sums.items()}
    ranged = df.withColumns(values).repartitionByRange(parts, *[F.col(b) for b in by], *order)
    tagged = materialize(ranged.withColumn("_part", F.spark_partition_id()), "ranked")

    part = tagged.groupBy(*by, "_part").agg(F.count("*").alias("_n"), *[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = part.select(
        *[F.col(b).alias(f"_b_{b}") for b in by], F.col("_part").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o_n"), F.sum("_n").over(whole).alias("n"),
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_o{v}") for v in values],
        *[F.sum(v).over(whole).alias(f"total_{k}") for k, v in zip(sums, values, strict=True)],
    )
    local = Window.partitionBy(*by, "_part").orderBy(*order)
    running = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = tagged.withColumn("_r", F.row_number().over(local)).withColumns({f"_s{v}": F.sum(v).over(running) for v in values})
    same = F.col("_part") == F.col("_at")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_b_{b}"))
    joined = joined.join(offsets, same)
    extra = [F.col("n"), *[F.col(f"total_{k}") for k in sums]] if totals else []
    return joined.select(
        *[F.col(c) for c in df.columns], (F.col("_r") + F.col("_o_n")).cast("long").alias("r"),
        *[(F.col(f"_s{v}") + F.col(f"_o{v}")).alias(k) for k, v in zip(sums, values, strict=True)], *extra,
    )


def exact_quantiles(values: DataFrame, probabilities: Sequence[float], by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """``by`` and ``q``, an array of quantiles with linear interpolation, for each group of any size.

    Values are counted first; with running counts in their order, the two neighbours of each quantile
    are the values whose counts cover the two ranks, so nothing is gathered but one row a group."""
    by = list(by)
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    run = prefix_sums(counts, [F.asc(value)], {"_upto": F.col("_c")}, by)
    rows = run.groupBy(*by, "total__upto").agg(*quantile_ends(probabilities, F.lit(True), value))
    return rows.select(*by, quantile_array(probabilities).alias("q"))


def _place(p: float) -> Column:
    return (F.col("total__upto") - 1) * F.lit(float(p))


def quantile_ends(probabilities: Sequence[float], present: Column, value: str = "value") -> list[Column]:
    """Aggregates that pick the two neighbours of each quantile from values with counts ``_c`` and running
    counts ``_upto``."""
    covers = lambda rank: F.max(F.when(present & (rank >= F.col("_upto") - F.col("_c")) & (rank < F.col("_upto")), F.col(value)))
    return [covers(edge(_place(p))).alias(f"_{name}{k}") for k, p in enumerate(probabilities) for name, edge in (("low", F.floor), ("high", F.ceil))]


def quantile_array(probabilities: Sequence[float]) -> Column:
    """The quantiles, by linear interpolation between the picked neighbours."""
    ends = []
    for k, p in enumerate(probabilities):
        at, low, high = _place(p), F.col(f"_low{k}"), F.col(f"_high{k}")
        ends.append(F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high))
    return F.array(*ends)
