"""Scalar expressions with the semantics that the operators rely on."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..roles import FEATURES


def hash_uniform(*parts) -> Column:
    """Uniform in [0, 1) from the MD5 of the parts joined with ``|``: the same for a key however the
    rows are partitioned."""
    return F.conv(F.substring(hash_key(*parts), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def hash_key(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def missing_to_null(df: DataFrame, columns: Iterable[str] = FEATURES) -> DataFrame:
    """NaN becomes NULL, so that grouping and aggregates know one kind of missing value."""
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in columns if c in df.columns})


def ratio(num: Column, den: Column) -> Column:
    """Division as doubles; NULL where the denominator is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def half_even(x: Column) -> Column:
    return F.rint(x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def stack(df: DataFrame, keys: Iterable[str], names: Iterable[str], columns: dict[str, str]) -> DataFrame:
    """Wide columns to rows: ``columns`` maps each output column to a pattern such as ``avg_{}``."""
    names = list(names)
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), *[F.col(p.format(n)).alias(c) for c, p in columns.items()]) for n in names])
    return df.select(*keys, F.explode(rows).alias("_x")).select(*keys, "_x.*")
