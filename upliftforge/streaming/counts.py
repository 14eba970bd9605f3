"""Streaming counts: arm and outcome totals of files as they arrive, and windowed event counts.

An extension: the batch operators have mergeable counts, so a stream keeps them up to date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..roles import OUTCOME, PROCESSED_SCHEMA, TREATMENT


def population_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(PROCESSED_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def joint_counts(stream: DataFrame) -> DataFrame:
    """Complete-mode counts of treatment and outcome; the state is four rows."""
    return stream.groupBy(TREATMENT, OUTCOME).agg(F.count("*").alias("n"))


def windowed_events(stream: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event counts by type in tumbling windows; late rows are waited for and then dropped."""
    window = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def ate_of_counts(counts: DataFrame) -> DataFrame:
    """Difference of rates from the four counts, batch or streamed."""
    arm = lambda a, y: F.sum(F.when((F.col(TREATMENT) == a) & (F.col(OUTCOME).isin(*y)), F.col("n")))
    rate = lambda a: F.try_divide(arm(a, [1]).cast("double"), arm(a, [0, 1]).cast("double"))
    return counts.agg((rate(1) - rate(0)).alias("ate"))
