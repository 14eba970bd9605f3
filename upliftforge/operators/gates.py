"""Validation gates: aggregates in one pass, tidy records, and errors that stop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import stack
from ..roles import AUDIT_ONLY, FEATURES, LABELS, OUTCOME, ROW_ID, SECONDARY, TREATMENT, ContractError

INFINITY = float("inf")


def _missing(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(F.col(c))


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, missing`` for every column, in one scan."""
    wide = df.agg(*[F.count_if(_missing(c) if c in FEATURES else F.col(c).isNull()).alias(f"m_{c}") for c in columns])
    return stack(wide, [], columns, {"missing": "m_{}"})


def quality_counts(df: DataFrame) -> DataFrame:
    """Missing, NaN, infinite and, for labels, invalid values of every column, in one scan."""
    zero = F.lit(0).cast("long")
    wide = []
    for c in FEATURES:
        x = F.col(c)
        wide += [F.count_if(x.isNull()).alias(f"m_{c}"), F.count_if(F.isnan(x)).alias(f"n_{c}"), F.count_if(F.abs(x) == INFINITY).alias(f"i_{c}"), zero.alias(f"b_{c}")]
    for c in LABELS:
        wide += [F.count_if(F.col(c).isNull()).alias(f"m_{c}"), zero.alias(f"n_{c}"), zero.alias(f"i_{c}"), F.count_if(~F.col(c).isin(0, 1)).alias(f"b_{c}")]
    return stack(df.agg(*wide), [], [*FEATURES, *LABELS], {"missing": "m_{}", "nan": "n_{}", "infinite": "i_{}", "invalid_binary": "b_{}"})


def text_quality_counts(raw: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Blank and malformed values of columns read as text."""
    filled = lambda c: F.col(c).isNotNull() & (F.trim(c) != "")
    wide = [
        x
        for c in columns
        for x in (F.count_if(~filled(c)).alias(f"m_{c}"), F.count_if(filled(c) & F.col(c).try_cast("double").isNull()).alias(f"b_{c}"))
    ]
    return stack(raw.agg(*wide), [], columns, {"missing": "m_{}", "malformed": "b_{}"})


def binary_violations(df: DataFrame, column: str) -> Column:
    return F.count_if(F.col(column).isNull() | ~F.col(column).isin(0, 1))


def identity_summary(df: DataFrame, id_col: str = ROW_ID) -> DataFrame:
    """One row: rows, distinct ids, nulls, least and greatest id, and whether ids are unique and dense."""
    x = F.col(id_col)
    base = df.agg(
        F.count("*").alias("rows"), F.count_distinct(x).alias("distinct_ids"), F.count_if(x.isNull()).alias("null_ids"), F.min(x).alias("min_id"), F.max(x).alias("max_id")
    )
    unique = (F.col("null_ids") == 0) & (F.col("rows") == F.col("distinct_ids"))
    dense = unique & (F.col("min_id") == 0) & (F.col("max_id") == F.col("rows") - 1)
    return base.withColumn("unique_ids", unique).withColumn("dense_ids", F.coalesce(dense, F.lit(False)))


def pre_split_gates(df: DataFrame) -> DataFrame:
    """Hard gates and missingness records of the population, one tidy row for each."""
    x = [F.col(c) for c in FEATURES]
    summary = df.agg(
        F.count("*").alias("rows"),
        sum((binary_violations(df, c) for c in (TREATMENT, OUTCOME, SECONDARY)), F.lit(0)).alias("bad_labels"),
        (F.count("*") - F.count_distinct(ROW_ID)).alias("bad_ids"),
        sum((F.count_if(F.abs(c) == INFINITY) for c in x), F.lit(0)).alias("infinite"),
        F.least(F.count_if(F.col(TREATMENT) == 0), F.count_if(F.col(TREATMENT) == 1)).alias("least_arm"),
        *[F.count_if(_missing(c)).alias(f"m_{c}") for c in FEATURES],
    )
    gate = lambda k, observed, ok: F.struct(
        F.lit(k).alias("audit_id"), F.lit("HARD_GATE").alias("evidence_class"), observed.cast("long").alias("observed"), F.when(ok, "PASS").otherwise("FAIL").alias("evidence_status")
    )
    info = lambda c: F.struct(
        F.lit(f"ED-01-{c}").alias("audit_id"), F.lit("EMPIRICAL_DIAGNOSTIC").alias("evidence_class"), F.col(f"m_{c}").cast("long").alias("observed"), F.lit("INFO").alias("evidence_status")
    )
    declared = F.lit(set(FEATURES) <= set(df.columns) and not set(df.columns) - {*FEATURES, *LABELS, ROW_ID})
    records = [
        gate("HG-02", F.col("rows"), F.col("rows") > 0), gate("HG-03", F.lit(len(FEATURES)), declared), gate("HG-04", F.col("bad_labels"), F.col("bad_labels") == 0),
        gate("HG-05", F.col("infinite"), F.col("infinite") == 0), gate("HG-06", F.col("least_arm"), F.col("least_arm") > 0), gate("HG-07", F.col("bad_ids"), F.col("bad_ids") == 0),
    ]
    rows = summary.select(F.explode(F.array(*records, *[info(c) for c in FEATURES])).alias("g")).select("g.*")
    return rows.withColumn("required_action", F.when(F.col("evidence_status") == "FAIL", "STOP").otherwise("PASS"))


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Stop if any row violates the condition; returns ``df`` unchanged."""
    if not df.where(~F.coalesce(condition, F.lit(False))).isEmpty():
        raise ContractError(message)
    return df


def require_population(df: DataFrame) -> DataFrame:
    failed = [r["audit_id"] for r in pre_split_gates(df).where("evidence_status = 'FAIL'").collect()]
    if failed:
        raise ContractError(f"gates failed: {failed}")
    return df


def ranking_gates(df: DataFrame, score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """One row, or one for each ranking: what keeps a scored frame from being ranked."""
    s = F.col(score)
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"), F.count_if(s.isNull() | F.isnan(s) | (F.abs(s) == INFINITY)).alias("bad_scores"),
        (F.count("*") - F.count_distinct(ROW_ID)).alias("bad_ids"), binary_violations(df, TREATMENT).alias("bad_treatment"),
        binary_violations(df, OUTCOME).alias("bad_outcome"), F.count_if(F.col(TREATMENT) == 1).alias("treated"), F.count_if(F.col(TREATMENT) == 0).alias("control"),
    )


def require_rankable(df: DataFrame, score: str = "score", least_rows: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Stops on a score that is missing or not finite, repeated ids, other labels, an empty arm or too few
    rows, in any of the rankings."""
    wrong = ("bad_scores", "bad_ids", "bad_treatment", "bad_outcome")
    failed = F.greatest(*wrong) > 0
    failed = failed | (F.col("treated") == 0) | (F.col("control") == 0) | (F.col("rows") < least_rows)
    found = ranking_gates(df, score, by)
    found = found.where(failed) if by else found
    g = found.first()  # one of those that fail
    if g is not None:
        bad = [k for k in wrong if g[k]]
        if bad or not g["treated"] or not g["control"] or g["rows"] < least_rows:
            raise ContractError(f"not rankable: {bad or 'an arm is empty or there are too few rows'}")
    return df


def arms(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Treated and control rows; an empty arm or another label stops."""
    require(df, F.col(TREATMENT).isin(0, 1), "treatment must be 0 or 1")
    treated, control = df.where(F.col(TREATMENT) == 1), df.where(F.col(TREATMENT) == 0)
    if treated.isEmpty() or control.isEmpty():
        raise ContractError("an arm is empty")
    return treated, control


def invariant_scan(df: DataFrame) -> DataFrame:
    """Missing and non-finite features, arm, outcome and joint counts in one pass."""
    t, y = F.col(TREATMENT), F.col(OUTCOME)
    return df.agg(
        F.count("*").alias("rows"), F.sum(sum((F.when(_missing(c), 1).otherwise(0) for c in FEATURES), F.lit(0))).alias("missing_features"),
        F.sum(sum((F.when(F.abs(F.col(c)) == INFINITY, 1).otherwise(0) for c in FEATURES), F.lit(0))).alias("infinite_features"),
        F.sum(t).alias("treated"), F.sum(y).alias("converted"), F.sum(SECONDARY).alias("visited"), F.sum(AUDIT_ONLY).alias("exposed"),
        *[F.count_if((t == a) & (y == b)).alias(f"n_{a}{b}") for a in (0, 1) for b in (0, 1)],
    )
