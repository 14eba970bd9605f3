"""Column roles, constants and contract errors of the uplift data model."""

from __future__ import annotations

from pyspark.sql import types as T

FEATURES = tuple(f"f{k}" for k in range(12))
TREATMENT, OUTCOME, SECONDARY, AUDIT_ONLY, ROW_ID = "treatment", "conversion", "visit", "exposure", "_source_row_id"
LABELS = (TREATMENT, OUTCOME, SECONDARY, AUDIT_ONLY)
FORBIDDEN_FEATURES = (*LABELS, ROW_ID)

RAW_SCHEMA = T.StructType([T.StructField(f, T.DoubleType()) for f in FEATURES] + [T.StructField(c, T.LongType()) for c in LABELS])
PROCESSED_SCHEMA = T.StructType([*RAW_SCHEMA.fields, T.StructField(ROW_ID, T.LongType())])

#: Fixed values of the metric contract.
K_GRID = (0.1, 0.2, 0.3, 0.5, 1.0)
K_LABELS = ("10", "20", "30", "50", "100")
CURVE_POINTS = 151
MIN_ROWS = 10
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
RANDOM_DRAWS = 200
BOOTSTRAP_DRAWS = 500
SEED = 42
SEEDS = (42, 123, 2026)
SPLITS = ("train", "validation", "held_out")
PROHIBITED_LABELS = ("AUUC", "normalized Qini", "Qini coefficient", "uplift AUC", "PEHE")


class ContractError(ValueError):
    """The data or a request violates the declared contract; nothing is repaired silently."""


class HeldOutAccessError(ContractError):
    """Held-out rows were asked for without a release."""


def assert_feature_contract(columns) -> None:
    """Features must be exactly the declared ones, in order, and no label or id may be among them."""
    bad = [c for c in columns if c in FORBIDDEN_FEATURES]
    if bad:
        raise ContractError(f"not features: {bad}")
    if tuple(columns) != FEATURES:
        raise ContractError(f"features must be {FEATURES} in this order")
