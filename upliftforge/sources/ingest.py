"""Governed ingest: typed and untyped scans, row ordinals, conversion to Parquet, and digests."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import missing_to_null
from ..operators import gates
from ..plans.prefix import prefix_sums
from ..plans.store import materialize
from ..roles import FEATURES, LABELS, PROCESSED_SCHEMA, RAW_SCHEMA, ROW_ID, ContractError
from .digests import semantic_digest
from .files import row_groups
from .runs import Store, table_digest

ROW_GROUP = 1_048_576


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """Fixed types; a malformed value stops the read.  NaN becomes NULL."""
    return missing_to_null(spark.read.schema(schema).options(header=True, mode="FAILFAST", enforceSchema=False).csv(path))


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """For exploration only: types are guessed."""
    return spark.read.options(header=True, inferSchema=True).csv(path)


def read_csv_text(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    return spark.read.schema(text).options(header=True).csv(path)


def safe_cast(raw: DataFrame, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """Text to the declared types; what does not parse, and NaN, is NULL."""
    return missing_to_null(raw.select(*[F.trim(f.name).try_cast(f.dataType).alias(f.name) for f in schema]))


def with_row_ordinal(df: DataFrame) -> DataFrame:
    """Zero-based dense ordinal by file name and place in the file (by partition and place, if no files
    are read).  The rows are numbered by the engine and written once, so that all steps see the same
    numbers; running counts of the blocks that were read turn these into dense ones."""
    number = F.monotonically_increasing_id()
    try:
        source = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
        numbered = df.select(*df.columns, *source, number.alias("_k"))
        numbered.schema  # noqa: B018  fails if there is no such column
    except AnalysisException:
        numbered = df.select(*df.columns, F.lit("").alias("_file"), F.shiftright(number, 33).alias("_block"), number.alias("_k"))
    numbered = materialize(numbered, "numbered")
    blocks = numbered.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_k").alias("_first"))
    run = prefix_sums(blocks, [F.asc("_file"), F.asc("_block")], {"_upto": F.col("_n")}, totals=False)
    shifts = run.select("_file", "_block", (F.col("_upto") - F.col("_n") - F.col("_first")).alias("_shift"))
    return numbered.join(shifts, ["_file", "_block"]).select(*df.columns, (F.col("_k") + F.col("_shift")).alias(ROW_ID))


def prefix(df: DataFrame, rows: int) -> DataFrame:
    """The first ``rows`` rows by id; stops if there are fewer."""
    if rows <= 0:
        raise ContractError("the limit must be positive")
    head = df.where(F.col(ROW_ID) < rows)
    if head.count() < rows:
        raise ContractError(f"the source ends before {rows} rows")
    return head


def scan(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Parquet scan of declared columns only."""
    unknown = [c for c in columns if c not in PROCESSED_SCHEMA.names]
    if unknown or not columns:
        raise ContractError(f"undeclared columns: {unknown}")
    return missing_to_null(spark.read.schema(PROCESSED_SCHEMA).parquet(path).select(*columns))


def to_pandas(df: DataFrame, columns: Sequence[str], most_rows: int):
    """Bounded materialization on the driver; a larger result stops."""
    out = df.select(*columns).limit(most_rows + 1).toPandas()
    if len(out) > most_rows:
        raise ContractError(f"more than {most_rows} rows")
    return out


def describe_columns(df: DataFrame) -> DataFrame:
    """``column_name, column_type`` in order."""
    return df.sparkSession.createDataFrame([(n, t, k) for k, (n, t) in enumerate(df.dtypes)], "column_name string, column_type string, position int")


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "zstd").option("parquet.block.row.count.limit", ROW_GROUP).parquet(path)


def require_raw(df: DataFrame) -> DataFrame:
    """Finite features and binary labels, in one aggregate."""
    infinite = sum((F.count_if(F.abs(F.col(c)) == float("inf")) for c in FEATURES), F.lit(0))
    labels = sum((gates.binary_violations(df, c) for c in LABELS), F.lit(0))
    found = df.agg(F.count("*").alias("rows"), infinite.alias("infinite"), labels.alias("labels")).first()
    if not found["rows"] or found["infinite"] or found["labels"]:
        raise ContractError(f"raw rows violate the contract: {found.asDict()}")
    return df


def convert_csv(spark: SparkSession, source: str, destination: str, row_limit: int | None = None) -> dict:
    """CSV to Parquet with ids and gates; nothing is left behind on an error."""
    store = Store(spark)
    if store.exists(destination):
        raise ContractError(f"{destination} exists")
    rows = with_row_ordinal(require_raw(read_csv_typed(spark, source)))
    if row_limit is not None:
        rows = prefix(rows, row_limit)
    try:
        write_parquet(rows, destination)
        return validate_processed(spark, destination, row_limit)
    except Exception:
        store.delete(destination)
        raise


def cached_parquet(spark: SparkSession, source: str, destination: str) -> dict:
    """The converted table; one that is there is used again if it has as many rows as the source, else
    it is replaced."""
    store = Store(spark)
    if store.exists(destination):
        rows = spark.read.parquet(destination).count()
        if rows == read_csv_typed(spark, source).count():
            return {"rows": rows, "reused": True}
        store.delete(destination)
    return {"rows": convert_csv(spark, source, destination)["rows"], "reused": False}


def require_layout(spark: SparkSession, path: str, codec: str = "ZSTD", most_rows: int = ROW_GROUP) -> None:
    """Every row group has that codec and no more rows; footers are read by tasks."""
    wrong = row_groups(spark, path).where((F.col("rows") > most_rows) | ~F.col("codec").eqNullSafe(codec)).limit(3).collect()
    if wrong:
        raise ContractError(f"row groups of another size or codec: {[tuple(r) for r in wrong]}")


def validate_processed(spark: SparkSession, path: str, expected_rows: int | None = None, expected_digest: Sequence | None = None) -> dict:
    """Schema, row groups, codec, dense ids and, if given, row count and digest of a processed table."""
    df = spark.read.parquet(path)
    if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in PROCESSED_SCHEMA]:
        raise ContractError("the schema differs from the declared one")
    require_layout(spark, path)
    found = gates.identity_summary(df).first()
    if not found["dense_ids"] or (expected_rows is not None and found["rows"] != expected_rows):
        raise ContractError(f"row ids are not dense or rows are missing: {found.asDict()}")
    digest = sorted(tuple(r) for r in semantic_digest(df).collect())  # a row for each column
    if expected_digest is not None and digest != sorted(tuple(x) for x in expected_digest):
        raise ContractError("the values differ from the expected ones")
    return {"rows": found["rows"], "digest": digest}


@dataclass(frozen=True)
class Selector:
    """Where the source and the processed table are and what they must be."""

    source: str
    processed: str
    sha256: str | None = None
    rows: int | None = None
    features: tuple[str, ...] = field(default=FEATURES)

    @classmethod
    def load(cls, text: str) -> Selector:
        raw = json.loads(text)
        unknown = set(raw) - {"source", "processed", "sha256", "rows", "features"}
        if unknown or not {"source", "processed"} <= set(raw):
            raise ContractError(f"selector fields are wrong: {sorted(unknown) or 'source and processed are needed'}")
        digest = raw.get("sha256")
        if digest is not None and (len(digest) != 64 or set(digest) - set("0123456789abcdef")):
            raise ContractError("sha256 must be 64 lower-case hex digits")
        if tuple(raw.get("features", FEATURES)) != FEATURES:
            raise ContractError("features differ from the declared ones")
        return cls(raw["source"], raw["processed"], digest, raw.get("rows"))


def open_processed(spark: SparkSession, selector: Selector) -> DataFrame:
    """The processed table, only if its files are exactly those of the pinned digest
    (:func:`runs.table_digest`) and it has the declared schema."""
    if selector.sha256 is None:
        raise ContractError("the selector pins no digest")
    if table_digest(spark, selector.processed) != selector.sha256:
        raise ContractError("the processed files do not have the pinned digest")
    df = spark.read.parquet(selector.processed)
    if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in PROCESSED_SCHEMA]:
        raise ContractError("the schema differs from the declared one")
    if selector.rows is not None and df.count() != selector.rows:
        raise ContractError("the processed table has another number of rows")
    return df
