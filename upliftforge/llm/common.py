"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL_STORE = "file:///tmp/upliftforge-store"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def store_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    return (named or LOCAL_STORE).rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{store_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and the
    table survives lost executors.  The folder stays until the cluster clears its checkpoint
    folder or :func:`discard` removes it."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._store_path = path
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that :func:`materialize` wrote and that no later plan reads."""
    path = getattr(df, "_store_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


#: A side of so many bytes at most may be broadcast; beyond it the join is shuffled.
BROADCAST_BYTES = 8 << 20


def row_bytes(df: DataFrame) -> Column:
    """About what a row takes in memory: eight bytes a field, and the contents of strings and arrays."""
    sizes = [F.lit(8 * len(df.columns) + 16)]
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            sizes.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif kind.startswith("array"):
            sizes.append(8 * F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)))
    return sum(sizes[1:], sizes[0])


def join_checked(large: DataFrame, small: DataFrame, on, how: str = "inner", most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join a table with a written one, which is broadcast only if it takes ``most_bytes`` at most."""
    taken = small.agg(F.sum(row_bytes(small))).first()[0] or 0
    return large.join(F.broadcast(small) if taken <= most_bytes else small, on, how)


BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Python stages get Arrow batches of some megabytes, however long the texts are (one text over
    the bound makes a batch of its own).  A tighter setting of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub("[^0-9-]", "", spark.conf.get(key)) or -1) not in range(1, most + 1):
        spark.conf.set(key, str(most))


def release() -> None:
    """Give memory that Arrow holds unused back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()


def merge_spans(groups: list[tuple[str, list[tuple[int, int]]]]) -> str:
    """``kind:start:end`` of all spans by start, ties in the order of ``groups``, comma-joined."""
    found = sorted((s, k, e, kind) for k, (kind, spans) in enumerate(groups) for s, e in spans)
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in found)
