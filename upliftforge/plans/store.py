"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL_STORE = "file:///tmp/upliftforge-store"


#: Folders handed out since the last :func:`clear`.
_FOLDERS: list[str] = []


def new_folder(spark: SparkSession, tag: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    path = f"{(base or LOCAL_STORE).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _FOLDERS.append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Remove the intermediate tables of all plans so far; results that are still to be computed from them
    are lost, so call it once they have been written or collected."""
    while _FOLDERS:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a table and read it back, so that later plans see one and the same evaluation."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
