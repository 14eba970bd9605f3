"""Run artifacts: write-once files and tables below a run folder, and a closing manifest.

All paths go through Hadoop's file systems, so a run may stand in any store that Spark reads.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..roles import PROHIBITED_LABELS, ContractError
from .files import file_digests

MANIFEST = "manifest.json"
KINDS = ("audit", "tables", "models", "predictions", "figures")
P_VALUE = re.compile(r"(?<!not a )\bp-?values?\b", re.IGNORECASE)


class Store:
    """A few operations of Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self._sc = spark.sparkContext

    def _at(self, path: str):
        p = self._sc._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._sc._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def rename(self, source: str, target: str) -> bool:
        fs, p = self._at(source)
        return fs.rename(p, self._at(target)[1])

    def write_new(self, path: str, payload: bytes) -> None:
        """Exclusive creation."""
        fs, p = self._at(path)
        if fs.exists(p):
            raise ContractError(f"{path} exists")
        out = fs.create(p, False)
        try:
            out.write(bytearray(payload))
        finally:
            out.close()

    def read(self, path: str) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self._sc._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()


def check_language(text: str) -> None:
    """Calibration results are no p-values, and some names of the area statistic are not used."""
    if P_VALUE.search(text):
        raise ContractError("calibration summaries must not be called p-values")
    used = [w for w in PROHIBITED_LABELS if w.lower() in text.lower()]
    if used:
        raise ContractError(f"labels that are not used: {used}")


def table_digest(spark: SparkSession, path: str, buckets: int = 1024) -> str:
    """One SHA-256 of the names and digests of all Parquet files of a table: a file that is changed, added or
    taken away changes it.  Names are hashed into buckets, so that no row lists more than a share of them."""
    files = file_digests(spark, path).where("path like '%.parquet'").select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")
    line = F.concat_ws(":", "name", "sha256")
    joined = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    each = files.groupBy(F.pmod(F.xxhash64("name"), F.lit(buckets)).alias("bucket")).agg(F.sha2(joined, 256).alias("digest"))
    rows = each.orderBy("bucket").collect()  # a row for each bucket at most
    return hashlib.sha256("\n".join(f"{r['bucket']}:{r['digest']}" for r in rows).encode()).hexdigest()


class Run:
    """Write-once artifacts of one run; closed by its manifest."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.store = spark, root.rstrip("/"), Store(spark)
        self.written: dict[str, str] = {}

    @property
    def closed(self) -> bool:
        return self.store.exists(f"{self.root}/{MANIFEST}")

    def _path(self, name: str) -> str:
        if self.closed:
            raise ContractError("the run is closed")
        if name.split("/")[0] not in KINDS or ".." in name.split("/") or name.startswith("/"):
            raise ContractError(f"{name} is not below {KINDS}")
        return f"{self.root}/{name}"

    def write_bytes(self, name: str, payload: bytes) -> None:
        self.store.write_new(self._path(name), payload)
        self.written[name] = hashlib.sha256(payload).hexdigest()

    def write_text(self, name: str, text: str) -> None:
        if name.startswith("audit/"):
            check_language(text)
        self.write_bytes(name, text.encode())

    def write_json(self, name: str, value) -> None:
        self.write_text(name, json.dumps(value, sort_keys=True, indent=1))

    def write_table(self, name: str, df: DataFrame) -> None:
        path = self._path(name)
        if self.store.exists(path):
            raise ContractError(f"{path} exists")
        df.write.mode("errorifexists").parquet(path)
        self.written[name] = table_digest(self.spark, path)

    def finish(self, status: str = "COMPLETE", facts: Mapping | None = None) -> dict:
        """Write the manifest last; after it nothing can be added."""
        if self.closed:
            raise ContractError("the run is closed")
        manifest = {"status": status, "artifacts": dict(sorted(self.written.items())), "facts": dict(facts or {}), "spark": self.spark.version}
        self.store.write_new(f"{self.root}/{MANIFEST}.part", json.dumps(manifest, sort_keys=True, indent=1).encode())
        self.store.rename(f"{self.root}/{MANIFEST}.part", f"{self.root}/{MANIFEST}")
        return manifest


def promote(spark: SparkSession, candidate: str, target: str, verify) -> None:
    """Put ``candidate`` in the place of ``target`` by renames; ``verify(path)`` must pass afterwards,
    else the old table is put back.  A backup left by an earlier, unclear end stops."""
    store, backup = Store(spark), f"{target.rstrip('/')}.backup"
    if store.exists(backup):
        raise ContractError(f"{backup} exists: an earlier promotion did not end")
    had = store.exists(target)
    if had and not store.rename(target, backup):
        raise ContractError("the old table cannot be moved")
    try:
        if not store.rename(candidate, target):
            raise ContractError("the candidate cannot be moved")
        verify(target)
    except Exception:
        if store.exists(target):
            store.delete(target)
        if had:
            store.rename(backup, target)
        raise
    if had:
        store.delete(backup)
