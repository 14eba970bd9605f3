"""Facts about single files, found by tasks that open them: digests of whole files and Parquet footers.

A scan of paths and sizes gives each task files of about one input split, or one larger file; no
content passes through Spark, and a file of any size is read in constant memory.  Where Arrow has no file
system for a path's scheme, contents come as values of the scan, and a file must then be below 2 GB.
"""

from __future__ import annotations

import hashlib
import io
import re

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..roles import ContractError

PIECE = 8 << 20
LOCATION = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*)://([^/]*)(/.*)")


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and the path in it, for a path as Spark's scans name it (not percent-encoded)."""
    if path.startswith(("file:", "/")):
        return pafs.LocalFileSystem(), re.sub("^(file:)?/+", "/", path)
    found = LOCATION.fullmatch(path)
    if not found:
        raise ValueError(f"{path} names no file system")
    scheme = {"s3a": "s3", "s3n": "s3"}.get(found[1], found[1])
    system, root = pafs.FileSystem.from_uri(f"{scheme}://{found[2]}/")
    return system, root.rstrip("/") + found[3]


def is_readable(path: str) -> bool:
    """Whether Arrow can open this file."""
    try:
        system, inner = locate(path)
        return system.get_file_info(inner).type == pafs.FileType.File
    except (OSError, ValueError, NotImplementedError):
        return False


def _each(find, schema: pa.Schema):
    """``find(open, path, size)`` gives the rows of one file."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                content = row.get("content")

                def opened(path=row["path"], content=content):
                    if content is not None:
                        return pa.PythonFile(io.BytesIO(content), mode="r")
                    system, inner = locate(path)
                    return system.open_input_file(inner)

                yield pa.RecordBatch.from_pylist(list(find(opened, row["path"], row["length"])), schema=schema)

    return run


def _hash(opened, path, size):
    digest, done, piece = hashlib.sha256(), 0, bytearray(PIECE)
    with opened() as stream:
        while count := stream.readinto(piece):
            digest.update(memoryview(piece)[:count])
            done += count
    if done != size:
        raise ContractError(f"{path} had {size} bytes when it was listed, {done} were read")
    yield {"path": re.sub("^file:/+", "/", path), "bytes": done, "sha256": digest.hexdigest()}


def _footer(opened, path, size):
    with opened() as stream:
        meta = pq.ParquetFile(stream).metadata
        for k in range(meta.num_row_groups):
            group = meta.row_group(k)
            codecs = sorted({group.column(c).compression for c in range(group.num_columns)})
            yield {"path": path, "row_group": k, "rows": group.num_rows, "codec": ",".join(codecs)}


def _over_files(spark: SparkSession, path: str, find, schema: pa.Schema, sql: str, glob: str | None) -> DataFrame:
    options = {"recursiveFileLookup": "true", **({"pathGlobFilter": glob} if glob else {})}
    files = spark.read.format("binaryFile").options(**options).load(path)
    first = files.select("path").first()
    streamed = first is None or is_readable(first["path"])
    return files.select("path", "length", *([] if streamed else ["content"])).mapInArrow(_each(find, schema), sql)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of every file below a path but empty ones, which Spark's scans leave out.  A file
    that changes while it is read stops the job."""
    schema = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string())])
    return _over_files(spark, path, _hash, schema, "path string, bytes long, sha256 string", None)


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """``path, row_group, rows, codec`` of every row group of the Parquet files below a path, from the footers."""
    schema = pa.schema([("path", pa.string()), ("row_group", pa.int32()), ("rows", pa.int64()), ("codec", pa.string())])
    return _over_files(spark, path, _footer, schema, "path string, row_group int, rows long, codec string", "*.parquet")


def layout_summary(spark: SparkSession, path: str) -> DataFrame:
    """``codec, files, row_groups, rows, most_rows``: a row for each codec."""
    groups = row_groups(spark, path).groupBy("codec", "path").agg(F.count("*").alias("g"), F.sum("rows").alias("r"), F.max("rows").alias("m"))
    return groups.groupBy("codec").agg(F.count("*").alias("files"), F.sum("g").alias("row_groups"), F.sum("r").alias("rows"), F.max("m").alias("most_rows"))
