"""Digests of a table's values in the order of its row ids: one SHA-256 tree for each column.

Ids are cut into fixed ranges.  A leaf is the SHA-256 of a range's cells in order of id, a missing cell
being told from all values; an inner node is that of its children's numbers and digests.  Digests
depend on neither batches nor partitions, see every exchange of two values, and two stored trees
name the first range in which their tables differ by reading one path down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.store import materialize
from ..roles import ROW_ID, ContractError

LEAF_ROWS, FAN_OUT, LEAST_HEIGHT = 4096, 256, 2
MISSING = "-"


def cell_text(column: Column, kind: T.DataType) -> Column:
    """A text of bounded length that is the same only for the same value; ``-`` if it is missing.  Floating
    values are given by their bits, so ``-0.0`` is not ``0.0``, and all NaN are one value."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        text = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), column.cast("double"))
    elif isinstance(kind, T.TimestampType):
        text = F.unix_micros(column).cast("string")
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        text = F.sha2(column.cast("binary"), 256)
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.sha2(F.to_json(column, {"ignoreNullFields": "false"}), 256)
    else:
        text = column.cast("string")
    return F.when(column.isNull(), F.lit(MISSING)).otherwise(text)


def require_ids(df: DataFrame, key: str, leaf_rows: int) -> int:
    """The number of the last range.  Ids must be there, not negative, and no more than a range has room
    for: that bounds what a leaf gathers."""
    at = F.floor(F.col(key) / F.lit(leaf_rows)).cast("long")
    counts = df.select(at.alias("node"), F.col(key).alias("id")).groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    found = counts.agg(F.count_if(F.col("node").isNull()).alias("gone"), F.min("least").alias("least"), F.max("n").alias("most"), F.max("node").alias("last")).first()
    if found["gone"] or (found["least"] or 0) < 0 or (found["most"] or 0) > leaf_rows:
        raise ContractError(f"row ids are missing, negative or repeated: {found.asDict()}")
    return found["last"] or 0


def merkle_tree(df: DataFrame, key: str = ROW_ID, leaf_rows: int = LEAF_ROWS, fan_out: int = FAN_OUT) -> DataFrame:
    """``column_name, level, node, rows, non_missing, digest`` of all nodes; leaves have level 0, the root of a
    column is node 0 of the highest level.  Rows are shuffled once, by range.  An empty table has no nodes."""
    if leaf_rows < 1 or fan_out < 2:
        raise ContractError("a leaf has at least one row and a node at least two children")
    last, height = require_ids(df, key, leaf_rows), LEAST_HEIGHT
    while fan_out**height <= last:
        height += 1
    names, kinds = df.columns, [f.dataType for f in df.schema]
    cells = [cell_text(F.col(f"`{c}`"), kind).alias(f"c{k}") for k, (c, kind) in enumerate(zip(names, kinds, strict=True))]
    rows = df.select(F.floor(F.col(key) / F.lit(leaf_rows)).cast("long").alias("node"), F.col(key).cast("long").alias("id"), *cells)
    packed = rows.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("id", *[f"c{k}" for k in range(len(names))]))).alias("rows"))
    column = lambda k: F.transform("rows", lambda r: r[f"c{k}"])
    facts = [
        F.struct(F.lit(c).alias("column_name"), F.size(F.filter(column(k), lambda x: x != MISSING)).cast("long").alias("non_missing"), F.sha2(F.array_join(column(k), "\n"), 256).alias("digest"))
        for k, c in enumerate(names)
    ]
    leaves = packed.select("node", F.size("rows").cast("long").alias("n"), F.explode(F.array(*facts)).alias("f"))
    level = materialize(leaves.select("f.column_name", F.lit(0).alias("level"), "node", F.col("n").alias("rows"), "f.non_missing", "f.digest"), "leaves")
    tree = level
    for k in range(1, height + 1):
        child = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: F.concat(x["node"].cast("string"), F.lit(":"), x["digest"])), "\n")
        up = level.withColumn("parent", F.floor(F.col("node") / F.lit(fan_out)).cast("long")).groupBy("column_name", "parent")
        up = up.agg(F.sum("rows").alias("rows"), F.sum("non_missing").alias("non_missing"), F.sha2(child, 256).alias("digest"))
        level = materialize(up.select("column_name", F.lit(k).alias("level"), F.col("parent").alias("node"), "rows", "non_missing", "digest"), "nodes")
        tree = tree.unionByName(level)
    return tree


def semantic_digest(df: DataFrame, key: str = ROW_ID, leaf_rows: int = LEAF_ROWS, fan_out: int = FAN_OUT) -> DataFrame:
    """``column_name, rows, non_missing, sha256``: a row for each column, the key among them.  The digest covers the
    column's name, type and root; a table without rows has the root of an empty text."""
    tree = merkle_tree(df, key, leaf_rows, fan_out)
    roots = tree.where(F.col("node") == 0).groupBy("column_name").agg(*[F.max_by(c, "level").alias(c) for c in ("rows", "non_missing", "digest")])
    declared = df.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(t).alias("type")) for n, t in df.dtypes])).alias("d")).select("d.*")
    number = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    found = declared.join(roots, "column_name", "left").select("column_name", "type", number("rows").alias("rows"), number("non_missing").alias("non_missing"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("root"))
    return found.select("column_name", "rows", "non_missing", F.sha2(F.concat_ws("\n", "column_name", "type", "root"), 256).alias("sha256"))


def first_difference(left: DataFrame, right: DataFrame, leaf_rows: int = LEAF_ROWS, fan_out: int = FAN_OUT) -> DataFrame:
    """``column_name, first_row, last_row``: for each column in which two trees of the same parameters differ, the
    first range of ids that does.  From the highest common level down, only the children of one node of
    a column are read; what is broadcast is a row for each column."""
    tops = [t.agg(F.max("level")).first()[0] for t in (left, right)]
    if None in tops:
        tops = [0]  # against an empty table the first leaf differs
    at = None
    for k in range(min(tops), -1, -1):
        a, b = (t.where(F.col("level") == k).select("column_name", "node", F.col("digest").alias(name)) for t, name in ((left, "_a"), (right, "_b")))
        if at is not None:
            inside = lambda t, at=at: t.withColumn("_up", F.floor(F.col("node") / F.lit(fan_out)).cast("long")).join(F.broadcast(at), ["column_name", "_up"], "left_semi").drop("_up")
            a, b = inside(a), inside(b)
        changed = a.join(b, ["column_name", "node"], "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).groupBy("column_name").agg(F.min("node").alias("_up"))
        at = materialize(changed, "changed")
    return at.select("column_name", (F.col("_up") * leaf_rows).alias("first_row"), ((F.col("_up") + 1) * leaf_rows - 1).alias("last_row"))
