"""SimHash near-duplicate detection by tiled exact comparison.

Fingerprints of word shingles are compared exactly: tiles of fingerprints are combined with a
vectorised exclusive-or and bit count, and tile pairs whose population counts differ by more than
the radius are skipped.  So that the number of tile pairs stays near-linear in the corpus, tiles are
formed within buckets: the bits are cut into blocks, and fingerprints within the radius agree on
all but ``radius`` of these, so comparing those that agree on some choice of blocks loses no link.
A bucket that outgrows a tile is cut by population count and hash, and its tile pairs go to
different tasks; the planner leaves out the pairs whose counts differ too much.  From each tile
pair only a spanning forest of its links is emitted.

Equal fingerprints are reduced to one before all this.  Null texts count as empty; texts without a
word have fingerprint zero and link like any other.  Repeated rows share a component, extra
columns are ignored by the search and kept by :func:`keep_first`, whatever their names, an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, fresh, join_checked, materialize, release
from .components import components

BITS = 64


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Bit majority over the XXH64 of all shingles, repeats included."""
    import xxhash

    found = (text or "").encode().lower().split()  # ASCII letters and white space only
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) < words:
        shingles = [joined]
    else:
        size = np.fromiter(map(len, found), np.int64, len(found))
        end = np.cumsum(size + 1) - 1
        begin = (end - size)[: len(found) - words + 1].tolist()
        shingles = [joined[s:e] for s, e in zip(begin, end[words - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, seed) for s in shingles]), np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 255 * 64):  # sums of up to 255 bits fit in a byte
        bits = np.unpackbits(hashes[at : at + 255 * 64], axis=1)
        whole = len(bits) // 255 * 255
        if whole:
            ones += bits[:whole].reshape(-1, 255, BITS).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        ones += bits[whole:].sum(0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(words: int, seed: int):
    def run(batches):
        for batch in batches:
            values = [fingerprint(t, words, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64)), batch.column(2)], names=["doc_id", "fp", "th"]
            )
        release()

    return run


def block_masks(blocks: int, radius: int) -> list[int]:
    """A mask for each choice of ``blocks - radius`` blocks, as signed 64-bit numbers."""
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    block = [(1 << cuts[k + 1]) - (1 << cuts[k]) for k in range(blocks)]
    masks = [sum(c) for c in itertools.combinations(block, blocks - radius)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def blocks_for(rows: int, radius: int) -> int:
    """So many blocks that an average bucket stays at some thousands of fingerprints."""
    blocks = radius + 1
    while rows >> (BITS * (blocks - radius) // blocks) > 4096 and blocks < radius + 4:
        blocks += 1
    return blocks


def forest(left: np.ndarray, right: np.ndarray | None, radius: int, tile: int = 256) -> list[tuple[int, int]]:
    """A spanning forest of the links between two sets of distinct fingerprints, or within one if
    ``right`` is None.  Rows are ordered by population count; sub-tiles out of range are skipped."""
    a = left[np.argsort(np.bitwise_count(left), kind="stable")]
    b = a if right is None else right[np.argsort(np.bitwise_count(right), kind="stable")]
    shift = 0 if right is None else len(a)
    nodes = a if right is None else np.concatenate([a, b])
    pa_, pb = np.bitwise_count(a).astype(np.int16), np.bitwise_count(b).astype(np.int16)
    label = np.arange(len(nodes))
    for i in range(0, len(a), tile):
        x = a[i : i + tile]
        low, high = pa_[i], pa_[i + len(x) - 1]
        for j in range(i if right is None else 0, len(b), tile):
            y = b[j : j + tile]
            if pb[j] - high > radius or low - pb[j + len(y) - 1] > radius:
                continue
            r, c = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            r, c = r + i, c + j + shift
            keep = r != c
            r, c = r[keep], c[keep]
            while len(r):
                lr, lc = label[r], label[c]
                differ = lr != lc
                if not differ.any():
                    break
                r, c, lr, lc = r[differ], c[differ], lr[differ], lc[differ]
                np.minimum.at(label, np.maximum(lr, lc), np.minimum(lr, lc))
                while True:  # follow labels to their roots
                    up = label[label]
                    if (up == label).all():
                        break
                    label = up
    moved = np.nonzero(label != np.arange(len(nodes)))[0]
    return list(zip(nodes[moved].tolist(), nodes[label[moved]].tolist(), strict=True))


def _cells(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of one cell after the other, from batches sorted by cell: fingerprints and sides."""
    kept: list[np.ndarray] | None = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            fresh = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
            kept = fresh if kept is None else [np.concatenate(x) for x in zip(kept, fresh, strict=True)]
        if kept is None or not len(kept[0]):
            continue
        starts = np.nonzero(np.any([np.diff(x) != 0 for x in kept[:-2]], axis=0))[0] + 1
        edges = [0, *starts.tolist()]
        if batch is None:
            edges.append(len(kept[0]))
        for s, e in itertools.pairwise(edges):
            if e - s > 1:
                yield kept[-2][s:e], kept[-1][s:e]
        kept = [x[edges[-1] :] for x in kept]


def _compare(radius: int):
    def run(batches):
        us, vs = [], []
        for fps, sides in _cells(batches):
            fps = fps.view(np.uint64)
            left, right = fps[sides <= 0], fps[sides >= 0]
            for u, v in forest(left, None if sides[0] == 0 else right, radius) if len(left) and len(right) else ():
                us.append(u)
                vs.append(v)
            if len(us) > 50_000:
                yield _links(us, vs)
                us, vs = [], []
        yield _links(us, vs)

    return run


def _links(us: list[int], vs: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (us, vs)], names=["u", "v"])


def link_forest(nodes: DataFrame, radius: int = 4, tile: int = 1024, blocks: int | None = None) -> DataFrame:
    """Links that connect what the exact comparison of all distinct ``fp`` of ``nodes`` connects."""
    masks = block_masks(blocks or blocks_for(nodes.count(), radius), radius)
    keyed = nodes.select(
        "fp", F.bit_count("fp").cast("int").alias("ones"), F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "key")
    )
    sizes = keyed.groupBy("choice", "key", "ones").agg(F.count("*").alias("n"))
    totals = sizes.groupBy("choice", "key").agg(F.sum("n").alias("all")).where(F.col("all") > tile)
    # Buckets beyond a tile: one tile for each population count and slot.
    large = materialize(sizes.join(totals, ["choice", "key"]).select("choice", "key", "ones", F.ceil(F.col("n") / tile).cast("int").alias("slots")), "tiles")
    one = large.select("choice", "key", "ones", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    tile_id = F.col("ones") * F.lit(1 << 24) + F.col("slot")
    one = one.select("choice", "key", "ones", tile_id.cast("long").alias("a"))
    other = one.select("choice", "key", F.col("ones").alias("ones_b"), F.col("a").alias("b"))
    pairs = one.join(other, ["choice", "key"]).where((F.col("a") <= F.col("b")) & (F.abs(F.col("ones") - F.col("ones_b")) <= radius))
    pairs = pairs.select("choice", "key", "a", "b")

    placed = keyed.join(large, ["choice", "key", "ones"], "left")
    small = placed.where("slots is null").select("choice", "key", F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"), "fp", F.lit(0).alias("side"))
    mine = (F.col("ones") * F.lit(1 << 24) + F.pmod(F.xxhash64("fp"), F.col("slots"))).cast("long")
    rows = placed.where("slots is not null").select("choice", "key", "fp", mine.alias("tile"))
    firsts = rows.join(pairs.withColumn("tile", F.col("a")), ["choice", "key", "tile"])
    firsts = firsts.select("choice", "key", "a", "b", "fp", F.when(F.col("a") == F.col("b"), 0).otherwise(-1).alias("side"))
    seconds = rows.join(pairs.where("a < b").withColumn("tile", F.col("b")), ["choice", "key", "tile"])
    seconds = seconds.select("choice", "key", "a", "b", "fp", F.lit(1).alias("side"))
    cells = small.union(firsts).union(seconds)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["choice", "key", "a", "b"]
    return cells.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(_compare(radius), "u long, v long")


def near_duplicates(
    docs: DataFrame, radius: int = 4, words: int = 4, seed: int = 42, tile: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, fingerprint, component_id, component_size, th, is_first`` of every row.  The
    component's id is the least ``doc_id`` in it (null if no member has one); ``is_first`` marks the
    rows with the least id and then hash ``th`` of the text."""
    rows = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text")
    bound_batches(docs.sparkSession)
    hashed = rows.select("doc_id", "text", F.xxhash64("text").alias("th"))
    prints = materialize(hashed.mapInArrow(_fingerprints(words, seed), "doc_id long, fp long, th long"), "prints")
    place = F.struct(F.col("doc_id").isNull().alias("anonymous"), "doc_id", "th")
    nodes = materialize(prints.groupBy("fp").agg(F.min(place).alias("first"), F.count("*").alias("n")), "nodes")
    roots = materialize(components(link_forest(nodes, radius, tile)), "roots")
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    # Both written before they are joined, so that a giant component or group of copies can be split.
    whole = materialize(rooted.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("component_size")), "components")
    named = materialize(join_checked(rooted.select("fp", "root"), whole, "root").select("fp", "first", "component_size"), "named")
    out = join_checked(prints, named, "fp")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    fingerprint_hex = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return out.select("doc_id", fingerprint_hex, F.col("first.doc_id").alias("component_id"), "component_size", "th", is_first.alias("is_first"))


def keep_first(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component of :func:`near_duplicates`, with all its columns."""
    i, h = fresh(docs, "id", "th")
    key = [F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.col(f"`{text_col}`").cast("string"))]
    names = [F.col("doc_id").alias(i), F.col("th").alias(h)]
    match = key[0].eqNullSafe(F.col(i)) & (key[1] == F.col(h))
    others = materialize(found.where("not is_first").select(*names).distinct(), "others")
    kept = join_checked(docs, others, match, "left_anti")
    repeated = materialize(found.where("is_first").groupBy("doc_id", "th").count().where("count > 1").select(*names), "repeated")
    if repeated.isEmpty():
        return kept
    once = join_checked(kept, repeated, match, "left_semi").dropDuplicates([id_col, text_col])
    return join_checked(kept, repeated, match, "left_anti").union(once)
