"""Frozen stratified splits, folds and permutations, keyed by hash so that any engine repeats them."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import hash_key, ratio
from ..plans.prefix import prefix_sums
from ..plans.store import materialize
from ..roles import OUTCOME, ROW_ID, SEED, SPLITS, TREATMENT, ContractError, HeldOutAccessError
from .profile import complete_grid, joint_counts


def stratified_rank(df: DataFrame, strata: Sequence[str], seed, salt: str) -> DataFrame:
    """``id, strata, r, n``: the place of each row in its stratum's random order, from 1."""
    keyed = df.select(ROW_ID, *strata, hash_key(F.lit(salt), F.lit(str(seed)), F.col(ROW_ID)).alias("_h"))
    return prefix_sums(keyed, [F.asc("_h"), F.asc(ROW_ID)], {}, list(strata)).drop("_h")


def assign_split(df: DataFrame, seed: int = SEED, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """``id, split`` with the joint strata of treatment and outcome cut at rounded shares."""
    if not 0 < train < 1 or not 0 < validation < 1 or train + validation >= 1:
        raise ContractError("shares must be positive and leave a held-out part")
    ranked = stratified_rank(df, [TREATMENT, OUTCOME], seed, "split")
    first, second = F.floor(F.lit(train) * F.col("n") + 0.5), F.floor(F.lit(train + validation) * F.col("n") + 0.5)
    return ranked.select(ROW_ID, F.when(F.col("r") <= first, SPLITS[0]).when(F.col("r") <= second, SPLITS[1]).otherwise(SPLITS[2]).alias("split"))


def assign_ab(df: DataFrame, seed: int = SEED) -> DataFrame:
    """``id, fold``: joint strata in halves, A and B."""
    ranked = stratified_rank(df, [TREATMENT, OUTCOME], seed, "ab")
    return ranked.select(ROW_ID, F.when(F.col("r") <= F.floor(F.col("n") * 0.5 + 0.5), "A").otherwise("B").alias("fold"))


def assign_folds(df: DataFrame, k: int = 5, seed: int = SEED) -> DataFrame:
    """``id, fold_id``: ``k`` folds stratified by treatment."""
    if df.groupBy(TREATMENT).count().where(F.col("count") < k).count():
        raise ContractError(f"an arm has fewer than {k} rows")
    return stratified_rank(df, [TREATMENT], seed, "folds").select(ROW_ID, ((F.col("r") - 1) % k).cast("short").alias("fold_id"))


def quota_sample(df: DataFrame, membership: DataFrame, split: str, quota: int, seed: int = SEED) -> DataFrame:
    """``id`` of a sample of one split, stratified in proportion (this operator is a sample)."""
    part = df.join(membership.where(F.col("split") == split).select(ROW_ID), ROW_ID, "left_semi")
    total = part.agg(F.count("*").alias("_all"))
    ranked = stratified_rank(part, [TREATMENT, OUTCOME], seed, "smoke").crossJoin(F.broadcast(total))
    return ranked.where(F.col("r") <= F.floor(F.lit(float(quota)) * F.col("n") / F.col("_all") + 0.5)).select(ROW_ID)


def permute_treatment(df: DataFrame, replication: int | Column = 0, blocks: Sequence[str] = (), seed: int = SEED) -> DataFrame:
    """``id, t_perm``: treatment dealt anew within blocks, with each block's number of treated rows."""
    blocks = list(blocks)
    rep = replication if isinstance(replication, Column) else F.lit(replication)
    keyed = df.select(ROW_ID, *blocks, TREATMENT, hash_key(F.lit("perm"), F.lit(str(seed)), rep, F.col(ROW_ID)).alias("_h"))
    ranked = prefix_sums(keyed, [F.asc("_h"), F.asc(ROW_ID)], {"_t": F.col(TREATMENT)}, blocks)
    return ranked.select(ROW_ID, F.when(F.col("r") <= F.col("total__t"), 1).otherwise(0).cast("tinyint").alias("t_perm"))


#: Rounds of the keyed bijection, and the prime that its keys are numbers below.
ROUNDS, PRIME = 32, (1 << 31) - 1


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, ...]]:
    """Three pairs of numbers for each round, from digests of the seed."""
    digest = lambda i: hashlib.md5(f"swap|{seed}|{i}".encode()).hexdigest() + hashlib.md5(f"or not|{seed}|{i}".encode()).hexdigest()
    return [tuple(1 + int(digest(i)[8 * k : 8 * k + 8], 16) % (PRIME - 1) for k in range(6)) for i in range(rounds)]


def placed_in_blocks(df: DataFrame, blocks: Sequence[str] = (), *keep: str) -> DataFrame:
    """``id, place, n, treated, block, keep``: each row's place from 0 in its block by id, the block's rows and treated rows, and its
    least id.  One ranking pass serves all replications."""
    blocks, id_ = list(blocks), F.col(ROW_ID)
    slim = df.select(ROW_ID, *blocks, TREATMENT, *keep)
    ranked = prefix_sums(slim, [F.asc(ROW_ID)], {"_t": F.col(TREATMENT)}, blocks)
    if blocks:
        least = materialize(slim.groupBy(*blocks).agg(F.min(id_).alias("block")), "blocks").toDF(*[f"_k{k}" for k in range(len(blocks))], "block")
        same = F.lit(True)
        for k, b in enumerate(blocks):
            same = same & F.col(b).eqNullSafe(F.col(f"_k{k}"))
        ranked = ranked.join(least, same)
    else:
        ranked = ranked.withColumn("block", F.lit(0).cast("long"))
    return materialize(ranked.select(ROW_ID, (F.col("r") - 1).alias("place"), "n", F.col("total__t").cast("long").alias("treated"), "block", *keep), "placed")


class Deal:
    """New places of some rows, for any replication.  In a round a place and its mirror image about a key change sides together or not
    at all, by one bit for both, so this is a bijection of ``[0, n)`` for any ``n``.

    What depends on the block alone is computed once for each block.  Remainders by ``PRIME``, 2**31 - 1, are the low 31 bits plus the bits above
    them, and unsigned numbers wrap around, so the smaller of ``y`` and ``y + n`` is the one that is not negative."""

    def __init__(self, place: np.ndarray, n: np.ndarray, block: np.ndarray, keys: Sequence[tuple[int, ...]]):
        kinds, at = np.unique(np.stack([np.asarray(n, np.int64), np.asarray(block, np.int64) % PRIME]), axis=1, return_inverse=True)
        self.keys, self.at, (self.size, self.block) = keys, at.reshape(-1), kinds
        self.place, self.n = np.asarray(place).astype(np.uint64), self.size.astype(np.uint64)[self.at]
        self.large = len(self.size) > 0 and int(self.size.max()) > PRIME
        self.spare = [np.empty_like(self.place) for _ in range(4)]

    def places(self, replication: int) -> np.ndarray:
        (x, y, v, w), prime, e = self.spare, np.uint64(PRIME), replication % PRIME
        np.copyto(x, self.place)
        for a1, b1, a2, b2, a3, b3 in self.keys:
            k, m = (e * a1 + b1) % PRIME, 1 + (e * a3 + b3) % PRIME % (PRIME - 1)
            own = (e * a2 + b2) % PRIME + self.block
            own = np.where(own >= PRIME, own - PRIME, own)
            np.take(((k * PRIME + own) % self.size).astype(np.uint64), self.at, out=y, mode="clip")
            np.subtract(y, x, out=y)
            np.add(y, self.n, out=v)
            np.minimum(y, v, out=y)
            np.maximum(x, y, out=v)
            if self.large:
                np.remainder(v, prime, out=v)
            np.multiply(v, np.uint64(m), out=v)
            np.take(own.astype(np.uint64), self.at, out=w, mode="clip")
            np.add(v, w, out=v)
            np.right_shift(v, np.uint64(31), out=w)
            np.bitwise_and(v, prime, out=v)
            np.add(v, w, out=v)  # below 2 * PRIME + 1
            np.subtract(v, prime, out=w)
            np.minimum(v, w, out=v)  # the remainder, and its bit 30 decides
            np.right_shift(v, np.uint64(30), out=v)
            np.subtract(v, np.uint64(1), out=v)  # all ones to swap
            np.bitwise_xor(x, y, out=y)
            np.bitwise_and(y, v, out=y)
            np.bitwise_xor(x, y, out=x)
        return x.astype(np.int64)


#: Rows that a task deals at once, and numbers in an array of a round (64 KB, so that a round stays in a core's cache).
DEALT_ROWS, ROUND_CELLS = 1 << 18, 1 << 14


def sums_of_treated(place: np.ndarray, n: int, treated: int, block: int, more: np.ndarray, replications: Sequence[int], keys: Sequence[tuple[int, ...]]) -> np.ndarray:
    """For each replication the sum of ``more`` over the rows of one block, of at most ``PRIME`` rows, that are treated in it.

    The arithmetic of :class:`Deal` for many replications and rows of one block at once: places are 32 bits wide, and keys are columns of numbers."""
    e, prime, out = np.asarray(replications, np.int64) % PRIME, np.uint32(PRIME), np.zeros(len(replications), np.int64)
    columns = []
    for a1, b1, a2, b2, a3, b3 in keys:
        own = ((e * a2 + b2) % PRIME + block % PRIME) % PRIME
        mirror, factor = ((e * a1 + b1) % PRIME * PRIME + own) % n, 1 + (e * a3 + b3) % PRIME % (PRIME - 1)
        columns.append((mirror.astype(np.uint32)[:, None], factor.astype(np.uint64)[:, None], own.astype(np.uint64)[:, None]))
    size, low, shift, one, last = np.uint32(n), np.uint64(PRIME), np.uint64(31), np.uint32(1), np.int32(31)
    for start in range(0, len(place), ROUND_CELLS):
        some, weights = place[start : start + ROUND_CELLS], more[start : start + ROUND_CELLS]
        many = max(1, ROUND_CELLS // len(some))
        x32, v64 = np.empty((4, many, len(some)), np.uint32), np.empty((2, many, len(some)), np.uint64)
        for first in range(0, len(e), many):
            k = min(many, len(e) - first)
            (x, y, t, u), (v, w) = x32[:, :k], v64[:, :k]
            sign = t.view(np.int32)
            x[:] = some
            for mirror, factor, own in columns:
                np.subtract(mirror[first : first + k], x, out=y)  # wraps around below zero
                np.add(y, size, out=t)
                np.minimum(y, t, out=y)
                np.maximum(x, y, out=t)
                np.copyto(v, t)
                np.multiply(v, factor[first : first + k], out=v)
                np.add(v, own[first : first + k], out=v)
                np.right_shift(v, shift, out=w)
                np.bitwise_and(v, low, out=v)
                np.add(v, w, out=v)  # below 2 * PRIME
                np.copyto(t, v, casting="unsafe")
                np.subtract(t, prime, out=u)
                np.minimum(t, u, out=t)  # the remainder
                np.left_shift(t, one, out=t)
                np.right_shift(sign, last, out=sign)  # all ones to stay, by bit 30
                np.bitwise_xor(x, y, out=x)
                np.bitwise_and(x, t, out=x)
                np.bitwise_xor(x, y, out=x)
            out[first : first + k] += np.where(x < treated, weights, 0).sum(1)
    return out


def swap_or_not(place: np.ndarray, n: np.ndarray, block: np.ndarray, replication: int, keys: Sequence[tuple[int, ...]]) -> np.ndarray:
    """New places of one replication (:class:`Deal`)."""
    return Deal(place, n, block, keys).places(replication)


def permuted(placed: DataFrame, replications: range, seed: int = SEED) -> DataFrame:
    """``id, rep, t_perm``: treatment dealt anew within blocks in each replication.

    A keyed bijection takes a row's place to a new one by arithmetic alone, so no replication sorts or
    shuffles; the first ``treated`` new places are the treated ones, so counts are kept in every block, and replications do not depend on
    those before them."""
    keys = round_keys(seed)

    def run(batches):
        for batch in batches:
            place, n, treated, block = (batch.column(c).to_numpy() for c in ("place", "n", "treated", "block"))
            deal = Deal(place, n, block, keys)
            for rep in replications:
                t = (deal.places(rep) < treated).astype(np.int8)
                yield pa.RecordBatch.from_arrays([batch.column(ROW_ID), pa.array(np.full(len(t), rep, np.int32)), pa.array(t)], names=[ROW_ID, "rep", "t_perm"])

    return placed.select(F.col(ROW_ID).cast("long").alias(ROW_ID), "place", "n", "treated", "block").mapInArrow(run, f"{ROW_ID} long, rep int, t_perm byte")


def replicated_effects(df: DataFrame, replications: range, blocks: Sequence[str] = (), seed: int = SEED) -> DataFrame:
    """``rep, n1, y1, n0, y0, value``: the difference of outcome rates under each permutation of treatment.  Tasks send a
    row of sums for each replication.

    A permutation keeps the number of treated rows, so these would have ``n1`` times the most frequent outcome if all rows had it.  Only rows
    with another outcome are dealt anew, and what they differ by is added."""
    spark, keys = df.sparkSession, round_keys(seed)

    def dealt(batches) -> np.ndarray:
        t = pa.Table.from_batches(batches)
        place, n, treated, block, more = (t[c].to_numpy() for c in ("place", "n", "treated", "block", "more"))
        order = np.lexsort((place, block, n))
        place, n, treated, block, more = (c[order] for c in (place, n, treated, block, more))
        ends = np.nonzero((n[1:] != n[:-1]) | (block[1:] != block[:-1]))[0] + 1
        sums = np.zeros(len(replications), np.int64)
        for i, j in zip([0, *ends.tolist()], [*ends.tolist(), len(n)], strict=True):
            if n[i] <= PRIME:
                sums += sums_of_treated(place[i:j].astype(np.uint32), int(n[i]), int(treated[i]), int(block[i]), more[i:j], replications, keys)
            else:
                deal = Deal(place[i:j], n[i:j], block[i:j], keys)
                sums += np.array([more[i:j][deal.places(rep) < treated[i]].sum() for rep in replications], np.int64)
        return sums

    def run(batches):
        sums, held = np.zeros(len(replications), np.int64), []
        for batch in batches:
            held += [batch] if batch.num_rows else []
            if sum(b.num_rows for b in held) >= DEALT_ROWS:
                sums, held = sums + dealt(held), []
        if held:
            sums = sums + dealt(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(replications, np.int32)), pa.array(sums)], names=["rep", "more"])

    y = F.coalesce(F.col(OUTCOME).cast("long"), F.lit(0).cast("long"))
    treated = F.least(F.greatest(F.coalesce("treated", F.lit(0).cast("long")), F.lit(0).cast("long")), F.col("n"))
    placed = placed_in_blocks(df, blocks, OUTCOME).select("place", "n", treated.alias("treated"), "block", y.alias("y"))
    usual = placed.groupBy("y").count().orderBy(F.desc("count"), "y").first()  # one row
    most = F.lit(usual["y"] if usual else 0).cast("long")
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    others = placed.where(F.col("y") != most).withColumn("more", F.col("y") - most).drop("y")
    partial = others.repartition(tasks).mapInArrow(run, "rep int, more long")  # rows are spread, each is about to be dealt so many times
    sums = partial.groupBy("rep").agg(F.sum("more").alias("more"))
    first = F.when(F.col("place") == 0, F.col("treated"))  # of each block
    totals = placed.agg(F.count("*").alias("rows"), F.sum("y").alias("y"), F.sum(first).alias("n1")).where("rows > 0")
    each = spark.range(replications.start, replications.stop, replications.step).select(F.col("id").cast("int").alias("rep"))
    found = each.join(F.broadcast(sums), "rep", "left").crossJoin(F.broadcast(totals))  # a row for each replication, a single row
    y1 = F.col("n1") * most + F.coalesce("more", F.lit(0).cast("long"))
    found = found.select("rep", "n1", y1.alias("y1"), (F.col("rows") - F.col("n1")).alias("n0"), (F.col("y") - y1).alias("y0"))
    return found.withColumn("value", ratio(F.col("y1"), F.col("n1")) - ratio(F.col("y0"), F.col("n0")))


def continuation(existing: int, target: int, step: int = 2000) -> range:
    """Replication numbers to append."""
    if existing < 0 or target <= existing:
        raise ContractError("the target must exceed what exists")
    if target % step or existing % step:
        raise ContractError(f"totals must be multiples of {step}")
    return range(existing, target)


# Checks


def membership_digest(membership: DataFrame, value: str = "split") -> DataFrame:
    """Order-independent digest of a mapping: rows, and the exclusive-or and sum of row hashes."""
    h = F.conv(F.substring(hash_key(F.col(ROW_ID), F.col(value)), 1, 12), 16, 10).cast("long")
    return membership.agg(F.count("*").alias("rows"), F.bit_xor(h).alias("xor_hash"), F.sum(h % 1_000_003).alias("sum_hash"))


def verify_regeneration(df: DataFrame, expected, seed: int = SEED) -> None:
    if tuple(membership_digest(assign_split(df, seed)).first()) != tuple(expected):
        raise ContractError("the regenerated split differs from the frozen one")


def disjoint_and_complete(membership: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: ids in several splits, ids that a side lacks, and the verdict."""
    several = membership.groupBy(ROW_ID).agg(F.count_distinct("split").alias("k")).where("k > 1").agg(F.count("*").alias("overlapping"))
    ids = expected.select(ROW_ID)
    missing = ids.join(membership, ROW_ID, "left_anti").agg(F.count("*").alias("missing"))
    extra = membership.join(ids, ROW_ID, "left_anti").agg(F.count("*").alias("extra"))
    out = several.crossJoin(missing).crossJoin(extra)  # three single rows
    return out.withColumn("passed", (F.col("overlapping") == 0) & (F.col("missing") == 0) & (F.col("extra") == 0))


def split_support(df: DataFrame, membership: DataFrame, split: str) -> DataFrame:
    """The complete table of treatment and outcome counts of a development split."""
    if split == SPLITS[2]:
        raise HeldOutAccessError("held-out counts are not shown")
    part = df.join(membership.where(F.col("split") == split).select(ROW_ID), ROW_ID, "left_semi")
    return complete_grid(joint_counts(part))


def held_out_gate(df: DataFrame, membership: DataFrame) -> DataFrame:
    """Only whether every cell of the held-out part has rows."""
    part = df.join(membership.where(F.col("split") == SPLITS[2]).select(ROW_ID), ROW_ID, "left_semi")
    return complete_grid(joint_counts(part)).agg(F.when(F.bool_and(F.col("n") > 0), "PASS").otherwise("FAIL").alias("gate"))


class SplitDataset:
    """Row ids of the splits; the held-out ones only with a release marker."""

    RELEASED = "HELDOUT_RELEASED"

    def __init__(self, membership: DataFrame, release: dict | None = None):
        self._membership, self._release = membership, release or {}

    def _ids(self, split: str) -> DataFrame:
        return self._membership.where(F.col("split") == split).select(ROW_ID)

    def train_ids(self) -> DataFrame:
        return self._ids(SPLITS[0])

    def validation_ids(self) -> DataFrame:
        return self._ids(SPLITS[1])

    def held_out_ids(self) -> DataFrame:
        if self._release.get("status") != self.RELEASED:
            raise HeldOutAccessError("the held-out part is sealed")
        return self._ids(SPLITS[2])


def canonical_order(df: DataFrame, blocks: Sequence[str]) -> DataFrame:
    """Block columns first, then the id, missing values last."""
    return df.orderBy(*[F.asc_nulls_last(b) for b in blocks], F.asc(ROW_ID))
