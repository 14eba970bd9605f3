"""Replicated permutations by a keyed bijection, and bootstrap picks by split multinomials."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tests.test_operators import audit_frame
from upliftforge.functions import digest
from upliftforge.functions.scalar import hash_uniform
from upliftforge.operators import ranking, resample, split
from upliftforge.roles import ROW_ID, TREATMENT, ContractError


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1024])
def test_swap_or_not_is_a_bijection(n):
    keys, place = split.round_keys(42), np.arange(n)
    seen = {tuple(split.swap_or_not(place, np.full(n, n), np.full(n, 17), rep, keys)) for rep in range(40)}
    assert all(sorted(x) == list(range(n)) for x in seen)
    assert len(seen) > 1 or n == 1
    assert n < 97 or len(seen) == 40


def test_places_are_even():
    keys, n = split.round_keys(7), 50
    moved = np.array([split.swap_or_not(np.arange(n), np.full(n, n), np.full(n, 3), rep, keys) for rep in range(2000)])
    for first in (0, 20, 49):  # every row comes to every place about as often, and pairs come together by chance
        times = np.bincount(moved[:, first], minlength=n)
        assert ((times - 40) ** 2 / 40).sum() < 90
    together = ((moved[:, 3] < 25) & (moved[:, 4] < 25)).mean()
    assert together == pytest.approx(25 / 50 * 24 / 49, abs=0.04)


def test_permutations_keep_blocks(spark):
    df = audit_frame(spark, 300).withColumn("_b", F.when(F.col(ROW_ID) % 3 > 0, F.col(ROW_ID) % 3))
    placed = split.placed_in_blocks(df, ["_b"])
    found = split.permuted(placed, range(0, 6)).join(df.select(ROW_ID, "_b", TREATMENT), ROW_ID)
    kept = found.groupBy("rep", "_b").agg(F.sum("t_perm").alias("dealt"), F.sum(TREATMENT).alias("had")).collect()
    assert len(kept) == 18 and all(r.dealt == r.had for r in kept)
    later = {(r[ROW_ID], r.t_perm) for r in split.permuted(placed, range(4, 5)).collect()}
    assert later == {(r[ROW_ID], r.t_perm) for r in found.where("rep = 4").collect()}
    effects = {r.rep: tuple(r)[1:5] for r in split.replicated_effects(df, range(0, 6), ["_b"]).collect()}
    y = found.join(df.select(ROW_ID, "conversion"), ROW_ID).groupBy("rep").agg(F.sum("t_perm").alias("n1"), F.sum(F.col("t_perm") * F.col("conversion")).alias("y1")).collect()
    assert all(effects[r.rep][:2] == (r.n1, r.y1) for r in y)


def test_deal_matches_plain_arithmetic():
    rng, keys = np.random.default_rng(1), split.round_keys(42)
    block = rng.integers(0, 9, 500)
    n = np.array([1, 2, 50, 1000, 1 << 20, (1 << 31) - 1, 1 << 31, (1 << 40) + 7, 3])[block]
    place = (rng.random(500) * n).astype(np.int64)
    for rep in (0, 3, 1999):
        want = []
        for x, size, b in zip(place.tolist(), n.tolist(), block.tolist(), strict=True):
            for a1, b1, a2, b2, a3, b3 in keys:
                k, m, add = (rep * a1 + b1) % split.PRIME, 1 + (rep * a3 + b3) % split.PRIME % (split.PRIME - 1), ((rep * a2 + b2) % split.PRIME + b) % split.PRIME
                y = ((k * split.PRIME + add) % size - x + size) % size
                x = y if (max(x, y) % split.PRIME * m + add) % split.PRIME < 1 << 30 else x
            want.append(x)
        assert split.Deal(place, n, block, keys).places(rep).tolist() == want


def test_sums_of_a_block_match_its_deal():
    rng, keys, reps = np.random.default_rng(2), split.round_keys(42), range(5, 12)
    for n, rows in ((1, 1), (2, 2), (1000, 700), (360_000, split.ROUND_CELLS + 3), (split.PRIME, 900), (split.PRIME - 1, 900)):
        place = np.unique(np.concatenate([[0, n - 1], rng.integers(0, n, rows)]))
        more, block, treated = rng.integers(-3, 9, len(place)), int(rng.integers(0, 1 << 40)), n * 17 // 20
        want = [int(more[split.swap_or_not(place, np.full(len(place), n), np.full(len(place), block), r, keys) < treated].sum()) for r in reps]
        assert split.sums_of_treated(place.astype(np.uint32), n, treated, block, more, reps, keys).tolist() == want


@pytest.mark.parametrize("outcome", ["conversion", "1 - conversion", "conversion * 7 + id % 3"])
def test_only_unusual_outcomes_are_dealt(spark, monkeypatch, outcome):
    df = audit_frame(spark, 300).withColumn("conversion", F.expr(outcome.replace("id", ROW_ID)).cast("long")).withColumn("_b", F.col(ROW_ID) % 3)
    found = {r.rep: tuple(r)[1:5] for r in split.replicated_effects(df, range(2, 6), ["_b"]).collect()}
    dealt = split.permuted(split.placed_in_blocks(df, ["_b"]), range(2, 6)).join(df.select(ROW_ID, "conversion"), ROW_ID)
    t, y = F.col("t_perm").cast("long"), F.col("conversion")
    want = dealt.groupBy("rep").agg(F.sum(t), F.sum(t * y), F.sum(1 - t), F.sum((1 - t) * y)).collect()
    assert found == {r[0]: tuple(r)[1:] for r in want}
    rows = []  # rows that tasks deal: at most those without the most frequent outcome
    read, kept = DataFrame.repartition, df.groupBy("conversion").count().agg(F.sum("count") - F.max("count")).first()[0]
    monkeypatch.setattr(DataFrame, "repartition", lambda self, *a: rows.append(self.count()) or read(self, *a))
    split.replicated_effects(df, range(2), ["_b"]).collect()
    assert rows[-1] == kept


def test_counted_bits_are_those_of_md5():
    keys, counts = ["", "a|", "boot|42|7|1|333|", "split|42|499|0|15|65535|", "x" * 48], [3, 1200, 0, 9, 1000]
    want = [int(hashlib.md5(f"{k}{j}".encode()).hexdigest()[:13], 16) for k, c in zip(keys, counts, strict=True) for j in range(1, c + 1)]
    assert digest.counted_bits(keys, counts, 1).tolist() == want
    assert digest.counted_bits(["k|"], [digest.AT_ONCE + 5])[-1] == int(hashlib.md5(f"k|{digest.AT_ONCE + 4}".encode()).hexdigest()[:13], 16)
    for k, c in (("x" * 54, [11]), ("k", [20_000_000])):
        with pytest.raises(ContractError):
            digest.counted_bits([k], c)


def test_tasks_send_counts_not_picks(spark, monkeypatch):
    df = audit_frame(spark, 900).withColumn("score", F.col(ROW_ID) % 37)
    sent, kept = [], resample.buckets_near_points
    monkeypatch.setattr(resample, "COUNTED", 8)
    monkeypatch.setattr(resample, "buckets_near_points", lambda counts, by: sent.append(counts.agg(F.count("*"), F.sum("_b_m")).first()) or kept(counts, by))
    few = {r.draw: tuple(r) for r in resample.bootstrap_qini(df, 3).collect()}
    assert len(sent) == 1 and sent[0][0] <= 3 * 8 and sent[0][1] == 3 * 900
    monkeypatch.undo()
    assert few == {r.draw: tuple(r) for r in resample.bootstrap_qini(df, 3).collect()}


def test_parts_add_up(spark):
    assert [resample.part_levels(n) for n in (0, 1, 128, 129, 256, 257, 1 << 20)] == [0, 0, 0, 1, 1, 2, 13]
    counts, levels = resample.part_counts(spark, {0: 1000, 1: 5000}, 40)
    rows = counts.collect()
    for arm, n in ((0, 1000), (1, 5000)):
        mine = [r for r in rows if r[TREATMENT] == arm]
        assert {sum(r.c for r in mine if r.draw == d) for d in range(40)} == {n}
        assert all(0 <= r.part < 1 << levels for r in mine)
        table = np.zeros((40, 1 << levels))
        for r in mine:
            table[r.draw, r.part] = r.c
        p = 1 / (1 << levels)
        assert table.mean() == pytest.approx(n * p) and table.var() == pytest.approx(n * p * (1 - p), rel=0.2)


def test_picks_are_multinomial(spark):
    df = audit_frame(spark, 700)
    n = {r[TREATMENT]: r["count"] for r in df.groupBy(TREATMENT).count().collect()}
    weights = resample.bootstrap_weights(df, draws=60).join(df.select(ROW_ID, TREATMENT), ROW_ID).collect()
    for arm, size in n.items():
        mine = [r for r in weights if r[TREATMENT] == arm]
        assert {sum(r.w for r in mine if r.draw == d) for d in range(60)} == {size}
        drawn = len(mine) / (60 * size)  # a row is left out with chance (1 - 1/n)**n
        assert drawn == pytest.approx(1 - (1 - 1 / size) ** size, abs=0.02)
        assert sum(r.w**2 for r in mine) / (60 * size) == pytest.approx(2 - 1 / size, abs=0.1)


def test_tailed_bits_are_those_of_md5():
    tails, prefixes = ["", "|7", "|-5", *(f"|{k * 371}" for k in range(20_000)), "|" + "9" * 70], ["draw|42|7", "draw|42|12", "draw|42|199"]
    for prefix, bits in zip(prefixes, digest.tailed_bits(prefixes, tails), strict=True):
        assert bits[::97].tolist() == [int(hashlib.md5((prefix + t).encode()).hexdigest()[:13], 16) for t in tails[::97]]
        assert int(bits[-1]) == int(hashlib.md5((prefix + tails[-1]).encode()).hexdigest()[:13], 16)


@pytest.mark.parametrize("cells", [1 << 21, 40])
def test_random_rankings_are_counted_in_tasks(spark, monkeypatch, cells):
    df = audit_frame(spark, 3000)
    score = hash_uniform(F.lit("draw"), F.lit("42"), F.col("draw"), F.col(ROW_ID))
    each = df.select(ROW_ID, TREATMENT, "conversion").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("score", score)
    plain = {r.draw: tuple(r)[2:] for r in ranking.qini_summary(each, ["draw"]).collect()}

    def refuse(*_):
        raise AssertionError("rows were repeated for every draw")

    monkeypatch.setattr(resample, "DRAW_CELLS", cells, raising=False)
    monkeypatch.setattr(F, "explode", refuse)
    found = {r.draw: tuple(r)[1:] for r in resample.random_reference(df, 12).collect()}
    assert found.keys() == plain.keys() and all(found[d] == pytest.approx(plain[d], rel=1e-9) for d in plain)
