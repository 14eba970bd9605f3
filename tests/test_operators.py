"""Goldens, literal-loop checks, metamorphic checks and gates that must stop."""

import math
import random

import pytest
from pyspark.sql import functions as F

from upliftforge.functions.scalar import missing_to_null
from upliftforge.operators import balance, gates, joins, meta, profile, ranking, resample, sketches, split
from upliftforge.plans.prefix import exact_quantiles, prefix_sums
from upliftforge.roles import FEATURES, LABELS, OUTCOME, ROW_ID, TREATMENT, ContractError, HeldOutAccessError, assert_feature_contract

NAMES = [*FEATURES, *LABELS, ROW_ID]


def audit_rows(n=20):
    return [tuple([float(i + j / 100) for j in range(12)] + [i % 2, (i // 2) % 2, (i + 1) % 2, i % 2, i]) for i in range(n)]


def audit_frame(spark, n=20, rows=None):
    schema = ", ".join([f"{f} double" for f in FEATURES] + [f"{c} long" for c in (*LABELS, ROW_ID)])
    return spark.createDataFrame(rows if rows is not None else audit_rows(n), schema)


def scored_frame(spark, rows):
    return spark.createDataFrame(rows, f"{ROW_ID} long, score double, {TREATMENT} long, {OUTCOME} long")


def good_rows():
    return [(i, 20.0 - i, int(i % 2 == 0), int((i < 10) == (i % 2 == 0))) for i in range(20)]


def loop_metrics(rows):
    """Definition by definition."""
    ordered = sorted(rows, key=lambda r: (-r[1], r[0]))
    n, points, state = len(rows), [], [0, 0, 0, 0]
    at = {}
    for r, (_, _, t, y) in enumerate(ordered, 1):
        state[0 if t else 1] += 1
        state[2 if t else 3] += y
        at[r] = tuple(state)
        if state[1]:
            points.append((r / n, state[2] - state[3] * state[0] / state[1]))
    full = points[-1][1]
    if len(points) > 151:
        points = [points[k] for k in sorted({round(i * ((len(points) - 1) / 150)) for i in range(151)})]
    curve = [(0.0, 0.0), *points]
    area = sum(0.5 * (b[1] + a[1]) * (b[0] - a[0]) for a, b in zip(curve, curve[1:]))
    uplift = {}
    for k, label in ((0.1, "10"), (0.2, "20"), (0.3, "30"), (0.5, "50"), (1.0, "100")):
        n1, n0, y1, y0 = at[min(n, max(1, math.ceil(k * n)))]
        uplift[label] = None if not n1 or not n0 else y1 / n1 - y0 / n0
    return curve, area, full / 2, uplift


def compare(spark, rows, partitions=None):
    df = scored_frame(spark, rows)
    df = df.repartition(partitions) if partitions else df
    curve, area, half, uplift = loop_metrics(rows)
    found = ranking.evaluate_ranking(df)
    got = sorted((r.coverage, r.qini_gain) for r in found["curve"].collect())
    assert got == [(pytest.approx(a), pytest.approx(b)) for a, b in sorted(curve)]
    s = found["summary"].first()
    assert (s.qini_area, s.theoretical_random) == (pytest.approx(area), pytest.approx(half))
    assert {r.k: r.uplift for r in found["top_k"].collect()} == {k: pytest.approx(v) if v is not None else None for k, v in uplift.items()}


def test_ranking_golden(spark):
    compare(spark, good_rows())
    at = {r.k: r.uplift for r in ranking.uplift_at_k(scored_frame(spark, good_rows())).collect()}
    assert at == {"10": 1.0, "20": 1.0, "30": 1.0, "50": 1.0, "100": 0.0}
    reverse = [(i, -s, t, y) for i, s, t, y in good_rows()]
    assert {r.k: r.uplift for r in ranking.uplift_at_k(scored_frame(spark, reverse)).collect()}["10"] == -1.0


@pytest.mark.parametrize("partitions", [1, 7])
def test_ranking_matches_loop(spark, partitions):
    rnd = random.Random(partitions)
    rows = [(i, rnd.choice([0.1, 0.2, rnd.gauss(0, 1)]), int(rnd.random() < 0.5), int(rnd.random() < 0.3)) for i in range(300)]
    compare(spark, rows, partitions)


def test_sparse_top_is_unsupported(spark):
    rows = [(i, 10.0 - i, int(i < 8), (i + 1) % 2) for i in range(10)]
    found = {r.k: (r.uplift, r.status) for r in ranking.uplift_at_k(scored_frame(spark, rows)).collect()}
    assert found["10"] == (None, "UNSUPPORTED_METRIC") and found["100"][1] == "OK"
    assert min(r.coverage for r in ranking.qini_curve(scored_frame(spark, rows)).collect() if r.coverage > 0) == pytest.approx(0.9)


def test_rankable_gates(spark):
    good = good_rows()
    for bad in ([(i, float("nan"), t, y) for i, s, t, y in good], [(0, s, t, y) for i, s, t, y in good], [(i, s, 1, y) for i, s, t, y in good], [(i, s, 2, y) for i, s, t, y in good], good[:9]):
        with pytest.raises(ContractError):
            gates.require_rankable(scored_frame(spark, bad), least_rows=10)
    assert gates.require_rankable(scored_frame(spark, good), least_rows=10).count() == 20
    assert gates.require_rankable(scored_frame(spark, good).withColumn("m", F.col(ROW_ID) >= 10), least_rows=10, by=["m"]).count() == 20
    with pytest.raises(ContractError):
        gates.require_rankable(scored_frame(spark, good).withColumn("m", F.col(ROW_ID) % 3), least_rows=10, by=["m"])
    for use in (ranking.evaluate_ranking, ranking.decile_uplift):
        with pytest.raises(ContractError):
            use(scored_frame(spark, good[:9]))


def test_prefix_sums_match_python(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice("ab"), rnd.randint(0, 5), rnd.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, s int, v long").repartition(6)
    got = {r.id: (r.r, r.c, r.n, r.total_c) for r in prefix_sums(df, [F.desc("s"), F.asc("id")], {"c": F.col("v")}, ["g"]).collect()}
    for g in "ab":
        part, run = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0])), 0
        for k, r in enumerate(part, 1):
            run += r[3]
            assert got[r[0]] == (k, run, len(part), sum(x[3] for x in part))


def test_prefix_sums_with_null_groups(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x")], "id long, g string")
    assert sorted((r.id, r.r) for r in prefix_sums(df, [F.asc("id")], {}, ["g"]).collect()) == [(1, 1), (2, 2), (3, 1)]


def test_ate(spark):
    rows = [(i, 0.0, int(i < 10), int(i in (0, 1, 2, 3, 10))) for i in range(20)]
    r = ranking.ate(scored_frame(spark, rows)).first()
    assert r.ate == pytest.approx(0.3) and r.se == pytest.approx(math.sqrt(0.4 * 0.6 / 10 + 0.1 * 0.9 / 10)) and r.relative_lift == pytest.approx(3.0)
    none = [(i, 0.0, int(i < 10), int(i < 4)) for i in range(20)]
    assert ranking.ate(scored_frame(spark, none)).first().relative_lift is None


def test_duplicate_golden(spark):
    rows = audit_rows(4)
    copy = [*rows[0][:13], 1 - rows[0][13], *rows[0][14:16], 4]
    df = audit_frame(spark, rows=[*rows, tuple(copy)])
    sets = {"1": [ROW_ID], "2": [*FEATURES, TREATMENT, OUTCOME], "3": [*FEATURES, TREATMENT], "4": list(FEATURES), "5": [*FEATURES, TREATMENT, OUTCOME, ROW_ID]}
    assert [r.rows_beyond_first for r in profile.duplicate_audit(df, sets).orderBy("definition").collect()] == [0, 0, 1, 1, 0]
    assert profile.duplicate_summary(audit_frame(spark, 4), "x", [ROW_ID]).first().largest == 1


def test_missing_is_one_profile(spark):
    df = spark.createDataFrame([(float("nan"),), (float("nan"),), (0.0,), (None,), (None,)], "f0 double")
    assert missing_to_null(df).groupBy("f0").count().count() == 2


def test_float32_golden(spark):
    df = spark.createDataFrame([(1.00000001,), (1.00000002,)], "f0 double")
    assert tuple(profile.float32_collisions(df).first()) == (0, 1, 1)


def test_smd_golden(spark):
    rows = [(float(v), int(k >= 4)) for k, v in enumerate([0, 1, 2, 3, 2, 3, 4, 5])]
    df = spark.createDataFrame(rows, f"f0 double, {TREATMENT} long").withColumns({f: F.lit(1.0) for f in FEATURES[1:]})
    table = {r.feature: r for r in balance.smd_balance(df).collect()}
    assert table["f0"].smd_signed == pytest.approx(2 / math.sqrt(5 / 3)) and table["f1"].status == balance.CONSTANT
    s = balance.balance_summary(balance.smd_balance(df)).first()
    assert (s.max_feature, s.eligible, s.constants, s.invalid) == ("f0", 1, 11, 0)
    apart = df.withColumn("f1", F.col(TREATMENT).cast("double"))
    assert {r.feature: r.status for r in balance.smd_balance(apart).collect()}["f1"] == balance.ZERO_SD
    few = df.withColumn("f2", F.when((F.col(TREATMENT) == 0) | (F.col("f0") == 5), F.col("f0")))
    assert {r.feature: r.status for r in balance.smd_balance(few).collect()}["f2"] == balance.TOO_FEW


def test_gates_stop(spark):
    assert gates.require_population(audit_frame(spark)).count() == 20
    for change in ({TREATMENT: F.lit(2).cast("long")}, {OUTCOME: F.lit(None).cast("long")}, {"f3": F.lit(float("inf"))}, {ROW_ID: F.lit(1).cast("long")}, {TREATMENT: F.lit(1).cast("long")}):
        with pytest.raises(ContractError):
            gates.require_population(audit_frame(spark).withColumns(change))
    with pytest.raises(ContractError):
        assert_feature_contract([*FEATURES[:-1], TREATMENT])
    with pytest.raises(ContractError):
        assert_feature_contract(FEATURES[::-1])
    with pytest.raises(ContractError):
        gates.arms(audit_frame(spark).where("treatment = 1"))
    summary = gates.identity_summary(audit_frame(spark).where(f"{ROW_ID} > 0")).first()
    assert summary.unique_ids and not summary.dense_ids


def test_split_is_stable_and_sealed(spark):
    df = audit_frame(spark, 400)
    members = split.assign_split(df)
    a = sorted(map(tuple, members.collect()))
    assert a == sorted(map(tuple, split.assign_split(df.repartition(5).orderBy(F.desc(ROW_ID))).collect()))
    assert a != sorted(map(tuple, split.assign_split(df, seed=7).collect()))
    count = {s: sum(1 for x in a if x[1] == s) for s in ("train", "validation", "held_out")}
    assert count == {"train": 280, "validation": 60, "held_out": 60}
    split.verify_regeneration(df, split.membership_digest(members).first())
    with pytest.raises(ContractError):
        split.verify_regeneration(df, split.membership_digest(split.assign_split(df, 7)).first())
    with pytest.raises(HeldOutAccessError):
        split.SplitDataset(members).held_out_ids()
    with pytest.raises(HeldOutAccessError):
        split.split_support(df, members, "held_out")
    assert split.SplitDataset(members, {"status": "HELDOUT_RELEASED"}).held_out_ids().count() == 60
    with pytest.raises(ContractError):
        split.assign_split(df, train=0.9, validation=0.2)


def test_folds_and_permutation(spark):
    df = audit_frame(spark, 100)
    sizes = {(r.fold_id, r.treatment): r["count"] for r in df.join(split.assign_folds(df), ROW_ID).groupBy("fold_id", TREATMENT).count().collect()}
    assert set(sizes.values()) == {10} and len(sizes) == 10
    with pytest.raises(ContractError):
        split.assign_folds(audit_frame(spark, 6))
    one, two = split.permute_treatment(df, 0, ["conversion"]), split.permute_treatment(df, 1, ["conversion"])
    assert sorted(map(tuple, one.collect())) != sorted(map(tuple, two.collect()))
    moved = joins.replace_treatment(df, one).groupBy(OUTCOME).agg(F.sum(TREATMENT).alias("t")).collect()
    assert sorted(map(tuple, moved)) == sorted(map(tuple, df.groupBy(OUTCOME).agg(F.sum(TREATMENT)).collect()))
    assert split.continuation(2000, 4000) == range(2000, 4000)
    for bad in ((10, 2000), (2000, 2000), (0, 2001)):
        with pytest.raises(ContractError):
            split.continuation(*bad)


def test_one_to_one_gates(spark):
    a = audit_frame(spark, 5).select(ROW_ID, "f0")
    assert joins.one_to_one(a, a.withColumnRenamed("f0", "g0")).count() == 5
    for b in (a.union(a.limit(1)), a.limit(4)):
        with pytest.raises(ContractError):
            joins.one_to_one(a, b.withColumnRenamed("f0", "g0"))


def test_response_diagnostics_match_loop(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([0.1, 0.3, 0.5, rnd.random()]), 0, int(rnd.random() < 0.4)) for i in range(200)]
    r = ranking.response_diagnostics(scored_frame(spark, rows)).first()
    p, q = [x[1] for x in rows if x[3]], [x[1] for x in rows if not x[3]]
    auc = sum((a > b) + 0.5 * (a == b) for a in p for b in q) / (len(p) * len(q))
    ap, seen = 0.0, 0.0
    for s in sorted({x[1] for x in rows}, reverse=True):
        top = [x for x in rows if x[1] >= s]
        hit = sum(x[3] for x in top)
        ap += (hit - seen) / len(p) * hit / len(top)
        seen = hit
    loss = -sum(math.log(x[1] if x[3] else 1 - x[1]) for x in rows) / len(rows)
    assert (r.roc_auc, r.average_precision, r.log_loss) == (pytest.approx(auc), pytest.approx(ap), pytest.approx(loss))


def test_bootstrap_counts(spark):
    df = scored_frame(spark, good_rows())
    w = resample.bootstrap_weights(df, draws=3).join(df.select(ROW_ID, TREATMENT), ROW_ID).groupBy("draw", TREATMENT).agg(F.sum("w").alias("w")).collect()
    assert len(w) == 6 and all(r.w == 10 for r in w)
    few = resample.percentile_interval(spark.createDataFrame([(1.0,), (None,)], "qini_above_random double"), expected=2).first()
    assert few.finite == 1 and few.low is None


def test_ranking_near_points_equals_ranking(spark):
    """Counts by bucket and the rows near kept positions give the curve of the whole ranking: few rows, many,
    controls only at the end, none at all, one bucket that holds most rows."""
    rnd, rows = random.Random(8), []
    shapes = {0: (90, 0.5), 1: (2000, 0.15), 2: (1500, 0.0), 3: (400, 0.0), 4: (3000, 0.5), 5: (1, 0.0), 6: (160, 0.9)}
    for draw, (n, share) in shapes.items():
        for i in range(n):
            score = 0.5 if draw == 4 and i % 3 else rnd.random()
            control = rnd.random() < share or (draw == 2 and score < 0.01)
            rows.append((i, score, int(not control), int(rnd.random() < 0.3), draw))
    df = spark.createDataFrame(rows, f"{ROW_ID} long, score double, {TREATMENT} long, {OUTCOME} long, draw int")
    whole = ranking.qini_curve(df, ["draw"]).collect()
    for buckets in (1, 40, 700):
        run = ranking.ranked_near_points(df, F.floor((1 - F.col("score")) * buckets), [F.desc("score"), F.asc(ROW_ID)], ["draw"])
        assert sorted(map(tuple, ranking.curve_points(run, ["draw"]).collect())) == sorted(map(tuple, whole))
    assert run.where("draw = 1").count() < 1500


def test_bootstrap_methods_share_draws(spark):
    df = scored_frame(spark, good_rows())
    both = df.withColumn("method", F.lit("a")).union(df.withColumn("score", -F.col("score")).withColumn("method", F.lit("b")))
    got = resample.bootstrap_qini(both, 4, methods=["method"]).collect()
    alone = {r.draw: r.qini_area for r in resample.bootstrap_qini(df, 4).collect()}
    assert len(got) == 8 and {r.draw: r.qini_area for r in got if r.method == "a"} == pytest.approx(alone)
    ends = {k: {r.draw: r.theoretical_random for r in got if r.method == k} for k in "ab"}
    assert ends["a"] == pytest.approx(ends["b"])


def test_binomial_ranks_and_actions():
    r = resample.binomial_ranks(2000, 0.95)
    assert r["lower_rank"] < 1900 < r["upper_rank"] and not r["lower_clipped"] and not r["upper_clipped"]
    assert resample.binomial_ranks(10, 0.99)["upper_clipped"]
    interval = {"lower_value": 0.4, "upper_value": 0.6, "lower_clipped": False, "upper_clipped": False}
    far = {**interval, "lower_value": 0.8, "upper_value": 0.9}
    assert not resample.action_stability(0.5, (0.5, 0.85), interval, far, 2000)["stable"]
    assert resample.action_stability(0.1, (0.5, 0.85), interval, far, 2000)["stable"]
    with pytest.raises(ContractError):
        resample.action_band(float("nan"), 0.1, 0.2)
    with pytest.raises(ContractError):
        resample.binomial_ranks(0, 0.5)


def test_null_order_statistic_golden(spark):
    null = spark.range(1, 2001).select(F.col("id").cast("double").alias("value"))
    found = {r.probability: (r["rank"], r.threshold, r.below, r.equal, r.above) for r in resample.null_order_statistic(null).collect()}
    assert found == {0.95: (1900, 1900.0, 1899, 1, 100), 0.99: (1980, 1980.0, 1979, 1, 20)}


def test_evidence_vocabulary(spark):
    rows = [("HARD_GATE", "PASS", "PASS", "EXECUTED"), ("HARD_GATE", "INFO", "PASS", "EXECUTED"), (None, None, None, "DEFERRED"), (None, "PASS", None, "DEFERRED"), ("X", "PASS", "PASS", "EXECUTED")]
    df = spark.createDataFrame(rows, "evidence_class string, evidence_status string, required_action string, execution_state string")
    assert resample.evidence_violations(df).count() == 3


def test_meta_algebra(spark):
    df = spark.createDataFrame([(0, 1, 1, 0.2, 0.5), (1, 0, 0, 0.1, 0.4)], f"{ROW_ID} long, {TREATMENT} long, {OUTCOME} long, mu0 double, mu1 double")
    found = {r[ROW_ID]: (r.arm, r.pseudo_effect) for r in meta.pseudo_outcomes(df, "mu0", "mu1").collect()}
    assert found == {0: ("treated", pytest.approx(0.8)), 1: ("control", pytest.approx(0.4))}
    both = df.withColumn("tau1", F.lit(0.2)).withColumn("tau0", F.lit(0.6))
    assert meta.xlearner_combine(both, 0.25).first().tau == pytest.approx(0.3)
    with pytest.raises(ContractError):
        meta.xlearner_combine(both, 1.5)
    with pytest.raises(ContractError):
        meta.require_probabilities(df.withColumn("mu0", F.lit(1.2)), ["mu0"])


def test_exact_quantiles_match_percentile(spark):
    rows = [(g, float(v) if v % 7 else None) for g in ("a", "b") for v in range(1, 60 if g == "a" else 3)] + [("c", None), ("d", 4.0), ("d", 4.0)]
    df = spark.createDataFrame(rows, "g string, value double")
    p = [0.0, 0.01, 0.25, 0.5, 0.95, 1.0]
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("value", F.array(*[F.lit(x) for x in p])).alias("q")).collect()}
    found = {r.g: r.q for r in exact_quantiles(df, p, ["g"]).collect()}
    assert "c" not in found
    for g, q in found.items():
        assert q == pytest.approx(want[g])
    whole = df.agg(F.percentile("value", F.array(*[F.lit(x) for x in p])).alias("q")).first().q
    assert exact_quantiles(df, p).first().q == pytest.approx(whole)
    assert exact_quantiles(df.where("value > 1000"), p).count() == 0


def test_sketches_merge_without_rows(spark):
    df = spark.range(40_000).select((F.col("id") % 7).alias("part"), *[F.when(F.col("id") % 11 > 0, (F.col("id") * (k + 3)) % (500 * (k + 1))).cast("double").alias(f) for k, f in enumerate(FEATURES[:3])])
    df = df.withColumn(FEATURES[3], F.lit(None).cast("double"))
    names = FEATURES[:4]
    early, late = (sketches.sketch_features(df.where(c), ("part",), names) for c in ("part < 3", "part >= 3"))
    merged = sketches.merge_sketches(early.unionByName(late))
    counts = {r.feature: r for r in sketches.sketched_distinct(merged).collect()}
    for f in names:
        values = sorted(r[0] for r in df.select(f).where(F.col(f).isNotNull()).collect())
        assert (counts[f].n, counts[f].missing) == (40_000, 40_000 - len(values))
        assert abs(counts[f].distinct - len(set(values))) <= sketches.DISTINCT_ERROR * len(set(values))
        for r in sketches.sketched_quantiles(merged.where(F.col("feature") == f)).collect():
            if not values:
                assert r.value is None
                continue
            below, upto = (sum(v < r.value for v in values) / len(values), sum(v <= r.value for v in values) / len(values))
            assert below <= r.probability + sketches.RANK_ERROR and upto >= r.probability - sketches.RANK_ERROR
    by_part = sketches.merge_sketches(late, ("part",))
    assert {r.part for r in by_part.collect()} == {3, 4, 5, 6}
    assert sketches.sketched_distinct(sketches.merge_sketches(early.where("false"))).count() == 0
    wrong = sketches.sketched_quantiles(merged.where(F.col("feature") == names[0])).withColumn("value", F.col("value") + 20)
    full = df.select(*names, *[F.lit(None).cast("double").alias(f) for f in FEATURES[4:]])
    assert not any(r.in_bounds for r in sketches.quantiles_in_bounds(full, wrong).where("probability < 0.9").collect())
