"""Uplift ranking metrics: Qini curves, uplift at K, deciles, and response diagnostics.

Rows are ranked by score descending, then row id.  Every operator takes frames with the columns
``score``, treatment, conversion and row id, and optionally ``by`` columns (method, seed, draw), which
are ranked separately in the same pass.  Ranks and running counts come from a distributed prefix sum;
nothing but a few hundred curve points is ever handled in one group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip, ratio
from ..plans.prefix import prefix_sums
from ..plans.store import materialize
from ..roles import CURVE_POINTS, K_GRID, K_LABELS, MIN_ROWS, OUTCOME, ROW_ID, TREATMENT
from .gates import require_rankable


def ate(df: DataFrame, treatment: str = TREATMENT, outcome: str = OUTCOME, by: Sequence[str] = ()) -> DataFrame:
    """Difference in proportions with its unpooled normal interval, and the relative lift."""
    arm = lambda a, fn, c: fn(F.when(F.col(treatment) == a, c))
    y = F.col(outcome)
    base = df.groupBy(*by).agg(arm(1, F.count, y).alias("n1"), arm(0, F.count, y).alias("n0"), arm(1, F.avg, y).alias("p1"), arm(0, F.avg, y).alias("p0"))
    diff = F.col("p1") - F.col("p0")
    se = F.sqrt(ratio(F.col("p1") * (1 - F.col("p1")), F.col("n1")) + ratio(F.col("p0") * (1 - F.col("p0")), F.col("n0")))
    out = base.withColumn("ate", diff).withColumn("se", se)
    return out.select(
        *by, "ate", "se", (F.col("ate") - 1.96 * F.col("se")).alias("ci_95_low"), (F.col("ate") + 1.96 * F.col("se")).alias("ci_95_high"),
        (100 * F.col("ate")).alias("ate_percentage_points"), F.when(F.col("p0") > 0, ratio(F.col("ate"), F.col("p0"))).alias("relative_lift"),
    )


def ranked(scored: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Rank and cumulative arm counts and conversions: ``r, n1, n0, y1, y0`` and their totals.  With
    ``weight`` a row counts that many times (``m`` is then the weighted rank)."""
    w = F.col(weight) if weight else F.lit(1).cast("long")
    t, y = F.col(TREATMENT), F.col(OUTCOME)
    sums = {"m": w, "n1": w * t, "n0": w * (1 - t), "y1": w * t * y, "y0": w * (1 - t) * y}
    slim = scored.select(*by, ROW_ID, "score", TREATMENT, OUTCOME, *([weight] if weight else []))
    return prefix_sums(slim, [F.desc("score"), F.asc(ROW_ID)], sums, by)


def bucket_count(rows: Column) -> Column:
    """So many buckets of the ranking that their counts and the rows near kept positions are about as many."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.sqrt(2 * CURVE_POINTS * rows)))


def ranked_near_points(rows: DataFrame, bucket: Column, order: Sequence[Column], by: Sequence[str]) -> DataFrame:
    """What :func:`ranked` gives, but only for rows that :func:`curve_points` may keep or needs to place them.

    For very many rankings of the same rows.  ``bucket`` must not fall along ``order``, which may leave rows
    with equal treatment and outcome tied.  Rows are counted by bucket first; only those of buckets
    in which a kept position can lie are shuffled and ranked, so that of ``n`` rows a ranking some multiple of
    the root of ``n`` is moved."""
    tagged = rows.withColumn("_bucket", bucket)
    counts = tagged.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_b_{k}") for k, c in _arm_sums().items()])
    return ranked_in_buckets(tagged, buckets_near_points(counts, by), order, by)


def _arm_sums() -> dict[str, Column]:
    t, y = F.col(TREATMENT), F.col(OUTCOME)
    return {"m": F.lit(1).cast("long"), "n1": t, "n0": 1 - t, "y1": t * y, "y0": (1 - t) * y}


def buckets_near_points(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The buckets, some hundreds a ranking, in which a kept position can lie, with what lies before them; ``counts`` has the sums
    ``_b_m, _b_n1, _b_n0, _b_y1, _b_y0`` of each ``_bucket``."""
    sums = _arm_sums()
    whole = Window.partitionBy(*by)
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumns({f"_o_{k}": F.coalesce(F.sum(f"_b_{k}").over(before), F.lit(0)) for k in sums} | {"n": F.sum("_b_m").over(whole)})
    begin, end, n = F.col("_o_m") + 1, F.col("_o_m") + F.col("_b_m"), F.col("n")
    # The first valid prefix ends in the first bucket with a control row, at one of the ranks low to high.
    offsets = offsets.withColumns({f"_{k}": F.min(F.when(F.col("_b_n0") > 0, c)).over(whole) for k, c in (("low", begin), ("high", end))})
    low, high = F.col("_low"), F.col("_high")
    nearest = F.greatest(F.lit(0), F.ceil(ratio((begin - 2 - high) * (CURVE_POINTS - 1), n - high)))  # first position that can be as late as the bucket
    near = low + nearest * (n - low) / (CURVE_POINTS - 1) - 2 <= end
    wanted = (end == n) | (low == begin) | (n - high <= CURVE_POINTS) | near
    return materialize(offsets.where(F.coalesce(wanted, F.lit(False))).select(*by, "_bucket", "n", *[f"_o_{k}" for k in sums]), "points")


def ranked_in_buckets(tagged: DataFrame, points: DataFrame, order: Sequence[Column], by: Sequence[str]) -> DataFrame:
    """Ranks and running counts of the rows in the buckets of ``points``."""
    local = Window.partitionBy(*by, "_bucket").orderBy(*order)
    running = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = tagged.join(points, [*by, "_bucket"]).select(
        *by, "n", (F.row_number().over(local) + F.col("_o_m")).cast("long").alias("r"),
        *[(F.sum(c).over(running) + F.col(f"_o_{k}")).alias(k) for k, c in _arm_sums().items() if k != "m"],
    )
    return materialize(run, "near")


def qini_gain() -> Column:
    return F.col("y1") - F.col("y0") * ratio(F.col("n1"), F.col("n0"))


def curve_points(run: DataFrame, by: Sequence[str] = (), value: Column | None = None, valid: Column | None = None, origin: bool = True, name: str = "qini_gain") -> DataFrame:
    """``coverage`` and value at the kept positions: all valid prefixes if there are at most
    ``CURVE_POINTS``, else evenly spread ones; and the origin.

    Prefixes stay valid once they are, so a position is a rank less the number of invalid ones, and
    whether it is kept follows from its number alone."""
    ok = F.col("n0") > 0 if valid is None else valid
    points = run.where(ok).select(*by, "r", "n", ratio(F.col("r"), F.col("n")).alias("coverage"), (qini_gain() if value is None else value).alias(name))
    least = points.groupBy(*by).agg(F.min("r").alias("_r0"))
    points = points.join(F.broadcast(least), list(by)) if by else points.crossJoin(F.broadcast(least))  # a row for each ranking
    j, last = F.col("r") - F.col("_r0"), (F.col("n") - F.col("_r0")).cast("double")
    step = last / float(CURVE_POINTS - 1)
    guess = F.floor(j / step)
    hit = F.lit(False)
    for d in (-1, 0, 1):
        i = guess + d
        hit = hit | (i.between(0, CURVE_POINTS - 1) & (F.rint(i * step) == j))
    kept = points.where(F.when(last < CURVE_POINTS, True).otherwise(hit)).select(*by, "coverage", name)
    if not origin:
        return kept
    start = run.select(*by).distinct() if by else run.sparkSession.range(1).select()
    return kept.unionByName(start.select(*by, F.lit(0.0).alias("coverage"), F.lit(0.0).alias(name)))


def qini_curve(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return curve_points(ranked(scored, by), by)


def qini_summary(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the kept points, the random line's, and the difference: the primary statistic."""
    return summarize_curve(qini_curve(scored, by), by)


def summarize_curve(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("coverage")  # a few hundred points each
    steps = curve.withColumn("_c", F.lag("coverage").over(order)).withColumn("_q", F.lag("qini_gain").over(order))
    area = F.sum(0.5 * (F.col("qini_gain") + F.col("_q")) * (F.col("coverage") - F.col("_c")))
    full = F.max_by("qini_gain", "coverage")
    out = steps.groupBy(*by).agg(F.count("*").alias("points"), area.alias("qini_area"), (full / 2).alias("theoretical_random"))
    return out.withColumn("qini_above_random", F.col("qini_area") - F.col("theoretical_random"))


def uplift_at_k(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _at_k(ranked(scored, by), by)


def _at_k(run: DataFrame, by: Sequence[str]) -> DataFrame:
    """Uplift of the first ``m`` rows for each K; NULL and a reason where an arm is absent."""
    m = lambda k: F.least(F.col("n"), F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(k) * F.col("n"))))
    ks = F.array(*[F.struct(F.lit(label).alias("k"), m(k).alias("at")) for k, label in zip(K_GRID, K_LABELS, strict=True)])
    rows = run.withColumn("_ks", F.filter(ks, lambda x: x["at"] == F.col("r"))).where(F.size("_ks") > 0).withColumn("_x", F.explode("_ks"))
    value = ratio(F.col("y1"), F.col("n1")) - ratio(F.col("y0"), F.col("n0"))
    supported = (F.col("n1") > 0) & (F.col("n0") > 0)
    return rows.select(
        *by, F.col("_x.k").alias("k"), F.col("r").alias("m"), F.when(supported, value).alias("uplift"), F.when(supported, F.col("r") * value).alias("incremental_conversions"),
        F.when(supported, "OK").otherwise("UNSUPPORTED_METRIC").alias("status"),
    )


def decile_uplift(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ten groups by rank; stops if there are fewer than ten rows."""
    return _deciles(ranked(require_rankable(scored, least_rows=MIN_ROWS, by=by), by), by)


def _deciles(run: DataFrame, by: Sequence[str]) -> DataFrame:
    t, y = F.col(TREATMENT), F.col(OUTCOME)
    decile = (1 + F.expr("((r - 1) * 10) div n")).cast("int")
    sums = run.groupBy(*by, decile.alias("decile")).agg(
        F.count("*").alias("n"), F.sum(t).alias("n1"), F.sum(1 - t).alias("n0"), F.sum(t * y).alias("y1"), F.sum((1 - t) * y).alias("y0")
    )
    both = (F.col("n1") > 0) & (F.col("n0") > 0)
    treated, control = F.when(both, ratio(F.col("y1"), F.col("n1"))), F.when(both, ratio(F.col("y0"), F.col("n0")))
    out = sums.withColumn("treated_rate", treated).withColumn("control_rate", control).withColumn("observed_uplift", F.col("treated_rate") - F.col("control_rate"))
    return out.withColumn("incremental_conversions", F.col("n") * F.col("observed_uplift")).withColumn("low_control_conversion_warning", F.col("y0") < 5)


def cumulative_by_decile(deciles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Running uplift rate over the ten deciles."""
    w = Window.partitionBy(*by).orderBy("decile").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = {c: F.sum(c).over(w) for c in ("n1", "n0", "y1", "y0")}
    return deciles.select(*by, "decile", (ratio(s["y1"], s["n1"]) - ratio(s["y0"], s["n0"])).alias("cumulative_uplift_rate"))


def cumulative_rate_curve(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Running uplift rate at the kept positions of prefixes that hold both arms; without origin."""
    value = ratio(F.col("y1"), F.col("n1")) - ratio(F.col("y0"), F.col("n0"))
    return curve_points(ranked(scored, by), by, value, (F.col("n0") > 0) & (F.col("n1") > 0), False, "uplift_rate")


def evaluate_ranking(scored: DataFrame, by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """All ranking metrics of one ranking pass: ``curve, summary, top_k, deciles, cumulative``.  Stops on
    frames that cannot be ranked (:func:`gates.require_rankable`)."""
    run = ranked(require_rankable(scored, least_rows=MIN_ROWS, by=by), by)
    curve, deciles = curve_points(run, by), _deciles(run, by)
    return {"curve": curve, "summary": summarize_curve(curve, by), "top_k": _at_k(run, by), "deciles": deciles, "cumulative": cumulative_by_decile(deciles, by)}


def average_ranks(df: DataFrame, column: str, key: str = ROW_ID) -> DataFrame:
    """Rank by a column, descending, ties sharing their mean rank: values are counted first."""
    counts = df.groupBy(column).agg(F.count("*").alias("_c"))
    run = prefix_sums(counts, [F.desc_nulls_last(column)], {"_upto": F.col("_c")}, totals=False)
    mean = run.select(F.col(column).alias("_value"), (F.col("_upto") - (F.col("_c") - 1) / 2).alias("rank"))
    return df.select(key, column).join(mean, F.col(column).eqNullSafe(F.col("_value"))).select(key, column, "rank")


def response_diagnostics(scored: DataFrame, probability: str = "score") -> DataFrame:
    """ROC-AUC with ties as half, average precision by steps, and log loss.  Not a causal metric."""
    counts = scored.groupBy(probability).agg(F.sum(OUTCOME).alias("p"), F.sum(1 - F.col(OUTCOME)).alias("q"))
    run = prefix_sums(counts, [F.desc(probability)], {"cp": F.col("p"), "cq": F.col("q")})
    s = clip(F.col(probability), 1e-15, 1 - 1e-15)
    loss = -(F.col("p") * F.ln(s) + F.col("q") * F.ln(1 - s))
    pairs = F.col("q") * (F.col("cp") - F.col("p")) + 0.5 * F.col("p") * F.col("q")
    precision = F.col("p") * ratio(F.col("cp"), F.col("cp") + F.col("cq"))
    total_p, total_q = F.max("total_cp"), F.max("total_cq")
    return run.agg(
        ratio(F.sum(pairs), total_p * total_q).alias("roc_auc"), ratio(F.sum(precision), total_p).alias("average_precision"), ratio(F.sum(loss), total_p + total_q).alias("log_loss")
    )
