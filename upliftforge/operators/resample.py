"""Random references, bootstrap and calibration of statistics against a null distribution."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from ..functions.digest import WORD, counted_bits, tailed_bits
from ..functions.scalar import hash_uniform, ratio
from ..plans.prefix import prefix_sums
from ..plans.store import materialize
from ..roles import BOOTSTRAP_DRAWS, CURVE_POINTS, OUTCOME, RANDOM_DRAWS, ROW_ID, SEED, TREATMENT, ContractError
from .ranking import bucket_count, buckets_near_points, curve_points, ranked_in_buckets, summarize_curve


def random_scores(df: DataFrame, seed: int = SEED) -> DataFrame:
    return df.withColumn("score", hash_uniform(F.lit("random"), F.lit(str(seed)), F.col(ROW_ID)))


def random_reference(df: DataFrame, draws: int = RANDOM_DRAWS, seed: int = SEED) -> DataFrame:
    """Qini summary of ``draws`` random rankings; the theoretical line is the same in all.

    Scores are uniform, so cutting their range gives even buckets without sampling or a sort.  Tasks hash their rows for all draws and
    add them up by draw and bucket; only rows of buckets near kept positions leave a task."""
    slim = df.select(ROW_ID, F.coalesce(F.concat(F.lit("|"), F.col(ROW_ID).cast("string")), F.lit("")).alias("tail"), TREATMENT, OUTCOME)
    rows = materialize(_spread(slim), "rows")
    n = rows.count()
    buckets = max(1, min(math.isqrt(2 * CURVE_POINTS * n), DRAW_CELLS // max(draws, 1)))
    prefixes = [f"draw|{seed}|{d}" for d in range(draws)]
    # By number: a task sends its sums whole, so there are no more tasks than the picks or the cores need.
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, n * draws // TASK_PICKS)
    dealt = rows.repartition(tasks)
    points = buckets_near_points(_random_counts(dealt, prefixes, buckets), ["draw"])
    wanted = np.zeros((draws, buckets + 1), bool)
    for r in points.select("draw", "_bucket").collect():  # some hundreds of buckets for each draw
        wanted[r["draw"], r["_bucket"]] = True
    run = ranked_in_buckets(_random_picked(dealt, prefixes, buckets, wanted), points, [F.desc("score"), F.asc(ROW_ID)], ["draw"])
    return summarize_curve(curve_points(run, ["draw"]), ["draw"]).drop("points")


#: Draws times buckets that a task counts random rankings by, at most, and rows that it hashes at once.
DRAW_CELLS, DRAWN_ROWS = 1 << 21, 1 << 16
RANDOM_SUMS = ("_b_m", "_b_n1", "_b_n0", "_b_y1", "_b_y0")


def _random_buckets(batches, prefixes: Sequence[str], buckets: int):
    """Rows of a task, some at a time, with an iterator over the draws that gives their scores and buckets."""

    def scores(tails):
        for bits in tailed_bits(prefixes, tails):
            score = bits / float(1 << WORD)
            yield score, np.floor((1 - score) * buckets).astype(np.int64)

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= DRAWN_ROWS:
            table = pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
            yield table, scores(table["tail"].to_pylist())
    if size:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, scores(table["tail"].to_pylist())


def _random_counts(rows: DataFrame, prefixes: Sequence[str], buckets: int) -> DataFrame:
    """``draw, _bucket`` and the sums of :func:`buckets_near_points`.  A task sends a row of numbers for each draw."""
    draws, width = len(prefixes), len(RANDOM_SUMS)

    def run(batches):
        sums = np.zeros((draws, width, buckets + 1), np.int64)
        for table, scores in _random_buckets(batches, prefixes, buckets):
            t, y = (_known(table[c]) for c in (TREATMENT, OUTCOME))
            each = [t[0], np.where(t[1], 1 - t[0], 0), t[0] * y[0], np.where(t[1], 1 - t[0], 0) * y[0]]
            some = [(k, np.nonzero(v)[0], v) for k, v in enumerate(each, 1)]
            for own, (_, bucket) in zip(sums, scores, strict=True):
                own[0] += np.bincount(bucket, minlength=buckets + 1)
                for k, at, v in some:
                    np.add.at(own[k], bucket[at], v[at])
        for draw, own in enumerate(sums):
            if own[0].any():
                yield pa.RecordBatch.from_arrays([pa.array([draw], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["draw", "cells"])

    def whole(t: pa.Table) -> pa.Table:
        found = sum(np.frombuffer(c.as_buffer(), np.int64) for c in t["cells"]).reshape(width, -1)
        some = np.nonzero(found[0])[0]
        draw = np.full(len(some), t["draw"][0].as_py(), np.int32)
        return pa.table([pa.array(v) for v in (draw, some, *found[:, some])], names=["draw", "_bucket", *RANDOM_SUMS])

    sent = rows.mapInArrow(run, "draw int, cells binary")
    return sent.groupBy("draw").applyInArrow(whole, "draw int, _bucket long, " + ", ".join(f"{c} long" for c in RANDOM_SUMS))


def _known(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers with 0 where they are missing, and where they are not."""
    return column.fill_null(0).to_numpy().astype(np.int64), column.is_valid().to_numpy()


def _random_picked(rows: DataFrame, prefixes: Sequence[str], buckets: int, wanted: np.ndarray) -> DataFrame:
    """``draw, _bucket, score`` and the rows of the wanted buckets."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)  # a bit for each draw and bucket
    kept = [ROW_ID, TREATMENT, OUTCOME]

    def run(batches):
        for table, scores in _random_buckets(batches, prefixes, buckets):
            slim = table.select(kept)
            for draw, (score, bucket) in enumerate(scores):
                at = np.nonzero(shared.value[draw, bucket])[0]
                head = [pa.array(np.full(len(at), draw, np.int32)), pa.array(bucket[at]), pa.array(score[at])]
                own = slim.take(pa.array(at)).combine_chunks()
                yield pa.RecordBatch.from_arrays([*head, *[pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in own.columns]], names=["draw", "_bucket", "score", *kept])

    head = [StructField("draw", IntegerType()), StructField("_bucket", LongType()), StructField("score", DoubleType())]
    return rows.mapInArrow(run, StructType([*head, *[rows.schema[c] for c in kept]]))


def _spread(df: DataFrame) -> DataFrame:
    """Rows over all tasks, because each is about to be repeated for every draw."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: An arm's unit interval is halved until about so many picks fall in a part.
PART_PICKS = 128
TASK_PICKS = 1 << 26
#: Buckets of a ranking that tasks count picks by, at most: counts of a draw are some 130 KB.
COUNTED = 1 << 12
CELLS = 4  # rows and outcomes of both arms


def part_levels(n: int) -> int:
    return max(0, math.ceil(math.log2(n / PART_PICKS))) if n else 0


def _halved(n: int, levels: int, key: str) -> np.ndarray:
    """How many of ``n`` picks fall in each part: heads among ``c`` fair coins, the ones among as many bits of hashes, go left."""
    c = np.array([n], np.int64)
    for level in range(levels):
        words = np.maximum(c - 1, 0) // WORD + 1
        bits = counted_bits([f"{key}|{level}|{part}|" for part in range(len(c))], words)
        ends = words.cumsum()
        unused = np.zeros(len(bits), np.uint64)
        unused[ends - 1] = WORD - (c - WORD * (words - 1))
        left = np.add.reduceat(np.bitwise_count(bits >> unused).astype(np.int64), ends - words)
        c = np.stack([left, c - left], 1).reshape(-1)
    return c


def part_counts(spark, arms: Mapping[int, int], draws: int = BOOTSTRAP_DRAWS, seed: int = SEED) -> tuple[DataFrame, int]:
    """``draw, treatment, part, c``: how many of an arm's ``n`` uniform picks fall in each of ``2**levels`` equal parts of the unit
    interval, and the number of levels.  The picks of an interval go to its halves as fair coins do, so counts are
    exactly multinomial and add up to ``n``; a draw's are made from its number, without a shuffle."""
    levels = part_levels(max(arms.values(), default=0))
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        for batch in batches:
            for draw in batch.column("draw").to_pylist():
                for t, n in sorted(arms.items()):
                    c = _halved(n, levels, f"split|{seed}|{draw}|{t}")
                    part = np.nonzero(c)[0]
                    same = lambda v: pa.array(np.full(len(part), v, np.int32))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([same(draw), same(t), pa.array(part), pa.array(c[part])], names=["draw", TREATMENT, "part", "c"])

    out = spark.range(0, draws, 1, min(tasks, max(draws, 1))).select(F.col("id").cast("int").alias("draw"))
    return out.mapInArrow(run, f"draw int, {TREATMENT} int, part long, c long"), levels


def _made(batch: pa.RecordBatch, size: int, seed: int):
    """For each part of a batch: its number, its arm, and the draw and the row (among the batch's rows) of each pick."""
    arms, parts, ns = (batch.column(c).to_pylist() for c in (TREATMENT, "part", "n"))
    drawn, ends, starts = batch.column("drawn"), batch.column("drawn").offsets.to_numpy(), batch.column("rows").offsets.to_numpy()
    draw, c = (drawn.values.field(k).to_numpy() for k in ("draw", "c"))
    for i, (t, part, n) in enumerate(zip(arms, parts, ns, strict=True)):
        own, many = draw[ends[i] : ends[i + 1]], c[ends[i] : ends[i + 1]]
        u = counted_bits([f"boot|{seed}|{d}|{t}|{part}|" for d in own.tolist()], many, 1) / float(1 << WORD)
        at = np.minimum(np.floor((part + u) / float(size) * n).astype(np.int64), ((part + 1) * n - 1) // size)
        yield i, t, np.repeat(own, many), at - part * n // size + starts[i]


class _Picks:
    """Picks of ``rows`` (``by``, arm, place ``r`` from 1 of ``n``, ``values``) for all draws.

    The rows of a part, some hundred, are gathered once, and the counts of the draws come to them.  What is
    written are these rows and counts; tasks make the picks where both are, and send sums or picks that are asked for."""

    def __init__(self, rows: DataFrame, by: Sequence[str], values: Sequence[str], draws: int, seed: int):
        self.by, self.draws, self.seed = list(by), draws, seed
        arms = {r[TREATMENT]: r["n"] for r in rows.groupBy(TREATMENT).agg(F.max("n").alias("n")).collect()}  # two rows
        counts, levels = part_counts(rows.sparkSession, arms, draws, seed)
        self.size, place = 1 << levels, F.col("r") - 1
        first, last = (F.call_function("div", x, F.col("n")) for x in (place * self.size, (place + 1) * self.size - 1))  # a row may reach into two parts
        spread = rows.select(*by, TREATMENT, "n", place.alias("place"), F.explode(F.sequence(first, last)).alias("part"), *values)
        parts = spread.groupBy(*by, TREATMENT, "n", "part").agg(F.sort_array(F.collect_list(F.struct("place", *values))).alias("rows"))
        key = [TREATMENT, "part"]
        drawn = counts.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("draw", "c"))).alias("drawn"))  # a count for each draw
        # By number, so that small inputs are not dealt to few tasks: each row is about to become so many picks.
        self.tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), draws * sum(arms.values()) // TASK_PICKS)
        self.parts = materialize(drawn.repartition(self.tasks, *key).join(parts.repartition(self.tasks, *key), key), "parts")
        self.schema = rows.schema

    def picked(self, values: Sequence[str], wanted: Mapping[tuple, np.ndarray] | None = None) -> DataFrame:
        """``draw``, the arm, ``by`` and ``values`` of every pick, or of those whose ``_bucket`` is ``wanted`` in their draw."""
        by, made = self.by, partial(_made, size=self.size, seed=self.seed)
        shared = None if wanted is None else self.parts.sparkSession.sparkContext.broadcast(wanted)  # a bit for each draw and bucket

        def run(batches):
            for batch in batches:
                rows, keys = batch.column("rows").values, [batch.column(b) for b in by]
                for i, t, draw, at in made(batch):
                    if shared is not None:
                        found = shared.value.get(tuple(k[i].as_py() for k in keys))
                        some = np.zeros(len(at), bool) if found is None else found[draw, rows.field("_bucket").to_numpy()[at]]
                        draw, at = draw[some], at[some]
                    same = pa.array(np.full(len(at), i))
                    columns = [pa.array(draw.astype(np.int32)), pa.array(np.full(len(at), t, np.int32)), *[k.take(same) for k in keys]]
                    yield pa.RecordBatch.from_arrays([*columns, *[rows.field(v).take(pa.array(at)) for v in values]], names=["draw", TREATMENT, *by, *values])

        head = [StructField(c, IntegerType()) for c in ("draw", TREATMENT)]
        return self.parts.mapInArrow(run, StructType([*head, *[self.schema[c] for c in (*by, *values)]]))

    def counts(self, buckets: int) -> DataFrame:
        """``by, draw, _bucket`` and how many picks and outcomes of the arms are in it.  A task adds up all its parts and sends one
        row of numbers for each draw."""
        by, draws, made = self.by, self.draws, partial(_made, size=self.size, seed=self.seed)

        def run(batches):
            sums = {}
            for batch in batches:
                rows, keys = batch.column("rows").values, [batch.column(b) for b in by]
                bucket, y = rows.field("_bucket").to_numpy(), np.nan_to_num(rows.field(OUTCOME).to_numpy(zero_copy_only=False)).astype(np.int64)
                for i, t, draw, at in made(batch):
                    key = tuple(k[i : i + 1] for k in keys)
                    _, cells = sums.setdefault(tuple(k[0].as_py() for k in key), (key, np.zeros(draws * buckets * CELLS, np.int64)))
                    cell = (draw.astype(np.int64) * buckets + bucket[at]) * CELLS + t
                    np.add.at(cells, cell, 1)
                    some = np.nonzero(y[at])[0]
                    np.add.at(cells, cell[some] + 2, y[at[some]])
            for key, cells in sums.values():
                for draw, own in enumerate(cells.reshape(draws, -1)):
                    yield pa.RecordBatch.from_arrays([*key, pa.array([draw], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=[*by, "draw", "cells"])

        def whole(t: pa.Table) -> pa.Table:
            n0, n1, y0, y1 = sum(np.frombuffer(c.as_buffer(), np.int64) for c in t["cells"]).reshape(-1, CELLS).T
            some = np.nonzero(n0 + n1)[0]
            columns = [t[c].combine_chunks().take(pa.array(np.zeros(len(some), np.int64))) for c in (*by, "draw")]
            return pa.table([*columns, *[pa.array(v) for v in (some, *(s[some] for s in (n0 + n1, n1, n0, y1, y0)))]], names=[*by, "draw", *names])

        names = ["_bucket", "_b_m", "_b_n1", "_b_n0", "_b_y1", "_b_y0"]
        head = [*[self.schema[b] for b in by], StructField("draw", IntegerType())]
        sent = self.parts.mapInArrow(run, StructType([*head, StructField("cells", BinaryType())]))
        return sent.groupBy(*by, "draw").applyInArrow(whole, StructType([*head, *[StructField(k, LongType()) for k in names]]))


def _placed(df: DataFrame) -> DataFrame:
    """Each row's place ``r`` of ``n`` in its arm."""
    return prefix_sums(df.select(ROW_ID, TREATMENT), [F.asc(ROW_ID)], {}, [TREATMENT])


def bootstrap_weights(df: DataFrame, draws: int = BOOTSTRAP_DRAWS, seed: int = SEED) -> DataFrame:
    """``draw, id, w``: exact multinomial resampling within arms; rows that are not drawn are left out.

    Each arm of ``n`` rows gives ``n`` picks; the same weights serve all methods."""
    return _Picks(_placed(df), [], [ROW_ID], draws, seed).picked([ROW_ID]).groupBy("draw", ROW_ID).agg(F.count("*").alias("w"))


def bootstrap_qini(scored: DataFrame, draws: int = BOOTSTRAP_DRAWS, seed: int = SEED, methods: Sequence[str] = ()) -> DataFrame:
    """Qini summary for each draw (and method).  A row drawn ``w`` times stands ``w`` times in a row.

    Rows are ranked by score once; a draw's ranking is that of its picks by their rows' ranks."""
    placed = _placed(scored.select(ROW_ID, TREATMENT).distinct() if methods else scored)
    once = prefix_sums(scored.select(*methods, ROW_ID, "score", OUTCOME), [F.desc("score"), F.asc(ROW_ID)], {}, methods)
    buckets = F.least(bucket_count(F.col("n")), F.lit(COUNTED).cast("long"))
    bucket = F.floor((F.col("r") - 1) * buckets / F.col("n"))
    rows = once.select(*methods, ROW_ID, OUTCOME, F.col("r").alias("_rank"), bucket.alias("_bucket"))
    rows = materialize(placed.join(rows, ROW_ID).drop(ROW_ID), "placed")
    by, values = ["draw", *methods], [OUTCOME, "_rank", "_bucket"]
    picks = _Picks(rows, methods, values, draws, seed)
    most = (rows.agg(F.max("_bucket")).first()[0] or 0) + 1  # one number
    points = buckets_near_points(picks.counts(most), by)
    wanted = {}
    for r in points.select(*by, "_bucket").collect():  # some hundreds of buckets for each draw
        wanted.setdefault(tuple(r[m] for m in methods), np.zeros((draws, most), bool))[r["draw"], r["_bucket"]] = True
    run = ranked_in_buckets(picks.picked(values, wanted), points, [F.asc("_rank")], by)
    return summarize_curve(curve_points(run, by), by).drop("points")


def percentile_interval(draws: DataFrame, value: str = "qini_above_random", least_finite: float = 0.95, expected: int = BOOTSTRAP_DRAWS) -> DataFrame:
    """2.5 and 97.5 percentiles of the finite draws; NULL if too few are finite."""
    finite = F.col(value).isNotNull() & ~F.isnan(value)
    out = draws.agg(F.count_if(finite).alias("finite"), F.percentile(F.when(finite, F.col(value)), F.array(F.lit(0.025), F.lit(0.975))).alias("_p"))
    enough = F.col("finite") >= least_finite * expected
    return out.select("finite", F.when(enough, F.col("_p")[0]).alias("low"), F.when(enough, F.col("_p")[1]).alias("high"))


# Calibration against a null distribution


def null_order_statistic(null: DataFrame, probabilities: Sequence[float] = (0.95, 0.99), value: str = "value") -> DataFrame:
    """The order statistic of rank ``ceil(B p)``, without interpolation, and how values lie around it."""
    run = prefix_sums(null.select(F.col(value).alias("value"), F.monotonically_increasing_id().alias("_k")), [F.asc("value"), F.asc("_k")], {})
    ps = F.array(*[F.struct(F.lit(p).alias("probability"), F.ceil(F.col("n") * F.lit(p)).alias("rank")) for p in probabilities])
    picked = run.withColumn("_p", F.explode(F.filter(ps, lambda x: x["rank"] == F.col("r")))).select("_p.probability", "_p.rank", F.col("value").alias("threshold"), F.col("n").alias("replications"))
    counted = null.select(F.col(value).alias("v")).crossJoin(F.broadcast(picked))  # a row for each probability
    around = counted.groupBy("probability", "rank", "threshold", "replications").agg(
        F.count_if(F.col("v") < F.col("threshold")).alias("below"), F.count_if(F.col("v") == F.col("threshold")).alias("equal"), F.count_if(F.col("v") > F.col("threshold")).alias("above")
    )
    return around


def binomial_ranks(replications: int, probability: float, confidence: float = 0.95) -> dict:
    """Ranks between which the quantile lies with the given confidence, from the exact binomial law.
    ``lgamma`` is no SQL function; this is arithmetic over a few thousand numbers."""
    if replications <= 0 or not 0 < probability < 1 or not 0 < confidence < 1:
        raise ContractError("invalid arguments of a binomial interval")
    logs = [
        math.lgamma(replications + 1) - math.lgamma(k + 1) - math.lgamma(replications - k + 1) + k * math.log(probability) + (replications - k) * math.log1p(-probability)
        for k in range(replications + 1)
    ]
    top = max(logs)
    mass = [math.exp(v - top) for v in logs]
    whole, half = math.fsum(mass), (1 - confidence) / 2
    low, below = 0, 0.0
    for k in range(replications):
        below += mass[k] / whole
        if below > half:
            break
        low = k + 1
    high, above = replications + 1, 0.0
    for k in range(replications, 0, -1):
        above += mass[k] / whole
        if above > half:
            break
        high = k
    return {"lower_rank": max(low, 1), "upper_rank": min(high, replications), "lower_clipped": low < 1, "upper_clipped": high > replications}


def order_statistic_interval(null: DataFrame, probability: float, confidence: float = 0.95, value: str = "value") -> DataFrame:
    """Values at the binomial ranks around the order statistic."""
    ranks = binomial_ranks(null.count(), probability, confidence)
    run = prefix_sums(null.select(F.col(value).alias("value"), F.monotonically_increasing_id().alias("_k")), [F.asc("value"), F.asc("_k")], {})
    at = lambda k: F.max(F.when(F.col("r") == ranks[k], F.col("value")))
    return run.agg(
        F.lit(probability).alias("probability"), F.count("*").alias("replications"), F.lit(ranks["lower_rank"]).cast("long").alias("lower_rank"), F.lit(ranks["upper_rank"]).cast("long").alias("upper_rank"),
        at("lower_rank").alias("lower_value"), at("upper_rank").alias("upper_value"), F.lit(ranks["lower_clipped"]).alias("lower_clipped"), F.lit(ranks["upper_clipped"]).alias("upper_clipped"),
    )


#: Status and action by the band that a statistic falls in.
ACTIONS = (("INFO", "PASS"), ("WARNING", "WARNING"), ("MATERIAL_CONCERN", "ROBUSTNESS_REQUIRED"))


def action_band(observed: float, p95: float, p99: float) -> int:
    if not all(map(math.isfinite, (observed, p95, p99))) or p95 > p99:
        raise ContractError("thresholds must be finite and in order")
    return (observed > p95) + (observed > p99)


def diagnostic_actions(df: DataFrame, observed: str = "observed", p95: str = "p95", p99: str = "p99") -> DataFrame:
    band = F.when(F.col(observed) <= F.col(p95), 0).when(F.col(observed) <= F.col(p99), 1).otherwise(2)
    pick = lambda k: F.element_at(F.array(*[F.lit(a[k]) for a in ACTIONS]), band + 1)
    return df.withColumn("evidence_status", pick(0)).withColumn("required_action", pick(1))


def action_stability(observed: float, points: tuple[float, float], p95: Mapping, p99: Mapping, replications: int, step: int = 2000) -> dict:
    """Whether the thresholds' uncertainty can change the action; if so, how many replications next."""
    band = action_band(observed, *points)
    clipped = any(i[k] for i in (p95, p99) for k in ("lower_clipped", "upper_clipped"))
    corners = [(a, b) for a in (p95["lower_value"], p95["upper_value"]) for b in (p99["lower_value"], p99["upper_value"])]
    crossed = any(a > b for a, b in corners)
    changed = any(action_band(observed, a, b) != band for a, b in corners if a <= b)
    stable = not (clipped or crossed or changed)
    return {"stable": stable, "action": ACTIONS[band], "clipped": clipped, "crossed": crossed, "changed": changed, "next_replications": None if stable else replications + step}


def tail_fraction(null: DataFrame, observed: float, value: str = "value") -> DataFrame:
    """Share of the null distribution at or beyond the observed value; not a p-value."""
    beyond = F.count_if(F.col(value) >= F.lit(observed))
    return null.agg(beyond.alias("at_least_observed"), F.count("*").alias("replications"), ratio(beyond, F.count("*")).alias("tail_fraction"))


#: What a record of each class may say.
STATUSES = {"HARD_GATE": ("PASS", "FAIL"), "EMPIRICAL_DIAGNOSTIC": ("INFO", "WARNING", "MATERIAL_CONCERN")}
REQUIRED_ACTIONS = ("PASS", "WARNING", "ROBUSTNESS_REQUIRED", "STOP")


def evidence_violations(records: DataFrame) -> DataFrame:
    """Records whose class, status or action is outside the vocabulary, or that say something though
    they were deferred."""
    deferred = F.col("execution_state") != "EXECUTED"
    spoken = F.col("evidence_status").isNotNull() | F.col("required_action").isNotNull()
    allowed = F.lit(False)
    for kind, statuses in STATUSES.items():
        allowed = allowed | ((F.col("evidence_class") == kind) & F.col("evidence_status").isin(*statuses))
    sound = F.coalesce(allowed & F.col("required_action").isin(*REQUIRED_ACTIONS), F.lit(False))
    return records.where(F.when(deferred, spoken).otherwise(~sound))
