"""Named queries over the population view, each with the same query in DuckDB's SQL where SQL can
express it.  Floating results are rounded in both, so that values compare exactly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import balance, forest, gates, joins, learners, meta, profile, ranking, resample, sketches, split
from ..roles import FEATURES, LABELS, OUTCOME, QUANTILES, ROW_ID, TREATMENT
from ..sources import digests, files, ingest
from ..sources.population import POPULATION_SQL, population
from ..streaming import counts
from .store import materialize, new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

COARSE = ("f2", "f9", "f10", "f11")
POP = f"pop as ({POPULATION_SQL})"
LONG = "long as (" + " union all ".join(f"select _source_row_id, treatment, conversion, '{f}' as feature, {f} as value from pop" for f in FEATURES) + ")"

#: Random order of each stratum and the splits cut from it.
STRATA_SQL = """ranked as (
  select *, row_number() over (partition by treatment, conversion order by md5('split|42|' || _source_row_id), _source_row_id) as sr,
    count(*) over (partition by treatment, conversion) as sn from pop
), parts as (
  select *, case when sr <= floor(0.7::double * sn + 0.5) then 'train' when sr <= floor(0.85::double * sn + 0.5) then 'validation' else 'held_out' end as split from ranked
)"""


def prefix_sql(source: str, score: str, by: str = "") -> str:
    """Ranks and running counts in SQL."""
    part = f"partition by {by}" if by else ""
    w = f"over ({part} order by {score} desc, _source_row_id rows unbounded preceding)"
    key = f"{by}, " if by else ""
    return f"""run as (
  select {key} _source_row_id, treatment, conversion, row_number() over ({part} order by {score} desc, _source_row_id) as r, count(*) over ({part}) as n,
    sum(treatment) {w} as n1, sum(1 - treatment) {w} as n0, sum(treatment * conversion) {w} as y1, sum((1 - treatment) * conversion) {w} as y0
  from {source}
)"""


def curve_sql(by: str = "", value: str = "y1 - y0 * (n1::double / n0)", valid: str = "n0 > 0", origin: bool = True, name: str = "qini_gain") -> str:
    """Kept curve points in SQL, from ``run``."""
    key, part = (f"{by}, ", f"partition by {by}") if by else ("", "")
    join = f"v.{by} = p.{by} and " if by else ""
    top = f"""union all select distinct {key} 0.0::double, 0.0::double from run""" if origin else ""
    return f"""valid as (
  select {key} r::double / n as coverage, {value} as {name}, row_number() over ({part} order by r) - 1 as j, count(*) over ({part}) as l from run where {valid}
), positions as (
  select distinct {key} cast(case when l <= 151 then i else round_even(i * ((l - 1) / 150.0::double), 0) end as bigint) as j
  from (select distinct {key} l from valid), (select unnest(range(0, 151)) as i) where i < l
), curve as (
  select {'v.' + by + ',' if by else ''} coverage, {name} from valid v join positions p on {join} v.j = p.j {top}
)"""


SUMMARY_SQL = """area as (
  select {key} coverage, qini_gain, lag(coverage) over ({part} order by coverage) as c0, lag(qini_gain) over ({part} order by coverage) as q0 from curve
), summary as (
  select {key} count(*) as points, sum(0.5 * (qini_gain + q0) * (coverage - c0)) as qini_area, max_by(qini_gain, coverage) / 2 as theoretical_random from area {group}
)"""


def summary_sql(by: str = "") -> str:
    return SUMMARY_SQL.format(key=f"{by}, " if by else "", part=f"partition by {by}" if by else "", group=f"group by {by}" if by else "")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def with_pop(body: str, *ctes: str) -> str:
    return ("with recursive " if any("union all" in c for c in ctes) else "with ") + ", ".join([POP, *ctes]) + " " + body


def r(name: str, digits: int = 9):
    return F.round(F.col(name), digits).alias(name)


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[r(c, digits) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


SLIM = (ROW_ID, "f0", *LABELS)


def slim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, labels and the one feature that stands in for a score: no join is needed for these."""
    return population(spark, sf_dir, SLIM)


def scored_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slim(spark, sf_dir).withColumn("score", F.col("f0"))


def wide_sql(columns, template: str) -> str:
    return " union all ".join(template.format(c=c) for c in columns)


# Population, gates, counts

query("population", with_pop("select * from pop"))(population)


@query(
    "population_gates",
    with_pop(
        """select audit_id, 'HARD_GATE' as evidence_class, cast(observed as bigint) as observed, case when ok then 'PASS' else 'FAIL' end as evidence_status, case when ok then 'PASS' else 'STOP' end as required_action from hard
union all select 'ED-01-' || feature, 'EMPIRICAL_DIAGNOSTIC', count(*) - count(value), 'INFO', 'PASS' from long group by feature""",
        LONG,
        """s as (select count(*) as rows,
  count(*) filter (where treatment is null or treatment not in (0, 1)) + count(*) filter (where conversion is null or conversion not in (0, 1)) + count(*) filter (where visit is null or visit not in (0, 1)) as bad,
  count(*) - count(distinct _source_row_id) as ids, least(count(*) filter (where treatment = 0), count(*) filter (where treatment = 1)) as arm from pop)""",
        """hard as (select 'HG-02' as audit_id, rows as observed, rows > 0 as ok from s union all select 'HG-03', 12, true union all select 'HG-04', bad, bad = 0 from s
  union all select 'HG-05', 0, true union all select 'HG-06', arm, arm > 0 from s union all select 'HG-07', ids, ids = 0 from s)""",
    ),
)
def population_gates(spark, sf_dir):
    return gates.pre_split_gates(population(spark, sf_dir))


@query("missing_counts", with_pop(wide_sql((*FEATURES, *LABELS, ROW_ID), "select '{c}' as feature, count(*) - count({c}) as missing from pop")))
def missing_counts(spark, sf_dir):
    return gates.missing_counts(population(spark, sf_dir), (*FEATURES, *LABELS, ROW_ID))


@query(
    "quality_counts",
    with_pop(
        wide_sql(FEATURES, "select '{c}' as feature, count(*) - count({c}) as missing, count(*) filter (where isnan({c})) as nan, count(*) filter (where isinf({c})) as infinite, 0::bigint as invalid_binary from pop")
        + " union all "
        + wide_sql(LABELS, "select '{c}', count(*) - count({c}), 0::bigint, 0::bigint, count(*) filter (where {c} not in (0, 1)) from pop")
    ),
)
def quality_counts(spark, sf_dir):
    return gates.quality_counts(population(spark, sf_dir))


@query(
    "identity_summary",
    with_pop("select count(*) as rows, count(distinct _source_row_id) as distinct_ids, 0::bigint as null_ids, min(_source_row_id) as min_id, max(_source_row_id) as max_id, true as unique_ids, min(_source_row_id) = 0 and max(_source_row_id) = count(*) - 1 as dense_ids from pop"),
)
def identity_summary(spark, sf_dir):
    return gates.identity_summary(slim(spark, sf_dir))


@query(
    "invariant_scan",
    with_pop(
        "select count(*) as rows, cast(" + " + ".join(f"sum(case when {f} is null then 1 else 0 end)" for f in FEATURES) + " as bigint) as missing_features, 0::bigint as infinite_features, "
        "cast(sum(treatment) as bigint) as treated, cast(sum(conversion) as bigint) as converted, cast(sum(visit) as bigint) as visited, cast(sum(exposure) as bigint) as exposed, "
        + ", ".join(f"count(*) filter (where treatment = {a} and conversion = {b}) as n_{a}{b}" for a in (0, 1) for b in (0, 1))
        + " from pop"
    ),
)
def invariant_scan(spark, sf_dir):
    return gates.invariant_scan(population(spark, sf_dir))


@query(
    "ranking_gates",
    with_pop("select count(*) as rows, 0::bigint as bad_scores, count(*) - count(distinct _source_row_id) as bad_ids, 0::bigint as bad_treatment, 0::bigint as bad_outcome, count(*) filter (where treatment = 1) as treated, count(*) filter (where treatment = 0) as control from pop"),
)
def ranking_gates(spark, sf_dir):
    return gates.ranking_gates(scored_population(spark, sf_dir))


@query("arm_allocation", with_pop("select count(*) as rows, count(*) filter (where treatment = 1) as treated, count(*) filter (where treatment = 0) as control, round(avg(treatment), 9) as treated_rate from pop"))
def arm_allocation(spark, sf_dir):
    return rounded(profile.arm_allocation(slim(spark, sf_dir)))


@query("joint_ty", with_pop("select treatment, conversion, count(*) as n from pop group by all"))
def joint_ty(spark, sf_dir):
    return profile.joint_counts(slim(spark, sf_dir))


@query(
    "within_arm_share",
    with_pop(
        "select treatment, conversion, n, cast(sum(n) over (partition by treatment) as bigint) as arm_n, round(n / sum(n) over (partition by treatment), 9) as arm_share, round(n / sum(n) over (), 9) as joint_share from j",
        "j as (select treatment, conversion, count(*) as n from pop group by all)",
    ),
)
def within_arm_share(spark, sf_dir):
    return rounded(profile.within_arm_share(slim(spark, sf_dir)))


@query(
    "secondary_by_arm",
    with_pop("select treatment, count(*) as n, " + ", ".join(f"cast(sum({c}) as bigint) as {c}_sum, round(avg({c}), 9) as {c}_rate" for c in ("conversion", "visit", "exposure")) + " from pop group by treatment"),
)
def secondary_by_arm(spark, sf_dir):
    return rounded(profile.secondary_by_arm(slim(spark, sf_dir)))


@query("exposure_crosstab", with_pop("select treatment, count(*) filter (where exposure = 0) as exposure_0, count(*) filter (where exposure = 1) as exposure_1 from pop group by treatment"))
def exposure_crosstab(spark, sf_dir):
    return profile.crosstab(slim(spark, sf_dir))


@query("arm_moments", with_pop("select treatment, feature, count(value) as non_missing, round(avg(value), 6) as mean, round(var_samp(value), 4) as variance from long group by treatment, feature", LONG))
def arm_moments(spark, sf_dir):
    df = balance.arm_moments(population(spark, sf_dir))
    return df.select(TREATMENT, "feature", "non_missing", r("mean", 6), r("variance", 4))


QUANTILE_LIST = "[" + ", ".join(map(str, QUANTILES)) + "]"
SHIFTS = [f"shift_q{round(q * 100):02d}" for q in QUANTILES]
SMD_SQL = (
    "stat as (select feature, count(value) filter (where treatment = 0) as control_n, count(value) filter (where treatment = 1) as treated_n, "
    "count(*) filter (where treatment = 0 and value is null) as control_missing, count(*) filter (where treatment = 1 and value is null) as treated_missing, "
    "avg(value) filter (where treatment = 0) as m0, avg(value) filter (where treatment = 1) as m1, var_samp(value) filter (where treatment = 0) as v0, var_samp(value) filter (where treatment = 1) as v1, "
    f"quantile_cont(value, {QUANTILE_LIST}) filter (where treatment = 0) as q0, quantile_cont(value, {QUANTILE_LIST}) filter (where treatment = 1) as q1, min(value) as lo, max(value) as hi from long group by feature), "
    "smd as (select *, sqrt((v1 + v0) / 2) as sd, case when control_n < 2 or treated_n < 2 then 'UNDEFINED_INSUFFICIENT_NONMISSING_SUPPORT' when v0 + v1 = 0 and lo = hi then 'UNDEFINED_GLOBAL_CONSTANT' "
    "when v0 + v1 = 0 then 'UNDEFINED_ZERO_POOLED_SD' else 'DEFINED' end as status from stat)"
)


@query(
    "smd_balance",
    with_pop(
        "select feature, control_n, treated_n, control_missing, treated_missing, round(m0, 6) as control_mean, round(m1, 6) as treated_mean, round(sd, 6) as pooled_sd, status, "
        "round((m1 - m0) / sd, 9) as smd_signed, round(abs((m1 - m0) / sd), 9) as smd_absolute, round(v1 / v0, 9) as variance_ratio, "
        + ", ".join(f"round(q1[{k}] - q0[{k}], 6) as {s}" for k, s in enumerate(SHIFTS, 1))
        + " from smd",
        LONG,
        SMD_SQL,
    ),
)
def smd_balance(spark, sf_dir):
    df = balance.smd_balance(population(spark, sf_dir))
    coarse = {"control_mean", "treated_mean", "pooled_sd", *SHIFTS}
    return df.select(*[r(c, 6 if c in coarse else 9) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(
    "max_abs_smd",
    with_pop(
        "select round(max(abs((m1 - m0) / sd)), 9) as max_absolute_smd, max_by(feature, abs((m1 - m0) / sd)) as max_feature, count(*) as eligible, 0::bigint as constants, 0::bigint as invalid from smd where status = 'DEFINED'",
        LONG,
        SMD_SQL,
    ),
)
def max_abs_smd(spark, sf_dir):
    return rounded(balance.balance_summary(balance.smd_balance(population(spark, sf_dir), with_shifts=False)))


@query(
    "ks_distance",
    with_pop(
        "select feature, round(max(abs(ct / tt - cc / tc)), 9) as ks_distance from (select feature, sum(t) over w as ct, sum(c) over w as cc, sum(t) over (partition by feature) as tt, sum(c) over (partition by feature) as tc "
        "from k window w as (partition by feature order by value rows unbounded preceding)) group by feature",
        LONG,
        "k as (select feature, value, count(*) filter (where treatment = 1) as t, count(*) filter (where treatment = 0) as c from long where value is not null group by all)",
    ),
)
def ks_distance(spark, sf_dir):
    return rounded(balance.ks_distances(population(spark, sf_dir)))


@query(
    "feature_quantiles",
    with_pop(f"select feature, unnest({QUANTILE_LIST})::double as probability, round(unnest(q), 6) as value from (select feature, quantile_cont(value, {QUANTILE_LIST}) as q from long group by feature)", LONG),
)
def feature_quantiles(spark, sf_dir):
    return rounded(profile.quantiles(population(spark, sf_dir)), 6)


DESCRIBE_COLUMNS = "count(*) as n, count(value) as non_missing, count(*) - count(value) as missing, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, min(value) as min, max(value) as max, round(quantile_cont(value, 0.25), 6) as q25, round(quantile_cont(value, 0.5), 6) as q50, round(quantile_cont(value, 0.75), 6) as q75"


@query("feature_describe", with_pop(f"select feature, {DESCRIBE_COLUMNS} from long group by feature", LONG))
def feature_describe(spark, sf_dir):
    return rounded(profile.describe(population(spark, sf_dir)), 6)


@query("feature_describe_by_arm", with_pop(f"select treatment, feature, {DESCRIBE_COLUMNS} from long group by treatment, feature", LONG))
def feature_describe_by_arm(spark, sf_dir):
    return rounded(profile.describe(population(spark, sf_dir), by=TREATMENT), 6)


@query(
    "range_overlap",
    with_pop(
        "select feature, overlap_low, overlap_high, overlap_low <= overlap_high as overlaps from (select feature, greatest(min(value) filter (where treatment = 0), min(value) filter (where treatment = 1)) as overlap_low, "
        "least(max(value) filter (where treatment = 0), max(value) filter (where treatment = 1)) as overlap_high from long group by feature)",
        LONG,
    ),
)
def range_overlap(spark, sf_dir):
    return profile.range_overlap(population(spark, sf_dir))


@query("distinct_counts", with_pop("select feature, count(distinct value) as distinct, round(count(distinct value)::double / count(*), 9) as distinct_share from long group by feature", LONG))
def distinct_counts(spark, sf_dir):
    return rounded(profile.distinct_counts(population(spark, sf_dir)))


@query(
    "top_values",
    with_pop(
        "select feature, cast(rank as integer) as rank, value, n, round(n::double / (select count(*) from pop), 9) as share from (select feature, value, n, row_number() over (partition by feature order by n desc, value asc nulls last) as rank from (select feature, value, count(*) as n from long group by all)) where rank <= 5",
        LONG,
    ),
)
def top_values(spark, sf_dir):
    return rounded(profile.top_values(population(spark, sf_dir)))


query("approximate_quantiles")(lambda spark, sf_dir: profile.approximate_quantiles(population(spark, sf_dir)))
query("approximate_distinct")(lambda spark, sf_dir: profile.approximate_distinct(population(spark, sf_dir)))


def stored_sketches(spark, pop):
    """Sketches by month, written; what follows reads these and no rows."""
    return sketches.merge_sketches(materialize(sketches.sketch_features(pop, ("f10",)).withColumnRenamed("f10", "month"), "sketches"))


@query("sketched_quantiles", with_pop(f"select feature, probability, true as in_bounds from (select distinct feature from long where value is not null), (values {', '.join(f'({p}::double)' for p in QUANTILES)}) as t(probability)", LONG))
def sketched_quantiles(spark, sf_dir):
    """Whether the quantiles of merged sketches keep their error bound in the table."""
    pop = population(spark, sf_dir)
    return sketches.quantiles_in_bounds(pop, sketches.sketched_quantiles(stored_sketches(spark, pop)))


@query("sketched_distinct", with_pop("select feature, count(*) as n, count(*) - count(value) as missing, true as in_bounds from long group by feature", LONG))
def sketched_distinct(spark, sf_dir):
    """Whether the distinct counts of merged sketches keep theirs; rows and missing values are exact."""
    pop = population(spark, sf_dir)
    exact = profile.distinct_counts(pop).select("feature", F.col("distinct").alias("exact"))
    found = sketches.sketched_distinct(stored_sketches(spark, pop)).join(F.broadcast(exact), "feature")  # a row for each feature
    return found.select("feature", "n", "missing", (F.abs(F.col("distinct") - F.col("exact")) <= sketches.DISTINCT_ERROR * F.col("exact")).alias("in_bounds"))

# Repeated profiles

DEFINITIONS = {
    "DP-01": (ROW_ID,), "DP-02": FEATURES, "DP-03": (*COARSE, TREATMENT, OUTCOME), "DP-04": (*COARSE, TREATMENT), "DP-05": COARSE,
}


def duplicate_sql(name: str, columns) -> str:
    return (
        f"select '{name}' as definition, cast(sum(n) as bigint) as rows, cast(coalesce(sum(n) filter (where n > 1), 0) as bigint) as rows_in_groups, cast(coalesce(sum(n - 1) filter (where n > 1), 0) as bigint) as rows_beyond_first, "
        f"count(*) filter (where n > 1) as groups, max(n) as largest from (select count(*) as n from pop group by {', '.join(columns)})"
    )


DUPLICATES = "dup as (" + " union all ".join(duplicate_sql(k, v) for k, v in DEFINITIONS.items()) + ")"


@query("duplicate_profiles", with_pop("select * from dup", DUPLICATES))
def duplicate_profiles(spark, sf_dir):
    return profile.duplicate_audit(population(spark, sf_dir), DEFINITIONS)


@query("duplicate_rates", with_pop("select definition, round(rows_in_groups::double / rows, 9) as rate_in_groups, round(rows_beyond_first::double / rows, 9) as rate_beyond_first from dup", DUPLICATES))
def duplicate_rates(spark, sf_dir):
    return rounded(profile.duplicate_rates(duplicate_profiles(spark, sf_dir)))


@query(
    "duplicate_disposition",
    with_pop(
        "select definition, groups, case when groups = 0 then 'INFO' when definition = 'DP-01' then 'FAIL' else 'WARNING' end as evidence_status, case when groups = 0 then 'PASS' when definition = 'DP-01' then 'STOP' else 'WARNING' end as required_action from dup",
        DUPLICATES,
    ),
)
def duplicate_disposition(spark, sf_dir):
    return profile.duplicate_disposition(duplicate_profiles(spark, sf_dir))


@query("hashed_profiles", with_pop("select * exclude (definition) from (" + duplicate_sql("h", COARSE) + ")"))
def hashed_profiles(spark, sf_dir):
    return profile.hashed_profiles(population(spark, sf_dir), COARSE)


@query(
    "duplicate_characteristics",
    with_pop(
        "select n > 1 as repeated, count(*) as groups, cast(sum(n) as bigint) as rows, cast(sum(n - 1) as bigint) as rows_beyond_first, cast(sum(t) as bigint) as treated, cast(sum(y) as bigint) as converted, "
        f"round(sum(t) / sum(n)::double, 9) as treated_rate, round(sum(y) / sum(n)::double, 9) as converted_rate from (select count(*) as n, sum(treatment) as t, sum(conversion) as y from pop group by {', '.join(COARSE)}, f3) group by n > 1"
    ),
)
def duplicate_characteristics(spark, sf_dir):
    return rounded(profile.duplicate_characteristics(population(spark, sf_dir), (*COARSE, "f3")))


@query(
    "float32_collisions",
    with_pop("select a.b as beyond_float64, c.b as beyond_float32, c.b - a.b as extra from (select cast(coalesce(sum(n - 1), 0) as bigint) as b from (select count(*) as n from pop group by f0)) a, (select cast(coalesce(sum(n - 1), 0) as bigint) as b from (select count(*) as n from pop group by f0::float)) c"),
)
def float32_collisions(spark, sf_dir):
    return profile.float32_collisions(slim(spark, sf_dir))


@query("precision_reconciliation", with_pop("select count(*) as rows, 0::bigint as unmatched, count(*) filter (where f0::float::double <> f0) as different from pop"))
def precision_reconciliation(spark, sf_dir):
    df = slim(spark, sf_dir)
    return profile.reconcile_precision(df, df.withColumn("f0", F.col("f0").cast("float").cast("double")), ("f0",))


# Splits, folds, permutations


@query("split_assign", with_pop("select _source_row_id, split from parts", STRATA_SQL))
def split_assign(spark, sf_dir):
    return split.assign_split(slim(spark, sf_dir))


@query(
    "split_support",
    with_pop("select split, treatment, conversion, count(*) as n from parts where split <> 'held_out' group by all", STRATA_SQL),
)
def split_support(spark, sf_dir):
    df = slim(spark, sf_dir)
    members = split.assign_split(df)
    both = [split.split_support(df, members, s).withColumn("split", F.lit(s)) for s in ("train", "validation")]
    return both[0].unionByName(both[1]).select("split", F.col(TREATMENT).cast("long").alias(TREATMENT), F.col(OUTCOME).cast("long").alias(OUTCOME), "n")


@query(
    "split_disjoint",
    with_pop(
        "select 'as assigned' as membership, 0::bigint as overlapping, 0::bigint as missing, 0::bigint as extra, true as passed "
        "union all select 'damaged', count(*) filter (where _source_row_id % 97 = 0 and _source_row_id % 89 <> 1 and split <> 'train'), count(*) filter (where _source_row_id % 89 = 1), "
        "count(*) filter (where _source_row_id % 89 <> 1 and _source_row_id % 101 = 2), false from parts",
        STRATA_SQL,
    ),
)
def split_disjoint(spark, sf_dir):
    """The membership as assigned, and one with ids in two splits, ids left out, and ids of no row."""
    df = slim(spark, sf_dir)
    members = split.assign_split(df).select(ROW_ID, "split")
    less = members.where(F.col(ROW_ID) % 89 != 1)
    twice = less.where(F.col(ROW_ID) % 97 == 0).withColumn("split", F.lit("train"))
    strange = less.where(F.col(ROW_ID) % 101 == 2).withColumn(ROW_ID, -1 - F.col(ROW_ID))
    damaged = less.unionByName(twice).unionByName(strange)
    found = [split.disjoint_and_complete(m, df).withColumn("membership", F.lit(name)) for name, m in (("as assigned", members), ("damaged", damaged))]
    return found[0].unionByName(found[1])


@query("held_out_gate", with_pop("select case when count(*) = 4 then 'PASS' else 'FAIL' end as gate from (select distinct treatment, conversion from parts where split = 'held_out')", STRATA_SQL))
def held_out_gate(spark, sf_dir):
    df = slim(spark, sf_dir)
    return split.held_out_gate(df, split.assign_split(df))


@query(
    "membership_digest",
    with_pop(
        "select count(*) as rows, bit_xor(h) as xor_hash, cast(sum(h % 1000003) as bigint) as sum_hash from (select ('0x' || substr(md5(_source_row_id || '|' || split), 1, 12))::bigint as h from parts)", STRATA_SQL
    ),
)
def membership_digest(spark, sf_dir):
    return split.membership_digest(split.assign_split(slim(spark, sf_dir)))


@query(
    "smoke_sample",
    with_pop(
        "select _source_row_id from (select _source_row_id, row_number() over (partition by treatment, conversion order by md5('smoke|42|' || _source_row_id), _source_row_id) as k, count(*) over (partition by treatment, conversion) as n, count(*) over () as total from parts where split = 'train') where k <= floor(500.0::double * n / total + 0.5)",
        STRATA_SQL,
    ),
)
def smoke_sample(spark, sf_dir):
    df = slim(spark, sf_dir)
    return split.quota_sample(df, split.assign_split(df), "train", 500)


@query(
    "fold_assign_ab",
    with_pop("select _source_row_id, case when k <= floor(n * 0.5::double + 0.5) then 'A' else 'B' end as fold from (select _source_row_id, row_number() over (partition by treatment, conversion order by md5('ab|42|' || _source_row_id), _source_row_id) as k, count(*) over (partition by treatment, conversion) as n from pop)"),
)
def fold_assign_ab(spark, sf_dir):
    return split.assign_ab(slim(spark, sf_dir))


@query("fold_assign_k", with_pop("select _source_row_id, cast((row_number() over (partition by treatment order by md5('folds|42|' || _source_row_id), _source_row_id) - 1) % 5 as smallint) as fold_id from pop"))
def fold_assign_k(spark, sf_dir):
    return split.assign_folds(slim(spark, sf_dir))


PERMUTED_SQL = "perm as (select _source_row_id, f2, case when row_number() over (partition by f2 order by md5('perm|42|0|' || _source_row_id), _source_row_id) <= sum(treatment) over (partition by f2) then 1 else 0 end as t_perm from pop)"


@query("permute_treatment", with_pop("select _source_row_id, t_perm::tinyint as t_perm from perm", PERMUTED_SQL))
def permute_treatment(spark, sf_dir):
    return split.permute_treatment(population(spark, sf_dir), 0, ["f2"])


@query("permuted_block_counts", with_pop("select f2, count(*) as n, cast(sum(treatment) as bigint) as treated from pop group by f2"))
def permuted_block_counts(spark, sf_dir):
    df = population(spark, sf_dir)
    moved = joins.replace_treatment(df, split.permute_treatment(df, 0, ["f2"]))
    return moved.groupBy("f2").agg(F.count("*").alias("n"), F.sum(TREATMENT).alias("treated"))


@query(
    "cross_split_overlap",
    with_pop(
        f"select cast(sum(n) as bigint) as rows_compared, count(*) filter (where k > 1) as overlapping_profiles, cast(coalesce(sum(n) filter (where k > 1), 0) as bigint) as overlapping_rows from (select count(*) as n, count(distinct split) as k from parts where split <> 'held_out' group by {', '.join(COARSE)})",
        STRATA_SQL,
    ),
)
def cross_split_overlap(spark, sf_dir):
    df = population(spark, sf_dir)
    return profile.cross_split_overlap(df, split.assign_split(df), COARSE)


# Joins


@query("join_split_labels", with_pop("select split, count(*) as n, round(avg(f0), 6) as mean_f0 from parts group by split", STRATA_SQL))
def join_split_labels(spark, sf_dir):
    df = slim(spark, sf_dir)
    return rounded(joins.with_labels(df, split.assign_split(df)).groupBy("split").agg(F.count("*").alias("n"), F.avg("f0").alias("mean_f0")), 6)


@query("one_to_one_join", ORACLES["fold_assign_ab"].replace("select _source_row_id, case", "select _source_row_id, conversion, case").replace("(select _source_row_id, row_number()", "(select _source_row_id, conversion, row_number()"))
def one_to_one_join(spark, sf_dir):
    df = slim(spark, sf_dir)
    return joins.one_to_one(df.select(ROW_ID, OUTCOME), split.assign_ab(df))


@query("semi_join_rows", with_pop("select _source_row_id, f0 from parts where split = 'validation'", STRATA_SQL))
def semi_join_rows(spark, sf_dir):
    df = slim(spark, sf_dir)
    return joins.rows_in(df, split.SplitDataset(split.assign_split(df)).validation_ids()).select(ROW_ID, "f0")


@query("profile_semi_join", with_pop("select _source_row_id from pop p where exists (select 1 from (select f2, f3 from pop group by f2, f3 having count(*) > 20) q where q.f2 is not distinct from p.f2 and q.f3 is not distinct from p.f3)"))
def profile_semi_join(spark, sf_dir):
    df = population(spark, sf_dir)
    frequent = df.groupBy("f2", "f3").count().where("count > 20")
    return joins.rows_of_profiles(df, frequent, ["f2", "f3"]).select(ROW_ID)


@query("alignment_check", with_pop("select count(*) as expected, 0::bigint as misaligned_1, count(*) filter (where _source_row_id % 10 = 0) as misaligned_2 from pop"))
def alignment_check(spark, sf_dir):
    df = slim(spark, sf_dir)
    return joins.alignment(df, df, df.where(f"{ROW_ID} % 10 <> 0"))


@query("id_set_relations", with_pop("select count(*) filter (where treatment = 1 and visit = 1) as common, count(*) filter (where treatment = 1 and visit = 0) as only_a, count(*) filter (where treatment = 0 and visit = 1) as only_b, false as disjoint, false as a_within_b, false as equal from pop"))
def id_set_relations(spark, sf_dir):
    df = slim(spark, sf_dir)
    return joins.id_sets(df.where("treatment = 1"), df.where("visit = 1"))


@query(
    "complete_grid",
    with_pop("select a as treatment, b as exposure, coalesce(n, 0) as n from (select unnest([0, 0, 1, 1])::bigint as a, unnest([0, 1, 0, 1])::bigint as b) g left join (select treatment, exposure, count(*) as n from pop group by all) c on a = treatment and b = exposure"),
)
def complete_grid(spark, sf_dir):
    return profile.complete_grid(profile.joint_counts(slim(spark, sf_dir), (TREATMENT, "exposure")), (TREATMENT, "exposure"))


@query("canonical_order", with_pop("select f3, _source_row_id, row_number() over (order by f3 asc nulls last, _source_row_id) as place from pop qualify place <= 100"))
def canonical_order(spark, sf_dir):
    df = split.canonical_order(population(spark, sf_dir), ["f3"]).limit(100)  # the head of the order is the feature
    order = Window.orderBy(F.asc_nulls_last("f3"), ROW_ID)  # a hundred rows
    return df.select("f3", ROW_ID).withColumn("place", F.row_number().over(order).cast("long"))


@query("support_findings", with_pop(
    "select kind, item, n, case when n > 0 then 'INFO' else 'FAIL' end as status, case when n > 0 then 'PASS' else 'STOP' end as action from (select 'arm' as kind, 'treatment=' || treatment as item, count(*) as n from pop group by treatment "
    "union all select 'cell', treatment || '_' || conversion, count(*) from pop group by treatment, conversion union all select 'range', feature, case when greatest(min(value) filter (where treatment = 0), min(value) filter (where treatment = 1)) <= least(max(value) filter (where treatment = 0), max(value) filter (where treatment = 1)) then 1 else 0 end from long group by feature)", LONG))  # fmt: skip
def support_findings(spark, sf_dir):
    return profile.support_findings(population(spark, sf_dir))


@query("first_per_group", with_pop("select f10, any_value(f10 * 2) as twice from pop group by f10"))
def first_per_group(spark, sf_dir):
    return profile.first_per_group(population(spark, sf_dir).withColumn("twice", F.col("f10") * 2), ["f10"], "twice")


@query("all_cells_supported", with_pop("select min(n) > 0 as supported, min(n) as least from (select count(*) as n from pop group by treatment, conversion)"))
def all_cells_supported(spark, sf_dir):
    return profile.all_cells_supported(slim(spark, sf_dir))


@query("treatment_rate", with_pop("select round(avg(treatment), 9) as g from parts where split = 'train'", STRATA_SQL))
def treatment_rate(spark, sf_dir):
    df = slim(spark, sf_dir)
    train = joins.rows_in(df, split.SplitDataset(split.assign_split(df)).train_ids())
    return rounded(profile.treatment_rate(train))


# Ranking metrics

ATE_SQL = "select round(p1 - p0, 9) as ate, round(se, 9) as se, round(p1 - p0 - 1.96 * se, 9) as ci_95_low, round(p1 - p0 + 1.96 * se, 9) as ci_95_high, round(100 * (p1 - p0), 9) as ate_percentage_points, round((p1 - p0) / p0, 9) as relative_lift from (select p1, p0, sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0) as se from (select avg(conversion) filter (where treatment = 1) as p1, avg(conversion) filter (where treatment = 0) as p0, count(*) filter (where treatment = 1) as n1, count(*) filter (where treatment = 0) as n0 from pop))"


@query("ate", with_pop(ATE_SQL))
def ate(spark, sf_dir):
    return rounded(ranking.ate(slim(spark, sf_dir)))


@query("canonical_ranking", with_pop("select _source_row_id, r, n1::bigint as n1, n0::bigint as n0, y1::bigint as y1, y0::bigint as y0 from run", prefix_sql("pop", "f0")))
def canonical_ranking(spark, sf_dir):
    return ranking.ranked(scored_population(spark, sf_dir)).select(ROW_ID, "r", "n1", "n0", "y1", "y0")


@query("qini_curve", with_pop("select round(coverage, 9) as coverage, round(qini_gain, 6) as qini_gain from curve", prefix_sql("pop", "f0"), curve_sql()))
def qini_curve(spark, sf_dir):
    return ranking.qini_curve(scored_population(spark, sf_dir)).select(r("coverage"), r("qini_gain", 6))


SUMMARY_COLUMNS = "points, round(qini_area, 6) as qini_area, round(theoretical_random, 6) as theoretical_random, round(qini_area - theoretical_random, 6) as qini_above_random"


@query("qini_summary", with_pop(f"select {SUMMARY_COLUMNS} from summary", prefix_sql("pop", "f0"), curve_sql(), summary_sql()))
def qini_summary(spark, sf_dir):
    return rounded(ranking.qini_summary(scored_population(spark, sf_dir)), 6)


@query(
    "uplift_at_k",
    with_pop(
        "select k, r as m, round(u, 9) as uplift, round(r * u, 6) as incremental_conversions, case when u is null then 'UNSUPPORTED_METRIC' else 'OK' end as status from (select k, r, y1 / nullif(n1, 0)::double - y0 / nullif(n0, 0)::double as u from run join (select unnest(['10', '20', '30', '50', '100']) as k, unnest([0.1, 0.2, 0.3, 0.5, 1.0])::double as f) on r = least(n, greatest(1, ceil(f * n))))",
        prefix_sql("pop", "f0"),
    ),
)
def uplift_at_k(spark, sf_dir):
    df = ranking.uplift_at_k(scored_population(spark, sf_dir))
    return df.select("k", "m", r("uplift"), r("incremental_conversions", 6), "status")


DECILES = (
    "dec as (select cast(1 + ((r - 1) * 10) // n as integer) as decile, count(*) as n, cast(sum(treatment) as bigint) as n1, cast(sum(1 - treatment) as bigint) as n0, cast(sum(treatment * conversion) as bigint) as y1, cast(sum((1 - treatment) * conversion) as bigint) as y0 from run group by 1)"
)


@query(
    "decile_uplift",
    with_pop(
        "select *, round(y1 / n1::double, 9) as treated_rate, round(y0 / n0::double, 9) as control_rate, round(y1 / n1::double - y0 / n0::double, 9) as observed_uplift, round(n * (y1 / n1::double - y0 / n0::double), 6) as incremental_conversions, y0 < 5 as low_control_conversion_warning from dec",
        prefix_sql("pop", "f0"),
        DECILES,
    ),
)
def decile_uplift(spark, sf_dir):
    df = ranking.decile_uplift(scored_population(spark, sf_dir))
    return df.select(*[r(c, 6 if c == "incremental_conversions" else 9) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(
    "cumulative_rate_deciles",
    with_pop("select decile, round(sum(y1) over w / sum(n1) over w - sum(y0) over w / sum(n0) over w, 9) as cumulative_uplift_rate from dec window w as (order by decile rows unbounded preceding)", prefix_sql("pop", "f0"), DECILES),
)
def cumulative_rate_deciles(spark, sf_dir):
    return rounded(ranking.cumulative_by_decile(ranking.decile_uplift(scored_population(spark, sf_dir))))


@query(
    "cumulative_rate_curve",
    with_pop("select round(coverage, 9) as coverage, round(uplift_rate, 9) as uplift_rate from curve", prefix_sql("pop", "f0"), curve_sql("", "y1 / n1::double - y0 / n0::double", "n0 > 0 and n1 > 0", False, "uplift_rate")),
)
def cumulative_rate_curve(spark, sf_dir):
    return rounded(ranking.cumulative_rate_curve(scored_population(spark, sf_dir)))


@query(
    "average_ranks",
    with_pop("select _source_row_id, f3, rank() over (order by f3 desc nulls last) + (count(*) over (partition by f3) - 1) / 2.0::double as rank from pop"),
)
def average_ranks(spark, sf_dir):
    return ranking.average_ranks(population(spark, sf_dir), "f3")


METHODS = {"f0": "f0", "f1": "f1", "minus_f0": "-f0"}


@query(
    "evaluate_methods",
    with_pop(
        f"select method, {SUMMARY_COLUMNS} from summary",
        "scored as (" + " union all ".join(f"select _source_row_id, treatment, conversion, '{m}' as method, {e} as score from pop" for m, e in METHODS.items()) + ")",
        prefix_sql("scored", "score", "method"),
        curve_sql("method"),
        summary_sql("method"),
    ),
)
def evaluate_methods(spark, sf_dir):
    df = population(spark, sf_dir)
    frames = F.array(*[F.struct(F.lit(m).alias("method"), F.expr(e).alias("score")) for m, e in METHODS.items()])
    scored = df.select(ROW_ID, TREATMENT, OUTCOME, F.explode(frames).alias("_s")).select(ROW_ID, TREATMENT, OUTCOME, "_s.*")
    return rounded(ranking.evaluate_ranking(scored, ["method"])["summary"], 6)


DIAGNOSTICS = (
    "scored as (select *, round(0.05 + f0 / 5000000.0::double, 4) as s from pop), g as (select s, sum(conversion)::double as p, sum(1 - conversion)::double as q from scored group by s), "
    "c as (select *, sum(p) over w as cp, sum(q) over w as cq from g window w as (order by s desc rows unbounded preceding))"
)


@query(
    "response_diagnostics",
    with_pop(
        "select round(sum(q * (cp - p) + 0.5 * p * q) / (sum(p) * sum(q)), 9) as roc_auc, round(sum(p * cp / (cp + cq)) / sum(p), 9) as average_precision, round(-sum(p * ln(s) + q * ln(1 - s)) / (sum(p) + sum(q)), 9) as log_loss from c",
        DIAGNOSTICS,
    ),
)
def response_diagnostics(spark, sf_dir):
    df = slim(spark, sf_dir).withColumn("score", F.round(0.05 + F.col("f0") / 5_000_000.0, 4))
    return rounded(ranking.response_diagnostics(df))


def uniform_sql(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 13))::bigint / 4503599627370496.0::double"


@query("random_scores", with_pop(f"select _source_row_id, {uniform_sql(chr(39) + 'random|42|' + chr(39) + ' || _source_row_id')} as score from pop"))
def random_scores(spark, sf_dir):
    return resample.random_scores(slim(spark, sf_dir)).select(ROW_ID, "score")


VALIDATION = "val as (select * from parts where split = 'validation')"


def validation_rows(spark, sf_dir):
    df = slim(spark, sf_dir)
    return joins.rows_in(df, split.SplitDataset(split.assign_split(df)).validation_ids())


@query(
    "random_reference",
    with_pop(
        "select draw, round(qini_area, 6) as qini_area, round(theoretical_random, 6) as theoretical_random, round(qini_area - theoretical_random, 6) as qini_above_random from summary",
        STRATA_SQL,
        VALIDATION,
        f"scored as (select _source_row_id, treatment, conversion, draw::int as draw, {uniform_sql(chr(39) + 'draw|42|' + chr(39) + ' || draw || ' + chr(39) + '|' + chr(39) + ' || _source_row_id')} as score from val, (select unnest(range(0, 200)) as draw))",
        prefix_sql("scored", "score", "draw"),
        curve_sql("draw"),
        summary_sql("draw"),
    ),
)
def random_reference(spark, sf_dir):
    return rounded(resample.random_reference(validation_rows(spark, sf_dir)), 6)


def hash_sql(*parts: str) -> str:
    return "md5(concat_ws('|', " + ", ".join(parts) + "))"


def uniform_of_sql(*parts: str) -> str:
    return f"('0x' || substr({hash_sql(*parts)}, 1, 13))::bigint / 4503599627370496.0::double"


#: Picks are halved like coins down to parts of the unit interval, then placed in their part.
BOOT_SQL = f"""placed as (select *, row_number() over (partition by treatment order by _source_row_id) as place, count(*) over (partition by treatment) as arm_n from val),
arms as (select treatment, count(*) as arm_n from val group by treatment),
lv as (select greatest(0, ceil(log2(max(arm_n) / {resample.PART_PICKS}.0)))::int as levels from arms),
halves as (
  select d::int as draw, treatment, 0 as level, 0::bigint as part, arm_n as c from arms, (select unnest(range(0, 500)) as d)
  union all
  select draw, treatment, level + 1, part * 2 + side, case when side = 0 then heads else c - heads end
  from (
    select *, list_sum(list_transform(range(0, greatest(c - 1, 0) // {resample.WORD} + 1), lambda i: bit_count(('0x' || substr({hash_sql("'split'", "'42'", "draw", "treatment", "level", "part", "i")}, 1, 13))::bigint >> ({resample.WORD} - least({resample.WORD}, c - {resample.WORD} * i))::bigint)))::bigint as heads
    from halves, lv where level < levels
  ), (select unnest([0, 1]) as side)
),
picks as (
  select draw, treatment, least(floor((part + {uniform_of_sql("'boot'", "'42'", "draw", "treatment", "part", "j")}) / (1::bigint << levels)::double * arm_n), ((part + 1) * arm_n - 1) // (1::bigint << levels))::bigint + 1 as place
  from (select *, unnest(range(1, c + 1)) as j from halves join lv on level = levels join arms using (treatment))
),
scored as (select draw, p._source_row_id * 64 + row_number() over (partition by draw, p._source_row_id) as _source_row_id, p.treatment, conversion, f0 as score from picks k join placed p on p.treatment = k.treatment and p.place = k.place)"""


@query(
    "bootstrap_qini",
    with_pop(
        "select draw, round(qini_area, 6) as qini_area, round(theoretical_random, 6) as theoretical_random, round(qini_area - theoretical_random, 6) as qini_above_random from summary",
        STRATA_SQL,
        VALIDATION,
        BOOT_SQL,
        prefix_sql("scored", "score", "draw"),
        curve_sql("draw"),
        summary_sql("draw"),
    ),
)
def bootstrap_qini(spark, sf_dir):
    rows = validation_rows(spark, sf_dir).withColumn("score", F.col("f0")).select(ROW_ID, TREATMENT, OUTCOME, "score")
    return rounded(resample.bootstrap_qini(rows), 6)


@query("bootstrap_interval", with_pop(
    "select count(*) as finite, round(quantile_cont(v, 0.025), 6) as low, round(quantile_cont(v, 0.975), 6) as high from (select round(qini_area - theoretical_random, 6) as v from summary)",
    STRATA_SQL, VALIDATION, BOOT_SQL, prefix_sql("scored", "score", "draw"), curve_sql("draw"), summary_sql("draw")))
def bootstrap_interval(spark, sf_dir):
    return rounded(resample.percentile_interval(bootstrap_qini(spark, sf_dir)), 6)


# Meta-learner algebra over fixed surrogate surfaces

NUISANCE = (
    f"nuis as (select *, 0.05 + f0 / 5000000.0::double + 0.02 * {uniform_sql(chr(39) + 'mu0|0|' + chr(39) + ' || _source_row_id')} as mu0, "
    f"0.05 + f0 / 5000000.0::double + case when f0 > 250000 then 0.09 else 0.0 end + 0.02 * {uniform_sql(chr(39) + 'mu1|0|' + chr(39) + ' || _source_row_id')} as mu1 from pop)"
)


def nuisance(spark, sf_dir):
    return meta.surrogate_nuisance(slim(spark, sf_dir))


@query("tlearner_tau", with_pop("select _source_row_id, round(mu1 - mu0, 9) as tau from nuis", NUISANCE))
def tlearner_tau(spark, sf_dir):
    return rounded(meta.tlearner_tau(nuisance(spark, sf_dir)).select(ROW_ID, "tau"))


@query("tau_reload", with_pop("select count(*) as rows, count(*) filter (where _source_row_id % 100 = 0) as beyond_tolerance from nuis", NUISANCE))
def tau_reload(spark, sf_dir):
    stored = meta.tlearner_tau(nuisance(spark, sf_dir))
    moved = stored.withColumn("mu1", F.col("mu1") + F.when(F.col(ROW_ID) % 100 == 0, 1e-3).otherwise(1e-9)).select(ROW_ID, "mu1", "mu0")
    return meta.tau_reload(stored, moved)


@query(
    "tau_summary",
    with_pop(
        "select round(min(t), 9) as min, round(max(t), 9) as max, round(avg(t), 9) as mean, round(stddev_pop(t), 9) as sd, "
        + ", ".join(f"round(quantile_cont(t, {q}), 9) as q{round(q * 100):02d}" for q in QUANTILES)
        + ", count(distinct t) as distinct, 1.0::double as finite_share from (select round(mu1 - mu0, 9) as t from nuis)",
        NUISANCE,
    ),
)
def tau_summary(spark, sf_dir):
    return rounded(meta.tau_summary(tlearner_tau(spark, sf_dir)))


AB_SQL = "ab as (select *, case when k <= floor(n * 0.5::double + 0.5) then 'A' else 'B' end as fold from (select *, row_number() over (partition by treatment, conversion order by md5('ab|42|' || _source_row_id), _source_row_id) as k, count(*) over (partition by treatment, conversion) as n from nuis))"


@query("pseudo_outcomes", with_pop("select _source_row_id, case when treatment = 1 then 'treated' else 'control' end as arm, round(case when treatment = 1 then conversion - mu0 else mu1 - conversion end, 9) as pseudo_effect from nuis", NUISANCE))
def pseudo_outcomes(spark, sf_dir):
    return rounded(meta.pseudo_outcomes(nuisance(spark, sf_dir), "mu0", "mu1"))


@query("xlearner_combine", with_pop("select _source_row_id, round(g * (mu1 - 0.9 * mu0) + (1 - g) * (mu1 - mu0), 9) as tau from nuis, (select avg(treatment) as g from pop)", NUISANCE))
def xlearner_combine(spark, sf_dir):
    df = nuisance(spark, sf_dir).withColumn("tau1", F.col("mu1") - F.col("mu0")).withColumn("tau0", F.col("mu1") - 0.9 * F.col("mu0"))
    rated = df.crossJoin(F.broadcast(profile.treatment_rate(df)))  # a single row
    return rounded(meta.xlearner_combine(rated, F.col("g")).select(ROW_ID, "tau"))


@query("oof_coverage", with_pop("select count(*) filter (where _source_row_id % 50 = 0) as missing, 0::bigint as unexpected, count(*) filter (where _source_row_id % 50 = 1) as repeated, count(*) as rows from pop"))
def oof_coverage(spark, sf_dir):
    df = slim(spark, sf_dir).select(ROW_ID)
    oof = df.where(f"{ROW_ID} % 50 <> 0")
    return meta.oof_coverage(df, oof.union(df.where(f"{ROW_ID} % 50 = 1")))


@query("opposite_fold", with_pop("select count(*) filter (where _source_row_id % 7 = 0) as same_fold, count(*) as rows from ab", NUISANCE, AB_SQL))
def opposite_fold(spark, sf_dir):
    folds = split.assign_ab(slim(spark, sf_dir))
    other = F.when(F.col("fold") == "A", "B").otherwise("A")
    return meta.opposite_fold_violations(folds.withColumn("prediction_fold", F.when(F.col(ROW_ID) % 7 == 0, F.col("fold")).otherwise(other)))


@query(
    "dr_pseudo_outcome",
    with_pop("select _source_row_id, round(mu1 - mu0 + treatment * (conversion - mu1) / 0.85::double - (1 - treatment) * (conversion - mu0) / (1 - 0.85::double), 9) as dr_pseudo_outcome from nuis", NUISANCE),
)
def dr_pseudo_outcome(spark, sf_dir):
    return rounded(meta.dr_pseudo_outcome(nuisance(spark, sf_dir), 0.85).select(ROW_ID, "dr_pseudo_outcome"))


@query("repeated_seeds", with_pop(" union all ".join(f"select {s}::int as seed, round(avg({uniform_sql(chr(39) + f'random|{s}|' + chr(39) + ' || _source_row_id')}), 9) as mean_score, count(*) as rows from pop" for s in (42, 123, 2026))))
def repeated_seeds(spark, sf_dir):
    df = slim(spark, sf_dir)
    frames = {s: resample.random_scores(df, s).agg(F.avg("score").alias("mean_score"), F.count("*").alias("rows")) for s in (42, 123, 2026)}
    return rounded(meta.with_seed(frames))


@query("method_comparison", with_pop("select 'ate' as method, round(p1 - p0, 9) as ate, null::bigint as rows from (select avg(conversion) filter (where treatment = 1) as p1, avg(conversion) filter (where treatment = 0) as p0 from pop) union all select 'rows', null, count(*) from pop"))
def method_comparison(spark, sf_dir):
    df = slim(spark, sf_dir)
    return rounded(meta.comparison({"ate": ranking.ate(df).select("ate"), "rows": df.agg(F.count("*").alias("rows"))})).select("method", "ate", "rows")


# Calibration of the effect against its distribution under permuted treatment

REPLICATIONS, CONTINUED = range(0, 2000), range(2000, 2100)


def swap_or_not_sql(replications: range, block: str = "f2") -> list[str]:
    """Permuted treatment of all replications, a subquery for each round."""
    p = split.PRIME
    ctes = [
        f"ranked as (select _source_row_id, conversion, row_number() over (partition by {block} order by _source_row_id) - 1 as place, count(*) over (partition by {block}) as n, (sum(treatment) over (partition by {block}))::bigint as treated, min(_source_row_id) over (partition by {block}) as block from pop)",
        f"x0 as (select *, place as x, rep % {p} as e from ranked, (select unnest(range({replications.start}, {replications.stop})) as rep))",
    ]
    for i, (a1, b1, a2, b2, a3, b3) in enumerate(split.round_keys(42)):
        ctes.append(
            f"x{i + 1} as (select * replace (case when (greatest(x, y) % {p} * m + l) % {p} < {1 << 30} then y else x end as x) from "
            f"(select *, ((k * {p} + l) % n - x + n) % n as y from (select * exclude ({'' if i == 0 else 'k, l, m, y, '}e), e, (e * {a1} + {b1}) % {p} as k, ((e * {a2} + {b2}) % {p} + block) % {p} as l, 1 + (e * {a3} + {b3}) % {p} % {p - 1} as m from x{i})))"
        )
    t = "(x < treated)::int"
    ctes.append(f"effects as (select rep::int as rep, sum({t})::bigint as n1, sum({t} * conversion)::bigint as y1, sum(1 - {t})::bigint as n0, sum((1 - {t}) * conversion)::bigint as y0 from x{split.ROUNDS} group by rep)")
    ctes.append("nulls as (select *, round(y1 / n1::double - y0 / n0::double, 9) as value from effects)")
    return ctes


NULLS = swap_or_not_sql(REPLICATIONS)
OBSERVED = "observed as (select round(avg(conversion) filter (where treatment = 1) - avg(conversion) filter (where treatment = 0), 9) as o from pop)"


def null_values(spark, sf_dir, replications=REPLICATIONS):
    df = population(spark, sf_dir, (ROW_ID, "f2", TREATMENT, OUTCOME))
    return rounded(split.replicated_effects(df, replications, ["f2"]))


def observed_effect(spark, sf_dir) -> float:
    return round(ranking.ate(population(spark, sf_dir, (ROW_ID, TREATMENT, OUTCOME))).first()["ate"], 9)  # one number


@query("permutation_replications", with_pop("select rep, n1, y1, n0, y0, value from nulls", *NULLS))
def permutation_replications(spark, sf_dir):
    return null_values(spark, sf_dir)


@query("permutation_continuation", with_pop("select rep, n1, y1, n0, y0, value from nulls", *swap_or_not_sql(CONTINUED)))
def permutation_continuation(spark, sf_dir):
    """The first replications of a later batch: appended to those before, not made from them."""
    return null_values(spark, sf_dir, CONTINUED)


@query(
    "null_order_statistic",
    with_pop(
        "select probability, rank, threshold, replications, count(*) filter (where value < threshold) as below, count(*) filter (where value = threshold) as equal, count(*) filter (where value > threshold) as above from "
        "(select p::double as probability, ceil(count(*) * p::double)::bigint as rank, list(value order by value)[ceil(count(*) * p::double)::bigint] as threshold, count(*) as replications from nulls, (select unnest([0.95, 0.99]) as p) group by p), nulls group by all",
        *NULLS,
    ),
)
def null_order_statistic(spark, sf_dir):
    return resample.null_order_statistic(materialize(null_values(spark, sf_dir), "null"))


@query("tail_fraction", with_pop("select count(*) filter (where value >= o) as at_least_observed, count(*) as replications, count(*) filter (where value >= o) / count(*)::double as tail_fraction from nulls, observed", *NULLS, OBSERVED))
def tail_fraction(spark, sf_dir):
    return resample.tail_fraction(null_values(spark, sf_dir), observed_effect(spark, sf_dir))


#: The exact binomial ranks are arithmetic on two parameters; what they pick comes from the table.
RANKS = resample.binomial_ranks(len(REPLICATIONS), 0.95)


@query(
    "order_statistic_interval",
    with_pop(
        f"select 0.95::double as probability, count(*) as replications, {RANKS['lower_rank']}::bigint as lower_rank, {RANKS['upper_rank']}::bigint as upper_rank, list(value order by value)[{RANKS['lower_rank']}] as lower_value, "
        f"list(value order by value)[{RANKS['upper_rank']}] as upper_value, {str(RANKS['lower_clipped']).lower()} as lower_clipped, {str(RANKS['upper_clipped']).lower()} as upper_clipped from nulls",
        *NULLS,
    ),
)
def order_statistic_interval(spark, sf_dir):
    return resample.order_statistic_interval(materialize(null_values(spark, sf_dir), "null"), 0.95)


@query(
    "diagnostic_actions",
    with_pop(
        "select feature, observed, p95, p99, case when observed <= p95 then 'INFO' when observed <= p99 then 'WARNING' else 'MATERIAL_CONCERN' end as evidence_status, case when observed <= p95 then 'PASS' when observed <= p99 then 'WARNING' else 'ROBUSTNESS_REQUIRED' end as required_action "
        "from (select 'effect' as feature, o as observed, list(value order by value)[ceil(count(*) * 0.95)::bigint] as p95, list(value order by value)[ceil(count(*) * 0.99)::bigint] as p99 from nulls, observed group by o)",
        *NULLS,
        OBSERVED,
    ),
)
def diagnostic_actions(spark, sf_dir):
    """The action for the observed effect by thresholds from its permuted replications."""
    found = {r["probability"]: r["threshold"] for r in resample.null_order_statistic(materialize(null_values(spark, sf_dir), "null")).collect()}  # two rows
    df = spark.range(1).select(F.lit("effect").alias("feature"), F.lit(observed_effect(spark, sf_dir)).alias("observed"), F.lit(found[0.95]).alias("p95"), F.lit(found[0.99]).alias("p99"))
    return resample.diagnostic_actions(df)


#: Records of every kind, sound or not, by row id: vocabulary and the id's divisor.
RECORD_FIELDS = {
    "evidence_class": (("HARD_GATE", "EMPIRICAL_DIAGNOSTIC", "OTHER"), 1),
    "evidence_status": (("PASS", "FAIL", "INFO", "WARNING", "MATERIAL_CONCERN", None), 3),
    "required_action": (("PASS", "WARNING", "ROBUSTNESS_REQUIRED", "STOP", "OTHER", None), 18),
    "execution_state": (("EXECUTED", "EXECUTED", "DEFERRED"), 108),
}
RECORDS_SQL = "records as (select " + ", ".join(
    f"case (_source_row_id // {divisor}) % {len(names)} " + " ".join(f"when {k} then '{n}'" for k, n in enumerate(names) if n) + f" end as {field}" for field, (names, divisor) in RECORD_FIELDS.items()
) + " from pop)"


@query(
    "evidence_violations",
    with_pop(
        "select evidence_class, execution_state, count(*) as violations from records where case when execution_state <> 'EXECUTED' then evidence_status is not null or required_action is not null "
        "else not coalesce(((evidence_class = 'HARD_GATE' and evidence_status in ('PASS', 'FAIL')) or (evidence_class = 'EMPIRICAL_DIAGNOSTIC' and evidence_status in ('INFO', 'WARNING', 'MATERIAL_CONCERN'))) "
        "and required_action in ('PASS', 'WARNING', 'ROBUSTNESS_REQUIRED', 'STOP'), false) end group by all",
        RECORDS_SQL,
    ),
)
def evidence_violations(spark, sf_dir):
    """Violations among records of every combination, and none among the population's own gates."""
    k = F.col(ROW_ID)
    made = {f: F.array(*[F.lit(n) for n in names])[F.pmod(F.floor(k / divisor), F.lit(len(names))).cast("int")].alias(f) for f, (names, divisor) in RECORD_FIELDS.items()}
    records = population(spark, sf_dir).select(*made.values())
    own = gates.pre_split_gates(population(spark, sf_dir)).withColumn("execution_state", F.lit("EXECUTED")).select(*made)
    return resample.evidence_violations(records.unionByName(own)).groupBy("evidence_class", "execution_state").agg(F.count("*").alias("violations"))



# Sources and sinks

RAW_COLUMNS = ", ".join((*FEATURES, *LABELS))


def csv_copy(spark, sf_dir) -> str:
    """The population's raw columns as CSV files whose names are in id order."""
    path = new_folder(spark, "csv")
    population(spark, sf_dir).orderBy(ROW_ID).select(*FEATURES, *LABELS).write.options(header=True).csv(path)
    return path


@query("csv_typed_scan", with_pop(f"select {RAW_COLUMNS} from pop"))
def csv_typed_scan(spark, sf_dir):
    return ingest.read_csv_typed(spark, csv_copy(spark, sf_dir))


@query("csv_safe_cast", with_pop("select count(*) as rows, count(f3) as f3, round(sum(f0), 2) as f0, cast(sum(treatment) as bigint) as treated from pop"))
def csv_safe_cast(spark, sf_dir):
    df = ingest.safe_cast(ingest.read_csv_text(spark, csv_copy(spark, sf_dir)))
    return df.agg(F.count("*").alias("rows"), F.count("f3").alias("f3"), F.round(F.sum("f0"), 2).alias("f0"), F.sum(TREATMENT).alias("treated"))


@query("csv_text_quality", with_pop("select feature, count(*) - count(value) as missing, 0::bigint as malformed from long group by feature", LONG))
def csv_text_quality(spark, sf_dir):
    return gates.text_quality_counts(ingest.read_csv_text(spark, csv_copy(spark, sf_dir)))


@query("csv_inferred_scan", with_pop("select count(*) as rows, count(f3) as f3, max(f0) as f0 from pop"))
def csv_inferred_scan(spark, sf_dir):
    return ingest.read_csv_inferred(spark, csv_copy(spark, sf_dir)).agg(F.count("*").alias("rows"), F.count("f3").alias("f3"), F.max("f0").alias("f0"))


@query("csv_to_parquet", with_pop(f"select {RAW_COLUMNS}, _source_row_id from pop"))
def csv_to_parquet(spark, sf_dir):
    path = new_folder(spark, "processed")
    ingest.convert_csv(spark, csv_copy(spark, sf_dir), path)
    return ingest.scan(spark, path, (*FEATURES, *LABELS, ROW_ID))


@query("row_ordinal", with_pop("select _source_row_id, f0, treatment from pop"))
def row_ordinal(spark, sf_dir):
    return ingest.with_row_ordinal(ingest.read_csv_typed(spark, csv_copy(spark, sf_dir))).select(ROW_ID, "f0", TREATMENT)


@query("prefix_limit", with_pop("select _source_row_id, f0 from pop where _source_row_id < 1000"))
def prefix_limit(spark, sf_dir):
    return ingest.prefix(slim(spark, sf_dir), 1000).select(ROW_ID, "f0")


@query("projected_scan", with_pop("select _source_row_id, f0, treatment from pop"))
def projected_scan(spark, sf_dir):
    path = new_folder(spark, "processed")
    ingest.write_parquet(population(spark, sf_dir).select(*FEATURES, *LABELS, ROW_ID), path)
    return ingest.scan(spark, path, (ROW_ID, "f0", TREATMENT))


@query(
    "describe_columns",
    "select column_name, column_type, cast(position as integer) as position from (values " + ", ".join(f"('{c}', '{'double' if c in FEATURES else 'bigint'}', {k})" for k, c in enumerate((ROW_ID, *FEATURES, *LABELS))) + ") as t(column_name, column_type, position)",
)
def describe_columns(spark, sf_dir):
    return ingest.describe_columns(population(spark, sf_dir))


#: Cells, leaves of 4,096 ids and two levels of up to 256 children above them: the tree of some 268 million ids.
TREE_SQL = (
    "cells as ("
    + " union all ".join(
        f"select _source_row_id as id, '{c}' as column_name, '{'double' if c in FEATURES else 'bigint'}' as type, {c} is not null as there, coalesce({'cast(cast(' + c + ' as bit) as bigint)' if c in FEATURES else c}::varchar, '-') as cell from pop"
        for c in (ROW_ID, *FEATURES, *LABELS)
    )
    + """), leaves as (
  select column_name, type, id // 4096 as node, count(*) as n, count(*) filter (there) as k, sha256(string_agg(cell, chr(10) order by id)) as digest from cells group by all
), middle as (
  select column_name, type, node // 256 as node, sum(n) as n, sum(k) as k, sha256(string_agg(node || ':' || digest, chr(10) order by node)) as digest from leaves group by column_name, type, node // 256
), top as (
  select column_name, type, sum(n) as n, sum(k) as k, sha256(string_agg(node || ':' || digest, chr(10) order by node)) as digest from middle group by column_name, type
)"""
)


@query("semantic_digest", with_pop("select column_name, n::bigint as rows, k::bigint as non_missing, sha256(column_name || chr(10) || type || chr(10) || digest) as sha256 from top", TREE_SQL))
def semantic_digest(spark, sf_dir):
    return ingest.semantic_digest(population(spark, sf_dir))


@query(
    "first_difference",
    with_pop(
        """select column_name, min(id) // 256 * 256 as first_row, min(id) // 256 * 256 + 255 as last_row from (
  select 'f0' as column_name, a._source_row_id as id from pop a join pop b on b._source_row_id = case a._source_row_id when 700 then 1400 when 1400 then 700 else a._source_row_id end where a.f0 is distinct from b.f0
  union all select 'f4', _source_row_id from pop where _source_row_id % 1000 = 900 and f4 is not null) group by column_name"""
    ),
)
def first_difference(spark, sf_dir):
    """The table against itself with two values of one column exchanged and some of another taken away."""
    before = materialize(population(spark, sf_dir), "before")
    far = F.broadcast(before.where(F.col(ROW_ID).isin(700, 1400)).select((F.lit(2100) - F.col(ROW_ID)).alias(ROW_ID), F.struct("f0").alias("other")))  # two rows
    after = before.join(far, ROW_ID, "left").withColumn("f0", F.when(F.col("other").isNotNull(), F.col("other.f0")).otherwise(F.col("f0")))
    after = after.withColumn("f4", F.when(F.col(ROW_ID) % 1000 != 900, F.col("f4"))).select(*before.columns)
    trees = [digests.merkle_tree(df, leaf_rows=256, fan_out=16) for df in (before, after)]
    return digests.first_difference(*trees, leaf_rows=256, fan_out=16)


@query("row_group_layout", with_pop("select 'ZSTD' as codec, count(*) as rows, true as within_limit from pop"))
def row_group_layout(spark, sf_dir):
    path = new_folder(spark, "processed")
    ingest.write_parquet(population(spark, sf_dir).select(*FEATURES, *LABELS, ROW_ID), path)
    return files.layout_summary(spark, path).select("codec", "rows", (F.col("most_rows") <= ingest.ROW_GROUP).alias("within_limit"))


@query("streaming_joint_counts", with_pop("select treatment, conversion, count(*) as n from pop group by all"))
def streaming_joint_counts(spark, sf_dir):
    """The stream is run to its end; its complete output is the batch result."""
    path, name = new_folder(spark, "stream"), "joint_counts_" + new_folder(spark, "q").rsplit("-", 1)[1]
    population(spark, sf_dir).select(*FEATURES, *LABELS, ROW_ID).repartition(4, ROW_ID).write.parquet(path)
    stream = counts.joint_counts(counts.population_stream(spark, path))
    running = stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", new_folder(spark, "offsets")).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name)


# Fitted models: rows are checked, not values

BOOSTED = learners.GbmConfig()
FOREST = forest.ForestConfig()


def development(spark, sf_dir):
    df = population(spark, sf_dir)
    parts = split.SplitDataset(split.assign_split(df))
    return joins.rows_in(df, parts.train_ids()), joins.rows_in(df, parts.validation_ids())


@query("response_model")
def response_model(spark, sf_dir):
    train, validation = development(spark, sf_dir)
    return ranking.qini_summary(learners.response_model(train, validation, BOOSTED, validation))


@query("tlearner_model")
def tlearner_model(spark, sf_dir):
    train, validation = development(spark, sf_dir)
    return ranking.qini_summary(learners.t_learner(train, validation, BOOSTED, validation).withColumnRenamed("tau", "score"))


@query("xlearner_model")
def xlearner_model(spark, sf_dir):
    train, validation = development(spark, sf_dir)
    return ranking.qini_summary(learners.x_learner(train, validation, BOOSTED, validation).withColumnRenamed("tau", "score"))


@query("treatment_predictability")
def treatment_predictability(spark, sf_dir):
    return learners.treatment_predictability(population(spark, sf_dir), 5)


@query("causal_forest")
def causal_forest(spark, sf_dir):
    train, validation = development(spark, sf_dir)
    return forest.predict(validation, forest.fit(train, FOREST))


@query("leaf_support")
def leaf_support(spark, sf_dir):
    return forest.leaf_support(forest.fit(development(spark, sf_dir)[0], FOREST))


@query("jacobian_support")
def jacobian_support(spark, sf_dir):
    return forest.jacobian_support(causal_forest(spark, sf_dir))
