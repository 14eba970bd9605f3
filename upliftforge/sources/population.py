"""Population view over the order tables: twelve features, treatment, outcomes and a dense row id.

Treatment and outcomes come from MD5 of the id, so any engine computes identical rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..roles import AUDIT_ONLY, FEATURES, LABELS, OUTCOME, ROW_ID, SECONDARY, TREATMENT


def read_table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def _draw(salt: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}|"), F.col("o_orderkey").cast("string"))), 1, 8), 16, 10).cast("long")


CUSTOMER_FEATURES, LINE_FEATURES = {"f1", "f2"}, {f"f{k}" for k in range(3, 9)}


def population(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The view, or some columns of it.  Only the tables that these come from are read and joined: an
    optimizer cannot know that the outer joins leave the rows of ``orders`` as they are."""
    wanted = set(columns if columns is not None else (ROW_ID, *FEATURES, *LABELS))
    joined = read_table(spark, sf_dir, "orders")
    if wanted & CUSTOMER_FEATURES:
        joined = joined.join(read_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    if wanted & LINE_FEATURES:
        lines = (
            read_table(spark, sf_dir, "lineitem")
            .groupBy("l_orderkey")
            .agg(
                F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("p"),
                F.avg("l_discount").alias("d"), F.avg("l_tax").alias("x"), F.max("l_quantity").alias("mx"),
            )
        )
        joined = joined.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    treated = _draw("t") % 100 < 85
    lift = F.when(treated & (F.col("o_totalprice") > 250000), 90).otherwise(0)
    flag = lambda c: F.when(c, 1).otherwise(0).cast("long")
    made = {
        ROW_ID: lambda: F.col("o_orderkey"), "f0": lambda: F.col("o_totalprice"), "f1": lambda: F.col("c_acctbal"), "f2": lambda: F.col("c_nationkey").cast("double"),
        "f3": lambda: F.col("n").cast("double"), "f4": lambda: F.col("q"), "f5": lambda: F.round("p", 2), "f6": lambda: F.round("d", 6), "f7": lambda: F.round("x", 6), "f8": lambda: F.col("mx"),
        "f9": lambda: F.year("o_orderdate").cast("double"), "f10": lambda: F.month("o_orderdate").cast("double"), "f11": lambda: F.substring("o_orderpriority", 1, 1).cast("double"),
        TREATMENT: lambda: flag(treated), OUTCOME: lambda: flag(_draw("y") % 1000 < 60 + lift), SECONDARY: lambda: flag(_draw("y") % 1000 < 200),
        AUDIT_ONLY: lambda: flag(treated & (_draw("e") % 100 < 40)),
    }
    return joined.select(*[make().alias(c) for c, make in made.items() if c in wanted])


#: The same view in DuckDB's SQL.
POPULATION_SQL = """
select o.o_orderkey as _source_row_id, o.o_totalprice as f0, c.c_acctbal as f1, cast(c.c_nationkey as double) as f2,
  cast(l.n as double) as f3, l.q as f4, round(l.p, 2) as f5, round(l.d, 6) as f6, round(l.x, 6) as f7, l.mx as f8,
  cast(extract(year from o.o_orderdate) as double) as f9, cast(extract(month from o.o_orderdate) as double) as f10,
  cast(substr(o.o_orderpriority, 1, 1) as double) as f11,
  cast(case when h.t % 100 < 85 then 1 else 0 end as bigint) as treatment,
  cast(case when h.y % 1000 < 60 + (case when h.t % 100 < 85 and o.o_totalprice > 250000 then 90 else 0 end) then 1 else 0 end as bigint) as conversion,
  cast(case when h.y % 1000 < 200 then 1 else 0 end as bigint) as visit,
  cast(case when h.t % 100 < 85 and h.e % 100 < 40 then 1 else 0 end as bigint) as exposure
from orders o
join (select o_orderkey as k, ('0x' || substr(md5('t|' || cast(o_orderkey as varchar)), 1, 8))::bigint as t,
  ('0x' || substr(md5('y|' || cast(o_orderkey as varchar)), 1, 8))::bigint as y,
  ('0x' || substr(md5('e|' || cast(o_orderkey as varchar)), 1, 8))::bigint as e from orders) h on h.k = o.o_orderkey
left join customer c on o.o_custkey = c.c_custkey
left join (select l_orderkey, count(*) n, sum(l_quantity) q, sum(l_extendedprice) p, avg(l_discount) d, avg(l_tax) x, max(l_quantity) mx
  from lineitem group by l_orderkey) l on l.l_orderkey = o.o_orderkey
"""
