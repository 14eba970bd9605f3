"""Connected components of a graph given as a table of links, without a driver-side structure.

Alternating large-star and small-star rounds.  Each round takes the least neighbour of every node
with a pre-aggregated minimum, writes it, and joins it back.  A join of two tables, unlike one with an
aggregate, can be split where it is skewed, so a node with very many links is gathered nowhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_checked, materialize


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to its least neighbour."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return join_checked(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of each node and the node itself move to the least of them."""
    least = materialize(links.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = join_checked(links, least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node with a link; ``root`` is the least node of its component.
    ``links`` has integer columns ``u, v`` in any direction; loops and repeats are harmless."""
    ordered = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = materialize(ordered, "links")
    mark = _mark(current)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        large = materialize(_large_star(current), "links")
        following = materialize(_small_star(large).distinct(), "links")
        discard(current)
        discard(large)
        current, before, mark = following, mark, _mark(following)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(current.select("v", F.col("v").alias("root")).distinct())
