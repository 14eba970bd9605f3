"""Exact top-k inner product search with M-trees, best first.

The index is a metric tree on two levels.  At the top, each dimension has cells around routing vectors,
chosen from a bounded sample; every vector belongs to the cell of the routing vector nearest to it, and
every cell stores its covering radius and the length of its longest vector.  A cell's vectors are
dealt to shards of bounded size by a hash (a cell, however full, is many shards), and each shard holds an
M-tree of metric pages: a routing object, its covering radius and its distance to the routing object
of the page above, and in leaf pages the distance of each member to the page's routing object.

For a page around ``c`` with radius ``r`` and longest member ``N``, every member ``x`` has
``q.x = (|q|^2 + |x|^2 - d(q,x)^2) / 2 <= (|q|^2 + N^2 - max(0, d(q,c) - r)^2) / 2``.
A search takes the pages that are open for a query in the order of this bound, each query in its own
order.  Stored distances spare computations three times: ``|d(q,p) - d(p,c)|`` bounds ``d(q,c)`` before it is
computed, a page whose bound does not reach the query's k-th score is never opened, and
``|d(q,c) - d(c,x)|`` bounds ``d(q,x)`` for each member before its score is computed.  Queries of
a group advance together: in each round every query names its best pages, and a page that several
queries named is opened for all of them at once.

A query first searches the shard that it lies in.  The k-th score found there is its floor everywhere else:
only cells whose bound reaches it get the query at all.  Queries meet shards in groups of bounded size.
Results are exact, ties to the smaller ``vec_id``.

Each row is a vector of its own: rows that repeat a ``vec_id`` are candidates for each other, and each
such query row has its own result.  Vectors that are null or hold null or non-finite components (or ones
that 64 times themselves are not finite) take no part, nor do rows without an id.  Vectors only meet
others of their dimension; empty ones score 0.  Scores are computed exactly whatever the size of the
components; those of 2^63 or more in size count as 2^63 - 1 in size.  Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import io
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, join_checked, materialize, release

SCALE = 64
SHARD_ROWS = 16_384
GROUP_QUERIES = 1_024
SAMPLE_ROWS = 4_096  # of all dimensions together, for the routing vectors of cells
MOST_CELLS = 256  # of a dimension
PAGE = 128  # members of a leaf page
FANOUT = 12
SLACK = 1e-6
PENDING = 200_000  # candidates that wait to be merged
LEAST, GREATEST = -(1 << 63) + 1, (1 << 63) - 1

TREE_SCHEMA = "shard long, tree binary"
FOUND_SCHEMA = "quid long, query_id long, uid long, vec_id long, score long"


def _distances(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    gap = points - center
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def _bound(qq: np.ndarray, norm: np.ndarray | float, away: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """Greatest inner product with a vector of squared length ``norm`` at a distance of ``away`` or more."""
    top = (qq + norm - np.maximum(0.0, away) ** 2) / 2 + slack
    return np.maximum(np.where(np.isnan(top), np.inf, top), LEAST)  # no score is less


def far_apart(points: np.ndarray, most: int) -> tuple[list[int], np.ndarray]:
    """Rows that lie far from each other, and for every row which of them is nearest."""
    chosen = [0]
    closest = _distances(points, points[0])
    owner = np.zeros(len(points), np.int64)
    while len(chosen) < most and closest.max() > 0:
        chosen.append(int(closest.argmax()))
        away = _distances(points, points[chosen[-1]])
        nearer = away < closest
        owner[nearer], closest = len(chosen) - 1, np.minimum(closest, away)
    return chosen, owner


def build_tree(points: np.ndarray) -> dict[str, np.ndarray]:
    """Pages of an M-tree over the rows of ``points``; page 0 is the root.  ``members`` lists rows by
    leaf page, pages ``first .. first + count`` are the children of an inner page."""
    pages: list[dict] = []
    members: list[np.ndarray] = []
    near: list[np.ndarray] = []
    placed = 0

    def page(rows: np.ndarray, center: int, parent: int | None) -> dict:
        away = _distances(points[rows], points[center])
        up = 0.0 if parent is None else float(_distances(points[[center]], points[parent])[0])
        norms = np.einsum("ij,ij->i", points[rows], points[rows])
        return {"rows": rows, "away": away, "center": center, "radius": float(away.max()), "up": up, "norm": float(norms.max()), "first": 0, "count": 0, "leaf": False}

    def split(rows: np.ndarray) -> list[tuple[np.ndarray, int]]:
        chosen, owner = far_apart(points[rows], FANOUT)
        if len(chosen) == 1:  # all the same: cut evenly
            return [(part, int(part[0])) for part in np.array_split(rows, min(FANOUT, -(-len(rows) // PAGE)))]
        return [(rows[owner == k], int(rows[c])) for k, c in enumerate(chosen)]

    with np.errstate(over="ignore", invalid="ignore"):
        pages.append(page(np.arange(len(points)), 0, None))
        at = 0
        while at < len(pages):  # children stand together
            p = pages[at]
            rows = p.pop("rows")
            if len(rows) <= PAGE:
                p.update(leaf=True, first=placed, count=len(rows))
                members.append(rows)
                near.append(p.pop("away"))
                placed += len(rows)
            else:
                p.pop("away")
                children = [page(r, c, p["center"]) for r, c in split(rows)]
                p.update(first=len(pages), count=len(children))
                pages.extend(children)
            at += 1
    column = lambda name, kind: np.array([p[name] for p in pages], kind)
    return {
        "center": column("center", np.int64), "radius": column("radius", float), "up": column("up", float), "norm": column("norm", float),
        "first": column("first", np.int64), "count": column("count", np.int64), "leaf": column("leaf", bool),
        "members": np.concatenate(members), "near": np.concatenate(near),
    }


def inner_products(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers (given as floats), held within a long."""
    size = float(np.abs(queries).max(initial=0)) * float(np.abs(points).max(initial=0)) * max(1, points.shape[1])
    if size < 2**52:
        return (queries @ points.T).astype(np.int64)  # sums of integers below 2^53
    if size < 2**62:
        return queries.astype(np.int64) @ points.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(queries).astype(object) @ whole(points).astype(object).T, LEAST, GREATEST).astype(np.int64)


class Tree:
    """A built tree with its vectors, ready to be searched."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays
        self.ids, self.uids, self.points = arrays["ids"], arrays["uids"], arrays["points"]
        self.members, self.near = arrays["members"], arrays["near"]
        self.norms = np.einsum("ij,ij->i", self.points, self.points)
        #: Computed distances to routing objects and scores, and what each kind of bound has spared: routing
        #: distances by the parent's, scores in pages not opened, scores of single members.
        self.counts: Counter = Counter()
        self.below = arrays["count"].copy()  # members below each page
        for p in range(len(self.below) - 1, -1, -1):
            if not arrays["leaf"][p]:
                self.below[p] = self.below[arrays["first"][p] : arrays["first"][p] + arrays["count"][p]].sum()

    def search(self, queries: np.ndarray, k: int, own: np.ndarray, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of the query, row of the tree and score of the ``k`` best for each query; ``own`` is the
        row number that a query must not meet, ``floors`` scores below which nothing is wanted."""
        with np.errstate(over="ignore", invalid="ignore"):
            return self._search(queries.astype(float), k, own, floors)

    def _search(self, q: np.ndarray, k: int, own: np.ndarray, floors: np.ndarray | None):
        a, m = self.a, len(q)
        qq = np.einsum("ij,ij->i", q, q)
        slack = SLACK * (1.0 + qq + float(a["norm"][0]))
        floor = np.full(m, LEAST) if floors is None else floors.astype(np.int64)
        last = np.full(m, GREATEST)  # id of the k-th best
        best = [np.empty(0, np.int64)] * 3  # query, row, score
        pending: list[tuple] = []
        away = np.zeros((m, len(a["center"])))  # to the routing objects of open pages
        top = np.full(away.shape, -np.inf)  # bounds of open pages

        def merge() -> None:
            nonlocal best
            if not pending:
                return
            found = [np.concatenate(x) for x in zip(best, *pending, strict=True)]
            pending.clear()
            order = np.lexsort((self.uids[found[1]], self.ids[found[1]], -found[2].astype(float), found[0]))
            found = [x[order] for x in found]
            if (np.abs(found[2]) >= 2**53).any():  # floats do not tell these apart
                order = sorted(range(len(order)), key=lambda i: (found[0][i], -int(found[2][i]), self.ids[found[1][i]], self.uids[found[1][i]]))
                found = [x[order] for x in found]
            place = np.arange(len(order)) - np.searchsorted(found[0], found[0])
            best = [x[place < k] for x in found]
            worst = place[place < k] == k - 1
            floor[best[0][worst]], last[best[0][worst]] = best[2][worst], self.ids[best[1][worst]]

        def open_inner(page: int, rows: np.ndarray) -> None:
            for c in range(int(a["first"][page]), int(a["first"][page] + a["count"][page])):
                keep = rows[_bound(qq[rows], a["norm"][c], np.abs(away[rows, page] - a["up"][c]) - a["radius"][c], slack[rows]) >= floor[rows]]
                self.counts["routing_spared"] += len(rows) - len(keep)
                self.counts["routing"] += len(keep)
                if len(keep):
                    away[keep, c] = _distances(q[keep], self.points[a["center"][c]])
                    top[keep, c] = _bound(qq[keep], a["norm"][c], away[keep, c] - a["radius"][c], slack[keep])

        def open_leaf(page: int, rows: np.ndarray) -> None:
            s, e = int(a["first"][page]), int(a["first"][page] + a["count"][page])
            members, near = self.members[s:e], self.near[s:e]
            gap = np.abs(away[rows, page][:, None] - near[None, :])
            wanted = _bound(qq[rows][:, None], self.norms[members][None, :], gap, slack[rows][:, None]) >= floor[rows][:, None]
            some, each = wanted.any(1), wanted.any(0)
            rows, members, wanted = rows[some], members[each], wanted[some][:, each]
            self.counts["scores"] += wanted.size
            self.counts["members_spared"] += gap.size - wanted.size
            if not wanted.size:
                return
            scores = inner_products(q[rows], self.points[members])
            good = wanted & ((scores > floor[rows][:, None]) | ((scores == floor[rows][:, None]) & (self.ids[members][None, :] <= last[rows][:, None])))
            good &= self.uids[members][None, :] != own[rows][:, None]
            i, j = np.nonzero(good)
            pending.append((rows[i], members[j], scores[i, j]))
            if sum(len(p[0]) for p in pending) > PENDING:
                merge()

        self.counts["routing"] += m
        away[:, 0] = _distances(q, self.points[a["center"][0]])
        top[:, 0] = _bound(qq, a["norm"][0], away[:, 0] - a["radius"][0], slack)
        rounds, width = 0, 1
        while True:
            # Each query's best open pages that may still hold what it wants.
            live = np.nonzero(top.max(1) >= floor)[0]
            live = live[top[live].max(1) > -np.inf]
            if not len(live):
                break
            wide = min(width, top.shape[1])
            chosen = np.argpartition(-top[live], wide - 1, axis=1)[:, :wide] if wide > 1 else top[live].argmax(1)[:, None]
            rows = np.repeat(live, wide)
            pages = chosen.ravel()
            ready = (top[rows, pages] > -np.inf) & (top[rows, pages] >= floor[rows])
            rows, pages = rows[ready], pages[ready]
            by_page = np.argsort(pages, kind="stable")
            cuts = np.nonzero(np.diff(pages[by_page]))[0] + 1
            for part in np.split(by_page, cuts):
                page, mine = int(pages[part[0]]), rows[part]
                mine = mine[top[mine, page] >= floor[mine]]  # floors may have risen meanwhile
                top[mine, page] = -np.inf
                if len(mine):
                    self.counts["opened"] += self.below[page] * len(mine) if a["leaf"][page] else 0
                    (open_leaf if a["leaf"][page] else open_inner)(page, mine)
            merge()
            rounds += 1
            width = 1 if rounds < 6 else min(2 * width, 64)  # one by one at first, until floors are known
        self.counts["unopened"] += m * len(self.ids) - self.counts.pop("opened", 0)
        return best[0], best[1], best[2]


def pack(pdf: pd.DataFrame) -> bytes:
    points = _matrix(pdf["vector"])
    out = io.BytesIO()
    np.savez(out, ids=pdf["vec_id"].to_numpy(np.int64), uids=pdf["uid"].to_numpy(np.int64), points=points, **build_tree(points))
    return out.getvalue()


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), float).reshape(len(vectors), -1) if len(vectors) else np.empty((0, 0))


def unpack(blob: bytes) -> Tree:
    with np.load(io.BytesIO(blob)) as found:
        return Tree({name: found[name] for name in found.files})


def _build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": [key[0]], "tree": [pack(pdf.sort_values("uid"))]})


def _searcher(k: int):
    def search(queries: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame(columns=["quid", "query_id", "uid", "vec_id", "score"], dtype="int64")]
        for blob in trees["tree"] if len(queries) else ():
            tree = unpack(blob)
            uids, ids = queries["uid"].to_numpy(np.int64), queries["vec_id"].to_numpy(np.int64)
            floors = queries["floor"].to_numpy(np.int64) if "floor" in queries else None
            q, row, score = tree.search(_matrix(queries["vector"]), k, uids, floors)
            parts.append(pd.DataFrame({"quid": uids[q], "query_id": ids[q], "uid": tree.uids[row], "vec_id": tree.ids[row], "score": score}))
        return pd.concat(parts) if len(parts) > 1 else parts[0]

    return search


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``uid, vec_id, dim, vector``: whole numbers of the vectors that take part, and a row number."""
    v = F.col(f"`{vector_col}`")
    limit = F.lit(float(np.finfo(float).max) / SCALE)
    sound = F.forall(v, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= limit), F.lit(False)))
    times = lambda x: F.lit(float(SCALE)) * x.cast("double")
    # floor() gives longs; a double from 2^52 on is whole already.
    whole = F.transform(v, lambda x: F.when(F.abs(times(x)) < F.lit(2.0**52), F.floor(times(x)).cast("double")).otherwise(times(x)))
    part = v.isNotNull() & sound & F.col(f"`{id_col}`").isNotNull()
    return vectors.where(part).select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.size(v).alias("dim"), whole.alias("vector"))


def _pivots(rows: DataFrame, shard_rows: int) -> dict[int, np.ndarray]:
    """Routing vectors of the cells of each dimension, from ``SAMPLE_ROWS`` vectors at most."""
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(SAMPLE_ROWS).collect()}
    sample = rows.orderBy(F.xxhash64("uid", F.lit("sample")), "uid").limit(SAMPLE_ROWS).select("dim", "vector").collect()
    found = {}
    with np.errstate(over="ignore", invalid="ignore"):
        for dim, n in sizes.items():
            own = [r["vector"] for r in sample if r["dim"] == dim]
            cells = min(MOST_CELLS, -(-n // shard_rows))
            if own and dim and cells > 1:
                points = np.array(own, float)
                found[dim] = points[far_apart(points, cells)[0]]
    return found


def _place(pivots):
    """The cell of each vector, its distance to the cell's routing vector and its squared length."""

    def run(batches):
        known = pivots.value
        for batch in batches:
            cells, away, norms = [], [], []
            with np.errstate(over="ignore", invalid="ignore"):
                for dim, v in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    x = np.array(v, float)
                    norms.append(float(x @ x))
                    gaps = np.nan_to_num(_distances(known[dim], x), nan=np.inf) if dim in known else None
                    cells.append(0 if gaps is None else int(gaps.argmin()))
                    away.append(0.0 if gaps is None else float(gaps.min()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells, pa.int32()), pa.array(away, pa.float64()), pa.array(norms, pa.float64())], names=["uid", "vec_id", "dim", "vector", "cell", "away", "norm"]
            )
        release()

    return run


def _route(cells):
    """The shards, other than its own, that each query has to meet."""

    def run(batches):
        by_dim = cells.value
        for batch in batches:
            which, shards = [], []
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for i, (dim, v, own, floor) in enumerate(zip(columns[2], columns[3], columns[4], columns[5], strict=True)):
                centers, radii, norms, firsts, counts = by_dim[dim]
                x = np.array(v, float)
                with np.errstate(over="ignore", invalid="ignore"):
                    away = np.maximum(0.0, _distances(centers, x) - radii) if centers is not None else np.zeros(len(radii))
                    tops = _bound(x @ x, norms, away, SLACK * (1.0 + x @ x + norms))
                for c in np.nonzero(tops >= floor)[0]:
                    met = [s for s in range(int(firsts[c]), int(firsts[c] + counts[c])) if s != own]
                    which += [i] * len(met)
                    shards += met
            out = batch.take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([out.column(0), out.column(1), out.column(3), out.column(5), pa.array(shards, pa.int64())], names=["uid", "vec_id", "vector", "floor", "shard"])
        release()

    return run


def _meet(queries: DataFrame, trees: DataFrame, k: int, group_queries: int) -> DataFrame:
    """The ``k`` best of each query in each shard that it meets, in groups of bounded size."""
    queries = materialize(queries, "queries")
    plan = queries.groupBy("shard").agg(F.ceil(F.count("*") / group_queries).cast("int").alias("groups"))
    plan = materialize(plan, "groups")
    left = join_checked(queries, plan, "shard").withColumn("grp", F.pmod(F.xxhash64("uid", F.lit("group")), F.col("groups")).cast("int")).drop("groups")
    right = join_checked(trees, plan, "shard").select("shard", "tree", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("grp"))
    key = ["shard", "grp"]
    return materialize(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_searcher(k), FOUND_SCHEMA), "found")


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, shard_rows: int = SHARD_ROWS, group_queries: int = GROUP_QUERIES, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of all other rows for every query row.
    ``is_query`` is a condition on ``vec_id``."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = materialize(quantized(vectors, id_col, vector_col), "vectors")
    pivots = _pivots(rows, shard_rows)
    shared = spark.sparkContext.broadcast(pivots)  # SAMPLE_ROWS vectors at most
    placed = materialize(rows.mapInArrow(_place(shared), "uid long, vec_id long, dim int, vector array<double>, cell int, away double, norm double"), "placed")

    cells = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.max("norm").alias("norm"))
    sized = cells.withColumn("shards", F.ceil(F.col("n") / shard_rows).cast("int"))
    before = Window.orderBy("dim", "cell").rowsBetween(Window.unboundedPreceding, -1)
    sized = materialize(sized.withColumn("first", F.coalesce(F.sum("shards").over(before), F.lit(0)).cast("long")), "cells")  # a row for each cell
    own = F.col("first") + F.pmod(F.xxhash64("uid", F.lit("shard")), F.col("shards"))
    dealt = join_checked(placed.drop("norm", "away"), sized.select("dim", "cell", "shards", "first"), ["dim", "cell"])
    dealt = dealt.select("uid", "vec_id", "dim", "vector", own.cast("long").alias("shard"))
    trees = materialize(dealt.select("shard", "uid", "vec_id", "vector").groupBy("shard").applyInPandas(_build, TREE_SCHEMA), "trees")

    queries = materialize(dealt.where(is_query), "asked")
    home = _meet(queries.select("shard", "uid", "vec_id", "vector"), trees, k, group_queries)
    floors = home.groupBy("quid").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    asked = queries.join(floors, F.col("uid") == F.col("quid"), "left").select("uid", "vec_id", "dim", "vector", "shard", F.coalesce("floor", F.lit(LEAST)).alias("floor"))
    by_dim: dict[int, list] = {}
    for r in sized.orderBy("dim", "cell").collect():  # SAMPLE_ROWS + dimensions rows at most
        by_dim.setdefault(r["dim"], []).append((r["cell"], r["radius"], r["norm"], r["first"], r["shards"]))
    cells_of = {}
    for dim, found in by_dim.items():
        ids, *numbers = (np.array(x) for x in zip(*found, strict=True))
        cells_of[dim] = (pivots[dim][ids] if dim in pivots else None, *numbers)
    routed = asked.mapInArrow(_route(spark.sparkContext.broadcast(cells_of)), "uid long, vec_id long, vector array<double>, floor long, shard long")
    found = home.union(_meet(routed, trees, k, group_queries))
    order = Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id", "uid")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The same in SQL by comparing every query with every row.
ORACLE_SQL = f"""
with v as (
  select row_number() over () as uid, vec_id, len(embedding) as dim, list_transform(embedding, lambda x: floor({SCALE} * cast(x as double))) as w
  from embeddings where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.uid, q.vec_id as query_id, c.vec_id, cast(case when q.dim = 0 then 0 else list_inner_product(q.w, c.w) end as bigint) as score,
    row_number() over (partition by q.uid order by case when q.dim = 0 then 0 else list_inner_product(q.w, c.w) end desc, c.vec_id, c.uid) as rank
  from v q join v c on q.dim = c.dim and q.uid <> c.uid where q.vec_id % 20 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score from scored where rank <= 20
"""
