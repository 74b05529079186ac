"""Nearest-neighbour joins of two tables, by pivots.

Every point belongs to the cell of its nearest pivot. Points in the order of (cell, distance to its pivot, id) are cut into
groups of bounded rows, so a group is one ring of a cell, or several small cells whole. What a group can be at least from a query
follows from the query's distances to the pivots: the rings' ends, and the planes half way between pivots. A query first meets the
group that is nearest by this bound; its k-th distance there then says which other groups it has to be copied to.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordinate.functions import vectors as V
from ordinate.operators import balls, keep, rank

#: Points of a group that a task holds, query rows that meet them at once, and the most groups (their bounds are broadcast).
POINTS, QUERIES, MOST_GROUPS = 16_384, 8_192, 100_000
#: An index's points are stored by tasks of POINTS rows, so that small tables have several; more rows a task beyond this many.
TASKS = 1024


def vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def meet(points: DataFrame, queries: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str, points_rows: int = POINTS, query_rows: int = QUERIES, once: bool = False) -> DataFrame:
    """fn(points, queries) of every group: points (group, id, ...) and queries (group, qid, ...) of equal group. A group of more
    points, or that more queries come to, is dealt in slices and chunks, each slice meeting each chunk in a task of its own, so
    what a task holds is bounded on both sides. Groups that no query comes to are not shuffled. once: a query meets one slice,
    by a hash, and not all."""
    points = points.select(*(F.col(c).alias(c) for c in points.columns))  # both may come from one table
    count = lambda df, rows: df.groupBy("group").agg(F.ceil(F.count("*") / rows).cast("int").alias("deal"))
    deal = keep.stored(count(points, points_rows).withColumnRenamed("deal", "slices").join(count(queries, query_rows).withColumnRenamed("deal", "chunks"), "group"))
    known = F.broadcast(deal)  # a row a group
    part = lambda column, n: F.pmod(F.xxhash64(column), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = points.join(known, "group").withColumn("slice", part("id", F.col("slices"))).withColumn("chunk", all_of("chunks")).drop("slices", "chunks")
    of = F.pmod(F.xxhash64("qid", F.lit(7)), F.col("slices")).cast("int") if once else all_of("slices")
    asked = queries.join(known, "group").withColumn("chunk", part("qid", F.col("chunks"))).withColumn("slice", of).drop("slices", "chunks")
    by = ["group", "slice", "chunk"]

    def run(p: pa.Table, q: pa.Table) -> pa.Table:
        return fn(p, q) if len(p) and len(q) else pa.table({})

    return own.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(run, schema)


def best(qid: np.ndarray, ids: np.ndarray, scores: Callable[[int, int], np.ndarray], k: int, exact: Callable[[int, np.ndarray], np.ndarray] | None = None, limit: np.ndarray | None = None, block: int = 256) -> pa.Table:
    """(qid, id, score): each query's k least, ties to the smaller id. scores(lo, hi): those of the queries lo .. hi - 1, one row
    each; infinite ones are left out. exact(query, places): what decides among those that come near the k-th. limit: what scores
    may be at most, as others are known that are no greater."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(qid), block):
        for i, s in enumerate(scores(lo, min(lo + block, len(qid))), lo):
            near = np.flatnonzero(np.isfinite(s))
            if len(near) > k:
                near = near[s[near] <= np.partition(s[near], k - 1)[k - 1] + (1e-9 * (1 + np.abs(s[near]).max()) if exact else 0)]
            own = exact(i, near) if exact else s[near]
            if limit is not None:
                near, own = near[own <= limit[i]], own[own <= limit[i]]
            order = np.lexsort((ids[near], own))[:k]
            out.append((np.full(len(order), qid[i]), ids[near[order]], own[order]))
    cols = [np.concatenate(c) if out else np.zeros(0) for c in zip(*out)] if out else [np.zeros(0)] * 3
    return pa.table({"qid": pa.array(cols[0].astype(np.int64)), "id": pa.array(cols[1].astype(np.int64)), "score": pa.array(cols[2].astype(float))})


def nearest_in(metric: str, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For `meet`: each query's k nearest of the points, vectors prepared for the metric."""

    def fn(p: pa.Table, q: pa.Table) -> pa.Table:
        x, y = vectors(p["vec"]), vectors(q["vec"])
        size = (x * x).sum(axis=1)

        def scores(lo: int, hi: int) -> np.ndarray:
            return size - 2 * y[lo:hi] @ x.T  # in the order of the distances

        def exact(i: int, at: np.ndarray) -> np.ndarray:
            return 1 - (x[at] * y[i]).sum(axis=1) if metric == "cosine" else np.sqrt(((x[at] - y[i]) ** 2).sum(axis=1))

        return best(np.asarray(q["qid"]), np.asarray(p["id"]), scores, k, exact, limits(q))

    return fn


def limits(q: pa.Table) -> np.ndarray | None:
    """The queries' limits, where they have any."""
    return np.asarray(q["limit"].fill_null(math.inf), float) if "limit" in q.column_names else None


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): each query's best k of (qid, id, score); ranks are limited before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("score", "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def prepared(df: DataFrame, key: str, metric: str) -> DataFrame:
    """(key long, vec): unit vectors for the cosine; rows with a null key or vector are left out."""
    vec = V.normalize(F.col("vec")) if metric == "cosine" else F.col("vec")
    return df.select(F.col(key).cast("long").alias(key), vec.alias("vec")).filter(F.col(key).isNotNull() & F.col("vec").isNotNull())


@dataclass
class PivotIndex:
    """points (group, id, vec, cell, far) and pieces (group, cell, lo, hi): the rings of each group."""

    points: DataFrame
    pivots: np.ndarray
    pieces: np.ndarray
    metric: str

    @classmethod
    def build(cls, points: DataFrame, metric: str = "l2", pivots: int | None = None, rows: int = POINTS, path: str | None = None, seed: int = 42) -> PivotIndex:
        """Pivots come from a bounded sample. With a path the points are written there, else to the shared folder."""
        data = prepared(points, "id", metric)
        n = data.count()
        centers = balls.train_centers(data, pivots or max(1, min(balls.MOST_BALLS, math.isqrt(max(1, n)))), seed=seed)
        size = (centers**2).sum(axis=1)
        shared = points.sparkSession.sparkContext.broadcast(centers)

        def placed(batches):
            for b in batches:
                if b.num_rows:
                    x, c = vectors(b.column(1)), shared.value
                    cell = (size - 2 * x @ c.T).argmin(axis=1)
                    far = np.sqrt(((x - c[cell]) ** 2).sum(axis=1))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(far)], names=["id", "vec", "cell", "far"])

        step = max(rows, -(-n // MOST_GROUPS))
        placed_rows = data.mapInArrow(placed, "id long, vec array<double>, cell int, far double")
        table = rank.numbered(placed_rows, ["cell", "far", "id"], min(-(-n // POINTS), max(TASKS, -(-n // keep.FILE_ROWS))), path).withColumn("group", F.expr(f"cast(ord div {step} AS int)"))
        rings = table.groupBy("group", "cell").agg(F.min("far").alias("lo"), F.max("far").alias("hi")).orderBy("group", "cell")
        pieces = np.array([tuple(r) for r in rings.collect()], float).reshape(-1, 4)  # at most MOST_GROUPS + MOST_BALLS rows
        return cls(table, centers, pieces, metric)

    def _bounds(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function from queries to what each group is at least from them. Squared sums are good to some 1e-8 of a distance,
        so bounds are made looser by more than that."""
        pivots, pieces = self.pivots, self.pieces
        size = (pivots**2).sum(axis=1)
        between = np.sqrt(np.maximum(size[:, None] + size - 2 * pivots @ pivots.T, 0))
        first = np.flatnonzero(np.r_[True, np.diff(pieces[:, 0]) != 0]) if len(pieces) else np.zeros(0, int)
        cell, lo, hi = pieces[:, 1].astype(int), pieces[:, 2], pieces[:, 3]

        def bounds(y: np.ndarray) -> np.ndarray:
            d2 = np.maximum((y * y).sum(axis=1)[:, None] + size - 2 * y @ pivots.T, 0)
            own = d2.argmin(axis=1)
            d = np.sqrt(d2)
            apart = between[own]
            plane = np.where(apart > 1e-6, (d2 - d2[np.arange(len(y)), own][:, None]) / (2 * np.maximum(apart, 1e-6)), 0)
            least = np.maximum(np.maximum(d[:, cell] - hi, lo - d[:, cell]), plane[:, cell])
            loose = 1e-6 * (1 + d[:, cell] + hi)
            return np.minimum.reduceat(np.maximum(least - loose, 0), first, axis=1)

        return bounds

    def _routed(self, queries: DataFrame, others: bool) -> DataFrame:
        """queries (qid, vec, limit) with `groups`: the nearest group, or all others that may hold a point within the limit."""
        shared = queries.sparkSession.sparkContext.broadcast(self)
        names = np.unique(self.pieces[:, 0]).astype(np.int32)
        cosine = self.metric == "cosine"

        def run(batches):
            bounds = shared.value._bounds()
            for b in batches:
                for at in range(0, b.num_rows, 64):
                    rows = b.slice(at, 64)
                    least = bounds(vectors(rows.column("vec")))
                    home = least.argmin(axis=1)
                    if others:
                        limit = np.asarray(rows.column("limit").fill_null(math.inf), float)
                        theta = np.sqrt(np.maximum(2 * limit, 0)) if cosine else limit  # of unit vectors, 1 - cos is half the squared distance
                        hit = least <= theta[:, None]
                        hit[np.arange(len(home)), home] = False
                    else:
                        hit = np.arange(len(names)) == home[:, None]
                    ends = np.r_[0, np.cumsum(hit.sum(axis=1))].astype(np.int32)
                    groups = pa.ListArray.from_arrays(pa.array(ends), pa.array(names[np.nonzero(hit)[1]]))
                    yield pa.RecordBatch.from_arrays([rows.column("qid"), rows.column("vec"), rows.column("limit"), groups], names=["qid", "vec", "limit", "groups"])

        return queries.select("qid", "vec", "limit").mapInArrow(run, "qid long, vec array<double>, limit double, groups array<int>")

    def __getstate__(self):
        return {"pivots": self.pivots, "pieces": self.pieces, "metric": self.metric, "points": None}

    def _rounds(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """What the queries find in their nearest groups, and the queries with the other groups that they still go to."""
        own = prepared(queries, "qid", self.metric).groupBy("qid").agg(F.min("vec").alias("vec"))
        asked = keep.stored(own.withColumn("limit", F.lit(None).cast("double")))
        first = keep.stored(self._met(self._routed(asked, others=False), k))
        limit = ranked(first, k).filter(F.col("rank") == k).select("qid", F.col("score").alias("limit"))
        return first, keep.stored(self._routed(asked.drop("limit").join(limit, "qid", "left"), others=True))

    def _met(self, routed: DataFrame, k: int) -> DataFrame:
        return meet(self.points.select("group", "id", "vec"), routed.select("qid", "vec", "limit", F.explode("groups").alias("group")), nearest_in(self.metric, k), "qid long, id long, score double")

    def join(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, id, score, rank): the k nearest points of every query (qid, vec), exactly; ties go to the smaller id, and all
        points are returned where there are fewer. Of rows with one qid the least vector counts; null ids and vectors take no
        part."""
        if not len(self.pieces):
            return queries.sparkSession.createDataFrame([], "qid long, id long, score double, rank int")
        first, routed = self._rounds(queries, k)
        return ranked(first.unionByName(self._met(routed, k)), k)

    def copies(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, copies): to how many groups each query goes in all."""
        return self._rounds(queries, k)[1].select("qid", (1 + F.size("groups")).alias("copies"))


def knn_join(queries: DataFrame, points: DataFrame, k: int, metric: str = "l2", **options) -> DataFrame:
    """`PivotIndex.join` of an index that is built for it."""
    return PivotIndex.build(points, metric, **options).join(queries, k)
