"""Ball tables: centres from a bounded sample, every point with its nearest centre, true enclosing radii, so that pruning
by balls never loses a point."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinate.functions import vectors as V
from ordinate.operators import ranges, rank, sampling

#: Points that training reads on the driver, and the most centres a table has (what queries broadcast is bounded by it).
TRAIN_ROWS, MOST_BALLS = 16_384, 1024


def train_centers(points: DataFrame, k: int, rounds: int = 8, seed: int = 42, spherical: bool = False) -> np.ndarray:
    """Lloyd's algorithm on a sample of at most TRAIN_ROWS points."""
    x = np.array([r["vec"] for r in sampling.sample(points, TRAIN_ROWS, seed=seed).select("vec").collect()], float)
    return lloyd(x, k, rounds, seed, spherical)


def lloyd(x: np.ndarray, k: int, rounds: int = 8, seed: int = 42, spherical: bool = False) -> np.ndarray:
    if not len(x):
        return np.zeros((0, 0))
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))[:, None]
        c = np.where(n > 0, sums / np.maximum(n, 1), c)
        if spherical:
            c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-10)
    return c


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(axis=1) - 2 * x @ centers.T).argmin(axis=1)


def assign(points: DataFrame, centers: np.ndarray) -> DataFrame:
    """(id, vec, ball_id): each point's nearest centre, by blocks of rows in numpy."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(1).flatten(), float).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nearest(x, centers).astype(np.int32))], names=["id", "vec", "ball_id"])

    return points.select(F.col("id").cast("long"), "vec").mapInArrow(run, "id long, vec array<double>, ball_id int")


@dataclass
class BallIndex:
    """members (id, vec, ball_id), balls (ball_id, center, radius, n), and a stored sample for the rank bounds."""

    members: DataFrame
    balls: DataFrame
    sample: DataFrame
    n: int
    eps: float

    @classmethod
    def build(cls, points: DataFrame, balls: int | None = None, eps: float = 0.02, seed: int = 42, path: str | None = None, spherical: bool = False) -> BallIndex:
        """With a path the members are written there, partitioned by ball, so that pruning skips files."""
        n = points.count()
        k = balls or max(1, min(MOST_BALLS, math.isqrt(max(1, n))))
        centers = train_centers(points, k, seed=seed, spherical=spherical)
        members = assign(points, centers) if n else points.select("id", "vec", F.lit(0).alias("ball_id"))
        if path:
            members.write.mode("overwrite").partitionBy("ball_id").parquet(path)
            members = points.sparkSession.read.parquet(path)
        where = points.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "ball_id int, center array<double>")
        table = members.join(F.broadcast(where), "ball_id").groupBy("ball_id").agg(F.first("center").alias("center"), F.max(V.l2_distance(F.col("vec"), F.col("center"))).alias("radius"), F.count("*").alias("n"))
        d = len(centers[0]) if len(centers) else 1
        size = min(n, sampling.sample_size(d, eps, constant=sampling.NEIGHBOUR_CONSTANT), TRAIN_ROWS)
        return cls(members, table, sampling.sample(points, size, seed=seed), n, eps)

    def parents(self, k: int) -> DataFrame:
        """(parent_id, center, radius, n): the balls under k wider ones; a parent's radius reaches round its children's."""
        own = self.balls.collect()
        c = np.array([r["center"] for r in own])
        up = lloyd(c, k)
        rows = []
        for p, near in enumerate([np.flatnonzero(nearest(c, up) == i) for i in range(len(up))]):
            reach = max((float(np.linalg.norm(c[i] - up[p])) + own[i]["radius"] for i in near), default=0.0)
            rows.append((p, up[p].tolist(), reach, sum(own[i]["n"] for i in near)))
        return self.balls.sparkSession.createDataFrame(rows, "parent_id int, center array<double>, radius double, n long")

    def stripe(self, w: Sequence[float], lo: float, hi: float) -> DataFrame:
        """(id, score) of the points in the slab: balls that meet it, their members, then the exact test."""
        active = self.balls.filter(ranges.ball_meets(F.col("center"), F.col("radius"), w, lo, hi)).select("ball_id")
        near = self.members.join(F.broadcast(active), "ball_id", "left_semi")  # at most MOST_BALLS ids
        return near.select("id", V.dot(F.col("vec"), w).alias("score")).filter(F.col("score").between(lo, hi))

    def candidates(self, w: Sequence[float], k: int) -> DataFrame:
        """The stripe in which rank k (from 1, descending) should lie."""
        lo, hi = rank.find_stripe(self.sample, V.dot(F.col("vec"), w), k, self.n, self.eps)
        return self.stripe(w, lo, hi)

    def kth(self, w: Sequence[float], k: int) -> DataFrame:
        """(id, score) at rank k, certified: what lies above the stripe is counted, and the stripe widened if k is not in."""
        eps = self.eps
        while True:
            lo, hi = rank.find_stripe(self.sample, V.dot(F.col("vec"), w), k, self.n, eps)
            inside = self.stripe(w, lo, hi)
            above = self.stripe(w, float(np.nextafter(hi, math.inf)), math.inf).count() if hi < math.inf else 0
            if above < k <= above + inside.count():
                return rank.kth_certified(inside, F.col("score"), k - above)
            eps *= 2


@dataclass
class NeighbourIndex:
    """k-th nearest neighbour by a ball table over lifted (L2) or unit (cosine) vectors."""

    index: BallIndex
    metric: str

    @classmethod
    def build(cls, points: DataFrame, metric: str = "l2", **options) -> NeighbourIndex:
        if metric not in ("l2", "cosine"):
            raise ValueError(f"unknown metric: {metric}")
        vec = V.lift(F.col("vec")) if metric == "l2" else V.normalize(F.col("vec"), "one")
        return cls(BallIndex.build(points.select("id", vec.alias("vec")), **options), metric)

    def _query(self, q: Sequence[float], k: int) -> tuple[list[float], int]:
        if k <= 0:
            raise ValueError("k starts at 1")
        return (V.lift_query(q) if self.metric == "l2" else V.unit_query(q)), min(k, self.index.n)

    def candidates(self, q: Sequence[float], k: int) -> DataFrame:
        return self.index.candidates(*self._query(q, k)).select("id").orderBy("id")

    def kth(self, q: Sequence[float], k: int) -> DataFrame:
        return self.index.kth(*self._query(q, k)).select("id")


def fixed_balls(points: DataFrame, w: Sequence[float], lo: float, hi: float, count: int = 5, seed: int = 3) -> DataFrame:
    """(id, score): the slab's points within fixed-radius balls round centres spread over its middle plane; centres come
    from the points' box and a seed. Not all of the slab need be in a ball."""
    d = len(w)
    ends = points.agg(*(f(F.col("vec")[i]).alias(f"{n}{i}") for i in range(d) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    centers, radii = plane_centers(np.array([ends[f"lo{i}"] for i in range(d)]), np.array([ends[f"hi{i}"] for i in range(d)]), np.array(w, float), lo, hi, count, seed)
    near = points.filter(ranges.in_balls(F.col("vec"), centers.tolist(), radii.tolist()))
    return near.select("id", V.dot(F.col("vec"), w).alias("score")).filter(F.col("score").between(lo, hi))


def plane_centers(lo: np.ndarray, hi: np.ndarray, w: np.ndarray, low: float, high: float, count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    x = lo + rng.random((count, len(lo))) * (hi - lo)
    x += ((low + high) / 2 - x @ w)[:, None] * w / (w @ w)
    return x, np.full(count, float(np.linalg.norm(hi - lo)) / 2)
