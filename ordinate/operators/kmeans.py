"""K-means over all rows of a table: oversampled seeds, then passes that sum points by centre in their tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinate.operators import balls, join, sampling

#: Rounds of seeding; each draws about twice k points, and all of them come to the driver, where they get weights.
ROUNDS, OVER = 5, 2
_SUMS = "center int, n long, cost double, sums array<double>"


def _unit(c: np.ndarray) -> np.ndarray:
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-10)


def _near(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest centre, and its squared distance."""
    at = balls.nearest(x, centers)
    return at, ((x - centers[at]) ** 2).sum(axis=1)


def sums_of(points: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(n, sums, cost) of the points by their nearest centre. A task holds a sum a centre, and so does what comes to the driver."""
    shared = points.sparkSession.sparkContext.broadcast(centers)
    k, d = centers.shape

    def partial(batches):
        n, cost, sums, c = np.zeros(k, np.int64), np.zeros(k), np.zeros((k, d)), shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                x = join.vectors(b.column(0).slice(lo, 2048))
                at, far = _near(x, c)
                np.add.at(sums, at, x)
                n += np.bincount(at, minlength=k)
                cost += np.bincount(at, far, minlength=k)
        own = np.flatnonzero(n)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(0, len(own) * d + 1, d, dtype=np.int32)), pa.array(sums[own].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n[own]), pa.array(cost[own]), rows], names=["center", "n", "cost", "sums"])

    def summed(t: pa.Table) -> pa.Table:
        return pa.table({"center": t["center"][:1], "n": [int(np.asarray(t["n"]).sum())], "cost": [float(np.asarray(t["cost"]).sum())], "sums": [join.vectors(t["sums"]).sum(axis=0).tolist()]}, schema=pa.schema([("center", pa.int32()), ("n", pa.int64()), ("cost", pa.float64()), ("sums", pa.list_(pa.float64()))]))

    n, sums, cost = np.zeros(k, np.int64), np.zeros((k, d)), 0.0
    for r in points.select("vec").mapInArrow(partial, _SUMS).groupBy("center").applyInArrow(summed, _SUMS).collect():
        n[r["center"]], sums[r["center"]], cost = r["n"], r["sums"], cost + r["cost"]
    return n, sums, cost


def refined(points: DataFrame, centers: np.ndarray, passes: int, spherical: bool = False) -> tuple[np.ndarray, list[float]]:
    """(centres, costs): `passes` moves of the centres to their points' means, each by one scan, and what the points' squared
    distances summed to before each. A centre without points stays; spherical: means are put to length one."""
    costs = []
    for _ in range(passes):
        n, sums, cost = sums_of(points, centers)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
        centers = _unit(centers) if spherical else centers
        costs.append(cost)
    return centers, costs


def seeds(points: DataFrame, k: int, seed: int = 42) -> np.ndarray:
    """k centres to start with: in each of ROUNDS rounds a point is drawn with a chance in proportion to its squared distance
    from those drawn before, about OVER k in all; weighted by the points they stand for, they are brought to k on the driver."""
    first = points.orderBy(sampling.hashed(F.col("id"), seed), "id").select("vec").limit(1).collect()
    drawn = np.array([r["vec"] for r in first], float)
    for turn in range(ROUNDS if len(drawn) else 0):
        cost = sums_of(points, drawn)[2]
        if not cost:
            break
        shared = points.sparkSession.sparkContext.broadcast(drawn)
        u = (sampling.hashed(F.col("id"), seed + 1 + turn) + 0.5) / F.lit(4294967296.0)

        def chosen(batches, shared=shared, scale=OVER * k / cost):
            for b in batches:
                keep = np.zeros(b.num_rows, bool)
                for lo in range(0, b.num_rows, 2048):
                    keep[lo : lo + 2048] = np.asarray(b.column(0).slice(lo, 2048)) < scale * _near(join.vectors(b.column(1).slice(lo, 2048)), shared.value)[1]
                yield pa.RecordBatch.from_arrays([b.column(1).filter(pa.array(keep))], names=["vec"])

        more = [r["vec"] for r in points.select(u.alias("u"), "vec").mapInArrow(chosen, "vec array<double>").collect()]
        drawn = np.unique(np.concatenate([drawn, np.array(more, float).reshape(len(more), drawn.shape[1])]), axis=0)
    if len(drawn) <= k:
        return drawn
    weight = sums_of(points, drawn)[0].astype(float)
    rng = np.random.default_rng(seed)
    c = drawn[[rng.choice(len(drawn), p=weight / weight.sum())]]
    far = ((drawn - c[0]) ** 2).sum(axis=1)
    while len(c) < k and (far * weight).sum() > 0:
        c = np.r_[c, drawn[[rng.choice(len(drawn), p=far * weight / (far * weight).sum())]]]
        far = np.minimum(far, ((drawn - c[-1]) ** 2).sum(axis=1))
    for _ in range(10):
        at = balls.nearest(drawn, c)
        sums, n = np.zeros_like(c), np.bincount(at, weight, minlength=len(c))
        np.add.at(sums, at, drawn * weight[:, None])
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1e-300)[:, None], c)
    return c


def train(points: DataFrame, k: int, passes: int = 8, seed: int = 42, spherical: bool = False) -> tuple[np.ndarray, list[float]]:
    """(centres, cost before each pass and after the last) of k-means over all points (id, vec). k is small enough for its centres,
    and some ten times as many seeds, to be broadcast; fewer distinct points give fewer centres. Null vectors are left out."""
    data = join.prepared(points, "id", "cosine" if spherical else "l2")
    start = seeds(data, k, seed)
    if not len(start):
        return np.zeros((0, 0)), []
    centers, costs = refined(data, _unit(start) if spherical else start, passes, spherical)
    return centers, [*costs, sums_of(data, centers)[2]]
