"""Range predicates over linear scores and boxes, and the bounds by which cells and balls are pruned."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinate.functions import vectors as V


def stripe(vec: V.Vector, w: Sequence[float], lo: float, hi: float) -> Column:
    """lo <= w.p <= hi, both ends included; lo > hi is an error."""
    if lo > hi:
        raise ValueError("lo is above hi")
    return V.dot(vec, w).between(lo, hi)


def halfspace_upper(vec: V.Vector, w: Sequence[float], c: float) -> Column:
    return V.dot(vec, w) <= c


def halfspace_lower(vec: V.Vector, w: Sequence[float], c: float) -> Column:
    return V.dot(vec, w) >= c


def slabs(vec: V.Vector, ranges: Sequence[tuple[Sequence[float], float, float]]) -> Column:
    """All of the slabs; none given: every point."""
    return reduce(lambda a, b: a & b, (stripe(vec, *r) for r in ranges), F.lit(True))


def box(columns: Sequence[Column], lo: Sequence[float], hi: Sequence[float]) -> Column:
    """Closed box over scalar columns, so that its bounds reach the Parquet scan."""
    return reduce(lambda a, b: a & b, (c.between(x, y) for c, x, y in zip(columns, lo, hi, strict=True)))


def box_score_bounds(lo: Sequence[Column], hi: Sequence[Column], w: Sequence[float]) -> tuple[Column, Column]:
    """Least and greatest w.p over a box, by the signs of w: one term a dimension, no corners."""
    least = reduce(lambda a, b: a + b, ((a if x >= 0 else b) * F.lit(float(x)) for a, b, x in zip(lo, hi, w)))
    most = reduce(lambda a, b: a + b, ((b if x >= 0 else a) * F.lit(float(x)) for a, b, x in zip(lo, hi, w)))
    return least, most


def box_overlap(lo, hi, w, low: float, high: float) -> Column:
    """0 no point of the box is in the slab, 1 some may be, 2 all are."""
    least, most = box_score_bounds(lo, hi, w)
    return F.when((most < low) | (least > high), 0).when((least >= low) & (most <= high), 2).otherwise(1)


def boxes_meet(a_lo, a_hi, b_lo, b_hi) -> Column:
    """Closed boxes of equal dimension; differing dimensions never meet."""
    if len(a_lo) != len(b_lo):
        return F.lit(False)
    return reduce(lambda x, y: x & y, ((p <= s) & (r <= q) for p, q, r, s in zip(a_lo, a_hi, b_lo, b_hi)))


def ball_meets(center: Column, radius: Column, w: Sequence[float], lo: float, hi: float) -> Column:
    """Whether a ball may hold points of the slab, for weights of any length; with slack for rounding."""
    size = math.sqrt(sum(x * x for x in w))
    s, reach = V.dot(center, w), radius * size + F.lit(1e-9) * (1 + F.abs(radius) * size)
    return (s + reach >= lo) & (s - reach <= hi)


def in_balls(vec: Column, centers: Sequence[Sequence[float]], radii: Sequence[float]) -> Column:
    return reduce(lambda a, b: a | b, (V.l2_distance(vec, c) <= r for c, r in zip(centers, radii)), F.lit(False))


def box_of(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Bounding box and count, of all rows or of each group."""
    aggs = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]
    return df.groupBy(*by).agg(*aggs, F.count("*").alias("n"))


def union_of(boxes: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The smallest box round the boxes (lo_c, hi_c, n), of all or of each group."""
    aggs = [f(f"{n}_{c}").alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]
    return boxes.groupBy(*by).agg(*aggs, F.sum("n").alias("n"))


def volume(lo: Sequence[Column], hi: Sequence[Column]) -> Column:
    """Of a box; infinite beyond exp(700)."""
    log = log_volume(lo, hi)
    return F.when(log > 700, F.lit(float("inf"))).otherwise(F.exp(log))


def farthest_pair(rows: DataFrame, vec: Column, key: str, most: int = 1024) -> DataFrame:
    """(a, b, distance) of the two rows farthest apart, ties by keys: the seeds of a split. For the entries of an index's node,
    so more than `most` rows are an error, and the smaller key is a."""
    if rows.count() > most:
        raise ValueError(f"more than {most} rows")
    x = rows.select(F.col(key).alias("a"), vec.alias("p"))
    y = F.broadcast(rows.select(F.col(key).alias("b"), vec.alias("q")))
    far = x.join(y, F.col("a") < F.col("b")).select("a", "b", V.l2_distance(F.col("p"), F.col("q")).alias("distance"))
    return far.orderBy(F.desc("distance"), "a", "b").limit(1)


def log_volume(lo: Sequence[Column], hi: Sequence[Column]) -> Column:
    """Of a box, each side taken as 1e-10 at least."""
    return reduce(lambda a, b: a + b, (F.ln(F.greatest(b - a, F.lit(1e-10))) for a, b in zip(lo, hi)))
