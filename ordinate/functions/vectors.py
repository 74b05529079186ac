"""Column expressions over vectors: arrays of doubles, or lists of scalar columns (cheaper: they stay in codegen)."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Column | Sequence[Column]
EPS_NORM = 1e-10


def lit_vector(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def as_vec(*columns: str | Column) -> Column:
    """Scalar columns as one array of doubles (build it late: pruning and pushdown work on the scalars)."""
    return F.array(*((F.col(c) if isinstance(c, str) else c).cast("double") for c in columns))


def dot(vec: Vector, w: Sequence[float] | Column) -> Column:
    """Inner product. Scalar columns with a literal weight list unroll to plain arithmetic."""
    if isinstance(vec, (list, tuple)):
        return reduce(lambda a, b: a + b, (c.cast("double") * F.lit(float(x)) for c, x in zip(vec, w, strict=True)))
    other = w if isinstance(w, Column) else lit_vector(w)
    return F.aggregate(F.zip_with(vec, other, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def random_unit(d: int, seed: int = 42) -> list[float]:
    """A unit vector, uniform over directions, the same for a seed."""
    rng = random.Random(seed)
    x = [rng.gauss(0.0, 1.0) for _ in range(d)]
    size = math.sqrt(sum(v * v for v in x))
    return [v / size for v in x]


def norm(vec: Column) -> Column:
    return F.sqrt(dot(vec, vec))


def l2_distance(vec: Column, q: Sequence[float] | Column) -> Column:
    other = q if isinstance(q, Column) else lit_vector(q)
    return F.sqrt(F.aggregate(F.zip_with(vec, other, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(vec: Column, q: Sequence[float] | Column, zero: str = "raise") -> Column:
    """1 - cos. zero: "raise" (an ANSI division error), "null", or "one" (a zero vector is at distance 1)."""
    other = q if isinstance(q, Column) else lit_vector(q)
    size = norm(vec) * norm(other)
    if zero == "raise":
        return 1 - dot(vec, other) / size
    out = 1 - F.try_divide(dot(vec, other), size)
    return out if zero == "null" else F.coalesce(out, F.lit(1.0))


def score(vec: Column, q: Sequence[float], metric: str) -> Column:
    if metric in ("l2", "euclidean"):
        return l2_distance(vec, q)
    if metric in ("cosine", "angular"):
        return cosine_distance(vec, q)
    raise ValueError(f"unknown metric: {metric}")


def normalize(vec: Column, policy: str = "floor") -> Column:
    """Unit vectors. Zero vectors: "one" leaves them as they are, "floor" divides by at least 1e-10."""
    n = norm(vec)
    by = F.when(n == 0, F.lit(1.0)).otherwise(n) if policy == "one" else F.greatest(n, F.lit(EPS_NORM))
    return F.zip_with(vec, F.array_repeat(by, F.size(vec)), lambda x, n: x / n)  # in a lambda the norm would be found anew for each component


def lift(vec: Column) -> Column:
    """The squared norm as one more coordinate: nearest by L2 becomes largest by inner product."""
    return F.concat(vec, F.array(dot(vec, vec)))


def lift_query(q: Sequence[float]) -> list[float]:
    out = [2.0 * x for x in q] + [-1.0]
    size = math.sqrt(sum(x * x for x in out))
    return [x / size for x in out]


def unit_query(q: Sequence[float]) -> list[float]:
    size = math.sqrt(sum(x * x for x in q))
    if size == 0:
        raise ValueError("the query has norm zero")
    return [x / size for x in q]


def dual_line(x: Column, y: Column) -> Column:
    """The point (a, b) as the line a x + b y = 1."""
    return F.struct(x.alias("a"), y.alias("b"), F.lit(-1.0).alias("c"))


def side(vec: Vector, w: Sequence[float], const: float) -> Column:
    """On which side of the hyperplane w.x = const: -1, 0, 1."""
    return F.signum(dot(vec, w) - const)


def nearest_power_fraction(x: Column, most: int = 19) -> Column:
    """Of 2^-1 .. 2^-most the nearest to x, the larger of two equally near."""
    options = F.array(*(F.struct(F.abs(x - F.lit(2.0**-i)).alias("gap"), F.lit(i).alias("i"), F.lit(2.0**-i).alias("v")) for i in range(1, most + 1)))
    return F.array_min(options)["v"]


def metric_name(label: Column, name: Column) -> Column:
    """angular if the stored label says so, or, without a label, the dataset's name does; else euclidean."""
    told = F.lower(F.trim(label))
    return F.when(F.coalesce(told == "angular", F.lower(name).contains("angular")), F.lit("angular")).otherwise(F.lit("euclidean"))


def angle_of(y: Column, x: Column) -> Column:
    """In [0, 2 pi)."""
    return F.pmod(F.atan2(y, x), F.lit(2 * math.pi))
