"""The farthest pair of each group of points, exactly, by branch and bound over pairs of balls.

A sweep from any point to the farthest, and from there to the farthest again, gives each group a pair to beat. Only balls whose
centres' distance and radii could beat it are paired, and of their points only those that could with the other ball.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinate.functions import vectors as V
from ordinate.operators import balls, join, keep

#: Points of a ball, about, and the most balls of a group: pairs of a group's balls are at most half its square.
BALL, MOST = 4096, 256
SLACK = 1e-6


def _pair_of(p: pa.Table, q: pa.Table) -> pa.Table:
    """The farthest of all pairs of p and q, of equally far ones the least by ids."""
    a, b = np.asarray(p["id"]), np.asarray(q["qid"])
    x, y = join.vectors(p["vec"]), join.vectors(q["vec"])
    size, most, best = (y * y).sum(axis=1), -1.0, None
    for lo in range(0, len(x), 512):
        d = (x[lo : lo + 512] ** 2).sum(axis=1)[:, None] + size - 2 * x[lo : lo + 512] @ y.T
        d[a[lo : lo + 512, None] == b] = -1
        if d.max() < most - 1e-9 * (1 + size.max()):
            continue
        i, j = np.nonzero(d >= max(d.max(), most) - 1e-9 * (1 + size.max()))
        i, j = i[d[i, j] >= 0], j[d[i, j] >= 0]
        for at in range(0, len(i), 65_536):
            u, v = i[at : at + 65_536] + lo, j[at : at + 65_536]
            exact = ((x[u] - y[v]) ** 2).sum(axis=1)
            low, high = np.minimum(a[u], b[v]), np.maximum(a[u], b[v])
            k = np.lexsort((high, low, -exact))[0]
            if best is None or (-exact[k], low[k], high[k]) < (-most, *best):
                most, best = float(exact[k]), (int(low[k]), int(high[k]))
    rows = [(*best, float(np.sqrt(most)))] if best else []
    return pa.table({"by": p["by"][: len(rows)], **{c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate((("a", pa.int64()), ("b", pa.int64()), ("distance", pa.float64())))}})


def farthest_pairs(points: DataFrame, by: str | None = None, ball_rows: int = BALL) -> DataFrame:
    """(by, a, b, distance): of each group the two points (id, vec) farthest from each other, a < b; of equally far pairs the least
    ids. Groups of one point have no row; null ids, vectors and groups are left out. by None: one group, named null."""
    group = F.col(by) if by else F.lit("")
    data = points.select(group.cast("string").alias("by"), F.col("id").cast("long").alias("id"), "vec").filter("by IS NOT NULL AND id IS NOT NULL AND vec IS NOT NULL")
    n = data.count()
    centers = balls.train_centers(data, max(1, min(MOST, -(-n // ball_rows))))
    shared = points.sparkSession.sparkContext.broadcast(centers)

    def placed(batches):
        for b in batches:
            if b.num_rows:
                x, c = join.vectors(b.column("vec")), shared.value
                cell = balls.nearest(x, c)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt(((x - c[cell]) ** 2).sum(axis=1)))], names=["by", "id", "vec", "cell", "far"])

    table = keep.stored(data.mapInArrow(placed, "by string, id long, vec array<double>, cell int, far double"))
    kind = dict(points.dtypes)[by] if by else "string"

    def farthest_from(start: DataFrame) -> DataFrame:
        s = V.l2_distance(F.col("vec"), F.col("start"))
        return table.join(start, "by").groupBy("by").agg(F.max(F.struct(s.alias("s"), F.col("vec").alias("vec"))).alias("x")).select("by", F.col("x.vec").alias("start"), F.col("x.s").alias("least"))

    start = table.groupBy("by").agg(F.min("vec").alias("start"))
    for _ in range(2):
        start = keep.stored(farthest_from(start.select("by", "start")))
    apart = [(i, j, float(np.linalg.norm(centers[i] - centers[j]))) for i in range(len(centers)) for j in range(i, len(centers))]
    between = F.broadcast(points.sparkSession.createDataFrame(apart, "cell int, other int, apart double"))  # at most MOST^2 / 2 rows
    own = table.groupBy("by", "cell").agg(F.max("far").alias("radius"))
    pairs = own.join(between, "cell").join(own.select("by", F.col("cell").alias("other"), F.col("radius").alias("beyond")), ["by", "other"]).join(start.select("by", "least"), "by")
    pairs = keep.stored(pairs.filter(F.col("apart") + F.col("radius") + F.col("beyond") + SLACK >= F.col("least")).select("by", "cell", "other", "radius", "beyond", "least"))
    where = F.broadcast(points.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "partner int, center array<double>"))
    name = F.concat_ws("|", "cell", "other", "by").alias("group")

    def side(cell: str, partner: str, reach: str, key: str) -> DataFrame:
        some = pairs.select("by", F.col(cell).alias("own"), F.col(partner).alias("partner"), F.col(reach).alias("reach"), "least", name)
        near = table.select("by", F.col("cell").alias("own"), F.col("id").alias(key), "vec").join(some, ["by", "own"]).join(where, "partner")
        return near.filter(V.l2_distance(F.col("vec"), F.col("center")) + F.col("reach") + SLACK >= F.col("least")).select("group", key, "vec", *(["by"] if key == "id" else []))

    met = join.meet(side("cell", "other", "beyond", "id"), side("other", "cell", "radius", "qid"), _pair_of, "by string, a long, b long, distance double")
    best = met.groupBy("by").agg(F.min(F.struct((-F.col("distance")).alias("d"), "a", "b")).alias("x"))
    named = F.col("by").cast(kind) if by else F.lit(None).cast("string")
    return best.select(named.alias(by or "by"), "x.a", "x.b", (-F.col("x.d")).alias("distance"))
