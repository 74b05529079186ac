"""The nearest-neighbour join against all distances."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinate.operators import join


def frame(spark, x, key):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{key} long, vec array<double>")


def brute(x, q, k, metric):
    if metric == "cosine":
        x, q = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-10) for v in (x, q))
    out = []
    for i, y in enumerate(q):
        s = 1 - x @ y if metric == "cosine" else np.sqrt(((x - y) ** 2).sum(axis=1))
        out += [(i, int(j), r + 1, round(float(s[j]), 8)) for r, j in enumerate(np.lexsort((np.arange(len(x)), np.round(s, 12)))[:k])]
    return sorted(out)


def found(df):
    return sorted((r["qid"], r["id"], r["rank"], round(r["score"], 8)) for r in df.collect())


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("d", [2, 24])
def test_join_equals_all_distances(spark, metric, d):
    rng = np.random.default_rng(d)
    x = np.round(rng.normal(size=(3000, d)) + 6 * rng.integers(0, 3, (3000, 1)), 1 if d == 2 and metric == "l2" else 9)
    x[2000:2400] = x[0]  # many copies of one point
    q = np.r_[x[::60] + 0.01 * rng.normal(size=(50, d)), x[:1], rng.normal(size=(3, d)) * 50]
    points, queries = frame(spark, x, "id").repartition(3), frame(spark, q, "qid")
    index = join.PivotIndex.build(points, metric, pivots=30, rows=200)
    assert len(np.unique(index.pieces[:, 0])) >= 12 and index.points.groupBy("group").count().agg(F.max("count")).first()[0] <= 600
    assert found(index.join(queries, 7)) == brute(x, q, 7, metric)
    if d == 2 and metric == "l2":  # clustered: most groups are left out
        assert index.copies(queries.filter("qid < 50"), 7).agg(F.avg("copies")).first()[0] < len(np.unique(index.pieces[:, 0])) / 2


def test_slices_and_chunks(spark):
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(900, 5)), rng.normal(size=(300, 5))
    p = frame(spark, x, "id").withColumn("group", (F.col("id") % 2).cast("int"))
    asked = frame(spark, q, "qid").withColumn("group", F.explode(F.array(F.lit(0), F.lit(1), F.lit(9))))
    got = join.ranked(join.meet(p, asked, join.nearest_in("l2", 4), "qid long, id long, score double", points_rows=100, query_rows=64), 4)
    assert found(got) == brute(x, q, 4, "l2")


def test_edges(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (None, [0.0, 0.0])], "id long, vec array<double>")
    q = spark.createDataFrame([(5, [1.0, 2.0]), (5, [1.0, 2.0]), (6, None), (None, [1.0, 1.0]), (7, [4.0, 6.0])], "qid long, vec array<double>")
    assert found(join.knn_join(q, one, 3)) == [(5, 1, 1, 0.0), (7, 1, 1, 5.0)]
    assert join.knn_join(q, one.limit(0), 3).count() == 0 and join.knn_join(q.limit(0), one, 3).count() == 0
