"""Steps that the indexes share: norms found once a vector, points stored by several tasks, codebooks trained in tasks."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import functions as F

from ordinate.functions import vectors as V
from ordinate.operators import ann, balls, join


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")


def test_norms_are_found_once_a_vector(spark):
    def plain(vec):  # the norm anew for each component
        return F.transform(vec, lambda v: v / F.greatest(V.norm(vec), F.lit(V.EPS_NORM)))

    vec = F.transform(F.sequence(F.lit(1), F.lit(256)), lambda i: (F.col("id") * 31 + i * 7) % 101 - 50.0)
    df = spark.range(0, 1000, 1, 4).select("id", vec.alias("vec")).cache()
    df.count()

    def seconds(unit):
        start = time.time()
        df.select(unit(F.col("vec")).alias("v")).write.format("noop").mode("overwrite").save()
        return time.time() - start

    assert seconds(V.normalize) < seconds(plain) / 3
    odd = spark.createDataFrame([(-1, [0.0, 0.0]), (-2, []), (-3, None), (-4, [1.0, None])], "id long, vec array<double>").unionByName(df)
    assert odd.select(V.normalize(F.col("vec")).alias("v"), plain(F.col("vec")).alias("p")).filter(~F.col("v").eqNullSafe(F.col("p"))).count() == 0


def test_points_are_stored_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(join, "POINTS", 100)
    x = np.random.default_rng(3).normal(size=(1000, 8))
    index = join.PivotIndex.build(table(spark, x), rows=100)
    assert len(index.points.inputFiles()) == 10
    found = index.join(table(spark, x[:20]).withColumnRenamed("id", "qid"), 3).collect()
    want = np.argsort(((x[:, None] - x[:20]) ** 2).sum(axis=2), axis=0, kind="stable")[:3].T
    assert {(r["qid"], r["id"], r["rank"]) for r in found} == {(q, int(i), n + 1) for q, w in enumerate(want) for n, i in enumerate(w)}


def test_codebooks_are_those_of_each_block(spark):
    x = np.random.default_rng(4).normal(size=(300, 12))
    books = ann._codebooks(spark, x, 6, 4)
    assert np.allclose(books, [balls.lloyd(x[:, 2 * j : 2 * j + 2], 16, seed=j) for j in range(6)], rtol=1e-12)
