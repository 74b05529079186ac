"""Trees that grow with their table, against plain scans."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinate.operators import keep, sampling, tree


def vectors(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(3)


def cloud(n, d, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + 8 * rng.integers(0, 4, (n, 1))
    x[n // 2 : n // 2 + n // 5] = x[:2][-1:]  # a fifth are copies of one point
    return x


@pytest.mark.parametrize("fan, top", [(4, 16), (8, 1024)])
def test_ball_tree(spark, tmp_path, fan, top):
    x = cloud(2500, 6, fan)
    points = vectors(spark, x)
    t = tree.BallTree.build(points, fan, f"{tmp_path}/t", top=top, file_rows=300)
    h = points.select(sampling.hashed(F.col("id")).alias("h")).toPandas()["h"].to_numpy()
    sizes = [level.count() for level in t.levels]
    assert sizes == [int((h < 4294967296 // fan ** (i + 1)).sum()) for i in range(len(sizes))] and sizes[-1] <= top  # n / fan, n / fan^2, ...
    assert t.check()
    rng = np.random.default_rng(1)
    for width in (0.05, 1.0, 100.0):
        w = rng.normal(size=6)
        s = x @ w
        lo = float(np.quantile(s, 0.4)) - 1e-6  # no score stands on the edge
        got = {r["id"]: r["score"] for r in t.stripe(w.tolist(), lo, lo + width).collect()}
        assert set(got) == set(np.flatnonzero((s >= lo) & (s <= lo + width)).tolist()) and all(abs(s[i] - v) < 1e-9 for i, v in got.items())
    far = [1.0] * 6
    active = t.descend(far, 120.0, 125.0)
    assert keep.file_bytes(t.read(active)) < 0.6 * keep.file_bytes(t.members)
    ranks = np.argsort(-(x @ far), kind="stable")
    assert int(ranks[99]) in {r["id"] for r in t.candidates(far, 100).collect()} or x[ranks[99]] @ far == x[1] @ far


def test_small_ball_trees(spark):
    for n in (0, 1, 5):
        t = tree.BallTree.build(vectors(spark, cloud(n, 2, 3)) if n else spark.createDataFrame([], "id long, vec array<double>"))
        assert t.stripe([1.0, 0.0], -1e9, 1e9).count() == n and (not n or t.check())
    odd = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (None, [1.0, 1.0])], "id long, vec array<double>")
    assert [r["id"] for r in tree.BallTree.build(odd).stripe([1.0, 0.0], -1.0, 1.0).collect()] == [1]


@pytest.mark.parametrize("leaf", [40, 400])
def test_partition_tree(spark, leaf):
    x = np.round(cloud(6000, 3, leaf), 2)
    df = spark.createDataFrame([(i, *map(float, v), f"t{i}") for i, v in enumerate(x)], "id long, a double, b double, c double, more string")
    t = tree.PartitionTree.build(df, ["a", "b", "c"], leaf_rows=leaf, file_rows=500)
    own = t.leaves.toPandas()
    single = (own.lo_a == own.hi_a) & (own.lo_b == own.hi_b) & (own.lo_c == own.hi_c)
    assert own[~single].n.max() <= leaf and own.n.sum() == 6000 and t.check() and len(own) >= 4800 / leaf
    lo, hi = [-1.0, -1.0, 7.0], [9.0, 10.0, 30.0]
    inside = np.flatnonzero(((x >= lo) & (x <= hi)).all(axis=1)).tolist()
    assert sorted(r["id"] for r in t.box(lo, hi).collect()) == inside and t.box(lo, hi).first()["more"] is not None
    w = [0.5, -1.0, 0.25]
    s = x @ w
    assert t.stripe_leaves(w, -1e9, 1e9).filter("NOT whole").isEmpty() and t.stripe(w, -1e9, 1e9).count() == t.box([-1e9] * 3, [1e9] * 3).count() == 6000
    assert sorted(r["id"] for r in t.stripe(w, -2.0003, -1.0003).collect()) == np.flatnonzero((s >= -2.0003) & (s <= -1.0003)).tolist()
    assert keep.file_bytes(t.read(t.box_leaves([-3.0] * 3, [-1.0] * 3))) < 0.6 * keep.file_bytes(t.members)


def test_cells_that_no_sample_parts(spark, monkeypatch):
    monkeypatch.setattr(tree, "SAMPLE", 20)
    rows = [(i, 1.0, 1.0) for i in range(3000)] + [(3000, 1.0, 2.0), (3001, None, 1.0), (3002, float("nan"), 1.0)]
    t = tree.PartitionTree.build(spark.createDataFrame(rows, "id long, a double, b double"), ["a", "b"], leaf_rows=100)
    assert t.check() and sorted(r["n"] for r in t.leaves.collect()) == [1, 3000]
    assert tree.PartitionTree.build(spark.createDataFrame([], "id long, a double, b double"), ["a", "b"]).box([0.0, 0.0], [1.0, 1.0]).count() == 0


@pytest.mark.parametrize("leaf", [60])
def test_inserts_equal_the_scan_after_each(spark, leaf):
    x = np.round(cloud(4000, 2, leaf), 2)
    x[3000:] += 5  # the last batch lies elsewhere
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double")
    t = tree.PartitionTree.build(df.filter("id < 1500"), ["a", "b"], leaf_rows=leaf, file_rows=400)
    first, lo, hi = t, [-1.0, 6.0], [9.5, 15.0]
    inside = lambda n: np.flatnonzero(((x[:n] >= lo) & (x[:n] <= hi)).all(axis=1)).tolist()
    for a, z in ((1500, 1510), (1510, 3000), (3000, 4000)):
        parts = t.leaves.select("first").distinct().count()
        t = t.insert(df.filter(f"id >= {a} AND id < {z}"))
        assert sorted(r["id"] for r in t.box(lo, hi).collect()) == inside(z) and t.stripe([1.0, 1.0], -1e9, 1e9).count() == z
        assert t.check() and t.leaves.filter(f"n > {leaf} AND (lo_a < hi_a OR lo_b < hi_b)").isEmpty()
        assert t.rewritten <= parts and (a > 1500 or t.rewritten + t.appended <= 10 and t.rewritten < parts)
    assert sorted(r["id"] for r in first.box(lo, hi).collect()) == inside(1500)  # the tree of before is still whole


def test_insert_into_an_empty_tree(spark):
    df = spark.createDataFrame([(i, float(i % 7), 1.0) for i in range(90)], "id long, a double, b double")
    t = tree.PartitionTree.build(df.limit(0), ["a", "b"], leaf_rows=30).insert(df)
    assert t.box([2.0, 0.0], [3.0, 2.0]).count() == sum(i % 7 in (2, 3) for i in range(90)) and t.check()
    assert t.insert(df.limit(0)).check()
