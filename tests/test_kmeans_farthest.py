"""K-means over all rows and farthest pairs against plain rewrites."""

from __future__ import annotations

import numpy as np
import pytest

from ordinate.operators import ann, balls, farthest, kmeans


def vectors(spark, x, labels=None):
    rows = [(i, v.tolist(), None if labels is None else int(labels[i])) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, vec array<double>, label int").repartition(5)


@pytest.mark.parametrize("spherical", [False, True])
def test_passes_equal_a_plain_rewrite(spark, spherical):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 5)) + 6 * rng.integers(0, 3, (700, 1))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if spherical else x
    c = x[:6].copy()
    got, costs = kmeans.refined(vectors(spark, x), c, 4, spherical)
    want = []
    for _ in range(4):
        d = ((x[:, None] - c) ** 2).sum(axis=2)
        want.append(d.min(axis=1).sum())
        c = np.array([x[d.argmin(axis=1) == j].mean(axis=0) if (d.argmin(axis=1) == j).any() else c[j] for j in range(6)])
        c = c / np.linalg.norm(c, axis=1, keepdims=True) if spherical else c
    assert np.allclose(got, c) and np.allclose(costs, want)


def test_train_finds_planted_centers(spark, monkeypatch):
    rng = np.random.default_rng(2)
    planted = rng.normal(size=(12, 4)) * 20
    x = np.concatenate([p + rng.normal(size=(400 if i == 0 else 40, 4)) for i, p in enumerate(planted)])
    centers, costs = kmeans.train(vectors(spark, x), 12, passes=4)
    assert len(centers) == 12 and costs == sorted(costs, reverse=True) and costs[-1] < 1.2 * 4 * len(x)
    assert max(np.linalg.norm(planted - c, axis=1).min() for c in centers) < 1.5
    monkeypatch.setattr(balls, "TRAIN_ROWS", 60)  # a small sample misses what all rows show
    sampled = balls.train_centers(vectors(spark, x), 12)
    assert costs[-1] <= kmeans.sums_of(vectors(spark, x), sampled)[2]
    assert len(kmeans.train(vectors(spark, np.ones((9, 2))), 4)[0]) == 1 and len(kmeans.train(vectors(spark, x).limit(0), 3)[0]) == 0


def test_indexes_take_passes(spark):
    x = np.random.default_rng(3).normal(size=(500, 8))
    for make in (lambda p: ann.IVF("l2", nlist=8, nprobe=8, passes=p), lambda p: ann.PQ("l2", m=8, nbits=6, nlist=8, nprobe=8, passes=p)):
        plain, more = make(0).build(vectors(spark, x)), make(2).build(vectors(spark, x))
        assert not np.allclose(plain.centers, more.centers)
        assert kmeans.sums_of(vectors(spark, x), more.centers)[2] <= kmeans.sums_of(vectors(spark, x), plain.centers)[2] * 1.001
    exact = ann.IVF("l2", nlist=8, nprobe=8, passes=2).build(vectors(spark, x)).batch(x[:5].tolist(), 3).collect()
    assert {(r["qid"], r["id"]) for r in exact if r["rank"] == 1} == {(i, i) for i in range(5)}


def brute(x, ids):
    best = None
    for i in range(len(ids)):
        for j in range(i):
            d = float(np.sqrt(((x[i] - x[j]) ** 2).sum()))
            key = (-d, min(ids[i], ids[j]), max(ids[i], ids[j]))
            best = key if best is None or key < best else best
    return best and (best[1], best[2], round(-best[0], 9))


@pytest.mark.parametrize("rows", [20, 4096])
def test_farthest_pairs(spark, rows):
    rng = np.random.default_rng(rows)
    x = np.round(rng.normal(size=(400, 3)) * [9, 1, 1], 1)
    x[300:340] = x[5]
    labels = np.r_[rng.integers(0, 5, 399), 77]
    got = {r["label"]: (r["a"], r["b"], round(r["distance"], 9)) for r in farthest.farthest_pairs(vectors(spark, x, labels), "label", rows).collect()}
    assert got == {int(g): brute(x[labels == g], np.flatnonzero(labels == g).tolist()) for g in set(labels.tolist()) if g != 77}
    whole = farthest.farthest_pairs(vectors(spark, x), ball_rows=rows).collect()
    assert [(r["by"], r["a"], r["b"], round(r["distance"], 9)) for r in whole] == [(None, *brute(x, list(range(400))))]


def test_farthest_edges(spark):
    df = spark.createDataFrame([(1, [0.0], 1), (2, [0.0], 1), (3, None, 1), (None, [9.0], 1), (5, [1.0], None), (6, [1.0], 2)], "id long, vec array<double>, label int")
    assert [tuple(r) for r in farthest.farthest_pairs(df, "label").collect()] == [(1, 1, 2, 0.0)]
    assert farthest.farthest_pairs(df.limit(0), "label").count() == 0
