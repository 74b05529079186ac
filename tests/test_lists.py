"""Fagin and threshold over stored lists against plain loops."""

from __future__ import annotations

import numpy as np
import pytest

from ordinate.operators import keep, lists


def plain(x, w, k):
    parts = x * w
    orders = [sorted(range(len(x)), key=lambda i, j=j: (-parts[i, j], i)) for j in range(x.shape[1])]
    score = parts.sum(axis=1)
    best = sorted(range(len(x)), key=lambda i: (-round(score[i], 9), i))[k - 1]
    seen, fagin = {}, None
    for depth in range(1, len(x) + 1):
        for o in orders:
            seen[o[depth - 1]] = seen.get(o[depth - 1], 0) + 1
        if sum(v == len(orders) for v in seen.values()) >= k:
            fagin = depth
            break
    seen = set()
    for depth in range(1, len(x) + 1):
        seen |= {o[depth - 1] for o in orders}
        top = sum(parts[o[depth - 1], j] for j, o in enumerate(orders))
        if sum(score[i] >= top for i in seen) >= k:
            return best, score[best], fagin, depth
    return best, score[best], fagin, len(x)


@pytest.mark.parametrize("w, k", [((1.0, 2.0, 0.5), 7), ((1.0, -3.0, 0.25), 1), ((1.0, -3.0, 0.25), 150)])
def test_depths_and_rows(spark, w, k):
    rng = np.random.default_rng(k)
    x = rng.integers(0, 40, (500, 3)).astype(float) + (rng.integers(0, 2, (500, 1)) if k == 7 else 0)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double").repartition(4)
    own = lists.SortedLists.build(df, ["a", "b", "c"], w, ranks=32)
    best, score, fagin, ta = plain(x, np.array(w), k)
    assert [(r["id"], round(r["score"], 9), r["depth"]) for r in own.fagin(w, k).collect()] == [(best, round(score, 9), fagin)]
    assert own.read <= 3 * max(own._guess(k), 2 * fagin)  # ranks read: the first guess, or at most twice the depth
    assert [(r["id"], round(r["score"], 9), r["depth"]) for r in own.threshold(w, k).collect()] == [(best, round(score, 9), ta)]
    few = own.lists[0].filter("part <= 0")
    assert keep.file_bytes(few) < 0.5 * keep.file_bytes(own.lists[0])


def test_edges(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, 2.0, 3.0), (3, None, 1.0)], "id long, a double, b double")
    own = lists.SortedLists.build(df, ["a", "b"], (1.0, 1.0))
    assert own.fagin((1.0, 1.0), 9).first()["id"] == 2 and own.threshold((1.0, 1.0), 1).first()["id"] == 1
    with pytest.raises(ValueError):
        own.fagin((1.0, -1.0), 1)
