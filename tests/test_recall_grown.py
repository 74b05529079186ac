"""Recall of residual codes on a table whose best ten lie in more lists than a fixed share of them holds."""

from __future__ import annotations

import numpy as np
import pytest

from ordinate.operators import ann, balls


@pytest.mark.parametrize("train", [4000, 1000])
def test_lists_follow_the_query_and_the_table(spark, monkeypatch, train):
    monkeypatch.setattr(balls, "TRAIN_ROWS", train)  # all rows, and a quarter of them
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    queries = 2 * x[::100] + 0.1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    index = ann.PQ("l2", m=16, nbits=6, nlist=128, nprobe=8, **({"wide": 200} if hasattr(ann.PQ, "wide") else {})).build(df)
    found = index.batch(queries.tolist(), 10).collect()
    want = [set(np.argsort(((x - q) ** 2).sum(axis=1), kind="stable")[:10].tolist()) for q in queries]
    got = np.mean([len({r["id"] for r in found if r["qid"] == i} & w) / 10 for i, w in enumerate(want)])
    assert len(found) == 400 and got >= 0.9
    one = index.knn(queries[3].tolist(), 10).collect()
    assert len({r["id"] for r in one if r["rank"] <= 10} & want[3]) >= 8
