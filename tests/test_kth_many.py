"""Ranks for many weights at once against sorting."""

from __future__ import annotations

import numpy as np
import pytest

from ordinate.operators import rank


@pytest.mark.parametrize("most, accuracy", [(5, 100), (10_000, 10_000)])
def test_many_weights(spark, monkeypatch, most, accuracy):
    monkeypatch.setattr(rank, "WEIGHTS", 7)
    rng = np.random.default_rng(most)
    x = np.round(rng.normal(size=(900, 2)), 1)
    x[400:700] = x[0]  # many ties
    df = spark.createDataFrame([(i * 3 + 1, *map(float, v)) for i, v in enumerate(x)] + [(0, None, 1.0)], "id long, a double, b double").repartition(3)
    asked = [(j, (float(w[0]), float(w[1])), int(k)) for j, (w, k) in enumerate(zip(rng.integers(-3, 4, (20, 2)), rng.integers(1, 901, 20)))] + [(99, (1.0, 0.0), 1), (98, (0.0, 0.0), 900)]
    got = {r["wid"]: (r["id"], r["score"]) for r in rank.kth_many(df, ["a", "b"], asked, most=most, accuracy=accuracy).collect()}
    want = {}
    for wid, w, k in asked:
        s = x[:, 0] * w[0] + x[:, 1] * w[1]
        i = np.lexsort((np.arange(900), -s))[k - 1]
        want[wid] = (int(i) * 3 + 1, float(s[i]))
    assert got == want
    with pytest.raises(IndexError):
        rank.kth_many(df, ["a", "b"], [(1, (1.0, 1.0), 901)])
