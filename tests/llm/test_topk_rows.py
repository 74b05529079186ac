"""Exact top-k with repeated ids, repeated rows, scores beyond a long, and enough shards for every round."""

from __future__ import annotations

import numpy as np
import pytest

from ordinate.llm import topk

LONG = 2**63


def brute(data, k=10):
    whole = [(i, [int(np.floor(x * 1024)) if abs(x) < 2.0**52 else int(x) * 1024 for x in v]) for i, v in data]
    out = []
    for row, (i, q) in enumerate(whole):
        if i % 100 == 0:
            rest = [(-min(LONG - 1, max(-LONG, sum(a * b for a, b in zip(q, v)))), j) for other, (j, v) in enumerate(whole) if other != row and len(v) == len(q)]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(rest)[:k], 1)]
    return sorted(out)


def ours(spark, data, **options):
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, df.filter("vec_id % 100 = 0"), **options).collect())


def test_repeated_ids_and_rows(spark):
    rng = np.random.default_rng(3)
    data = [(int(rng.integers(0, 40)) * 50, [float(x) for x in rng.normal(size=4).round(1)]) for _ in range(300)]
    data += [(100, [1.0, 0.0, 0.0, 0.0]), (100, [0.0, 1.0, 0.0, 0.0]), *[(200, [0.5, 0.5, -0.0, 0.0])] * 15, (200, [0.5, 0.5, 0.0, 0.0])]
    assert ours(spark, data, leaf=8, shard_rows=40, block_queries=7) == brute(data)


def test_scores_beyond_a_long(spark):
    big = [3e30, 1.0, -2.5e15, 7e307, -1e18]
    data = [(i, [big[i % 5], float(i), big[(i * 3 + 1) % 5]]) for i in range(0, 250, 10)] + [(i, [float(i) * 1e6, 1e9 + i, 0.25]) for i in range(300, 330)] + [(400, [1e6, 2e9, -3e3])]
    assert ours(spark, data, leaf=4, shard_rows=16, block_queries=3) == brute(data)


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_many_shards(spark, spread):
    """Clusters, so that bounds leave shards out; and none."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(30, 8)) * 3
    data = [(i, [float(x) for x in centers[i % 30] + rng.normal(size=8) * spread]) for i in range(2400)]
    assert ours(spark, data, leaf=16, shard_rows=60, block_queries=5) == brute(data)
    few = ours(spark, data[:7], leaf=16)
    assert few == brute(data[:7]) and len(few) == 6


def test_session_settings_stay(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    ours(spark, [(0, [1.0]), (1, [2.0])])
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
