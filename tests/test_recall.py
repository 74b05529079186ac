"""Recall of the registered approximate indexes against brute force, over every query id divisible by 50."""

from __future__ import annotations

import os

import numpy as np
import pytest

from ordinate.operators import ann
from ordinate.plans import catalog

SF = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def stored(spark):
    rows = sorted((r["id"], r["vec"]) for r in catalog._emb(spark, SF).collect())
    return np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)


def brute(ids, x, queries, metric, k=10):
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    x, queries = (unit(x), unit(queries)) if metric == "cosine" else (x, queries)
    return [set(ids[np.lexsort((ids, ((x - q) ** 2).sum(axis=1)))[:k]].tolist()) for q in queries]


def transformed(x):
    q = 2 * x
    q[:, :32] += 0.1
    return q


@pytest.mark.parametrize("name", sorted(catalog.INDEXES))
def test_recall_of_lossy_indexes(spark, stored, name):
    ids, x = stored
    queries = transformed(x[ids % 50 == 0])
    index = catalog.INDEXES[name]()
    found = index.build(catalog._emb(spark, SF)).batch(queries.tolist(), 10).collect()
    want = brute(ids, x, queries, index.metric)
    assert len(queries) == 40 and len(found) == 400
    got = [len({r["id"] for r in found if r["qid"] == i} & w) / 10 for i, w in enumerate(want)]
    print(name, round(float(np.mean(got)), 4))
    assert np.mean(got) >= 0.9
    one = index.knn(queries[3].tolist(), 10).collect()  # a single query goes by the same index
    assert len(set(r["id"] for r in one if r["rank"] <= 10) & {r["id"] for r in found if r["qid"] == 3}) >= 9


def test_flat_batch(spark, stored):
    ids, x = stored
    queries = transformed(x[ids % 500 == 0])
    for metric in ("l2", "cosine"):
        found = ann.flat_batch(catalog._emb(spark, SF), queries.tolist(), 10, metric).collect()
        assert [{r["id"] for r in found if r["qid"] == i} for i in range(len(queries))] == brute(ids, x, queries, metric)


def test_recall_report_is_the_brute_force_recall(spark):
    small = "/root/testdata/sf0.001"
    rows = sorted((r["id"], r["vec"]) for r in catalog._emb(spark, small).collect())
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    queries = transformed(x[ids % 50 == 0])
    report = {r["index"]: r for r in catalog.queries()["recall_of_lossy_indexes"](spark, small).collect()}
    assert set(report) == set(catalog.INDEXES) and {r["queries"] for r in report.values()} == {len(queries)}
    for name in ("knn_ivf", "knn_pq", "knn_lsh"):
        index = catalog.INDEXES[name]()
        found = index.build(catalog._emb(spark, small)).batch(queries.tolist(), 10).collect()
        want = brute(ids, x, queries, index.metric)
        got = np.mean([len({r["id"] for r in found if r["qid"] == i} & w) / 10 for i, w in enumerate(want)])
        assert report[name]["recall"] == pytest.approx(got, abs=1e-6)
        print(name, got)
    assert min(r["recall"] for r in report.values()) >= 0.9
    print(report)
