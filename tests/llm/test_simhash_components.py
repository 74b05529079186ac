"""Components: joined in one task, by rounds, or by rounds and then in one task; what of it passes through the driver."""

from __future__ import annotations

import numpy as np
import pytest

from ordinate.llm import common, simhash


def graph():
    rng = np.random.default_rng(3)
    chain = [(i, i + 1) for i in range(1000, 1060)]
    star = [(2000 if i % 2 else 2000 + i, 2000 + i if i % 2 else 2000) for i in range(1, 60)]
    loose = [tuple(map(int, p)) for p in rng.integers(-300, 0, (150, 2)) if p[0] != p[1]]
    return chain + star + loose + chain[:5] + [(5, 5)]


def expected(edges):
    root = {v: v for e in edges for v in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("links", [0, 40, 10**6])
def test_components(spark, links):
    edges = graph()
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = simhash.components(df.select("a"), df, links=links).collect()
    want = expected(edges)
    assert sorted(r["id"] for r in got) == sorted(want)
    groups = lambda pairs: sorted(map(sorted, {r: [i for i, x in pairs if x == r] for _, r in pairs}.values()))
    assert groups([(r["id"], r["root"]) for r in got]) == groups(list(want.items()))


def test_size_estimates_do_not_grow_by_rounds(spark, monkeypatch):
    plain, digits = common.stored, []

    def watched(df):
        digits.append(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        assert digits[-1] < 1500, digits
        return plain(df)

    monkeypatch.setattr(common, "stored", watched)
    df = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    found = simhash.components(df.select("a"), df, **({"links": 0} if "links" in simhash.components.__code__.co_varnames else {}))
    assert found.select("root").distinct().count() == 1 and found.count() == 61 and len(digits) > 15


def test_few_links_need_no_lookups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "looked_up", None)  # each would be a broadcast by the driver, or a join
    df = spark.createDataFrame(graph(), "a long, b long")
    assert simhash.components(df.select("a"), df).count() == len(expected(graph()))
    assert simhash.components(df.select("a"), df.filter("a > 10000")).count() == 0


def test_large_lookups_are_not_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, right = spark.range(100_000).selectExpr("id", "id % 70000 AS k"), spark.range(50_000).selectExpr("id AS k", "id AS v")
        found = simhash.looked_up(left, right, "k", 50_000)
        assert found.filter("v = k").count() == 80_000 and found.filter("v IS NULL").count() == 20_000
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "rightHint=(strategy=broadcast)" not in plan.split("__salt")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_table_that_grows_is_broadcast(spark):
    """By their estimates, which are small here, all of these joins would be."""
    docs = spark.range(60).selectExpr("id AS doc_id", "concat('w', id, ' end of ', id * id) AS text")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    prints = simhash.fingerprints(docs).select("fp").distinct()
    assert "BroadcastHashJoin" not in plan(simhash.links(prints)) and "SortMergeJoin" in plan(simhash.links(prints))
    many = simhash.FEW + 1
    found = plan(simhash.looked_up(docs.withColumnRenamed("text", "k"), docs.select(docs.text.alias("k"), docs.doc_id.alias("v")), "k", many))
    assert found.count("SortMergeJoin") == 1 and found.count("BroadcastHashJoin") == 2  # the frequent keys alone, for either side


def test_kept_ids_are_not_broadcast(spark):
    docs = spark.range(60).selectExpr("id AS doc_id", "concat('w', id, ' end of ', id * id) AS text")
    plan = simhash.keep_first(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [__id" in plan and "BroadcastHashJoin [__id" not in plan
