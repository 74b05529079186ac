"""Ball tables of several levels, certified ranks under ties, stored indexes, splits, and prepared sets."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinate.functions import vectors as V
from ordinate.operators import ann, cells, hierarchy, metrics, prep, ranges, rank, sampling
from ordinate.sources import points as P


def frame(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vec array<double>")


@pytest.mark.parametrize("branching", [2, 4])
def test_levels(spark, tmp_path, branching):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(60, 5)) * 0.1 + c for c in rng.normal(size=(8, 5)) * 3])
    h = hierarchy.Hierarchy.build(frame(spark, x).cache(), branching, balls=24, path=str(tmp_path / "m"))
    assert h.depth >= 3 and h.check()
    cover = h.coverage().collect()
    tops = [r["ball_id"] for r in cover if r["level"] == h.depth - 1]
    assert sorted(tops) == sorted(r["ball_id"] for r in cover if r["level"] == 0) and len(set(tops)) == h.index.balls.count()
    for w in ([1.0, 0, 0, 0, 0], [0.5, -2, 1, 0, 3]):
        s = x @ np.array(w)
        for lo, hi in ((-1, 1), (0.5, 2), (40, 50), (-99, 99)):
            assert sorted(r["id"] for r in h.stripe(w, lo, hi).collect()) == np.flatnonzero((s >= lo) & (s <= hi)).tolist()
    met = h.descend([1.0, 0, 0, 0, 0], -0.2, 0.2).count()
    assert met < h.index.balls.count()  # files of other balls are not read
    assert h.descend([1.0, 0, 0, 0, 0], -99, 99).filter("NOT whole").isEmpty()
    assert P.stored_bytes(spark, str(tmp_path / "m")) > 1000
    order = np.lexsort((np.arange(len(x)), -(x @ np.ones(5))))
    for k in (1, 7, 300):
        assert order[k - 1] in [r["id"] for r in h.candidates([1.0] * 5, k).collect()]


def test_certified_rank_is_narrowed(spark):
    rng = np.random.default_rng(2)
    for s in (rng.normal(size=3000), rng.integers(0, 4, 3000), np.full(3000, 5.0), np.r_[np.zeros(1500), rng.normal(size=1500)]):
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(s)], "id long, s double").cache()
        order = np.lexsort((np.arange(3000), -np.asarray(s)))
        for k in (1, 40, 700, 1500, 2999, 3000):
            r = rank.kth_certified(df, F.col("s"), k, direct=10).first()
            assert (r["id"], r["score"]) == (order[k - 1], float(s[order[k - 1]]))


def test_threshold_depth_with_many_ties(spark):
    x = np.random.default_rng(3).integers(0, 6, (900, 2))
    df = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(x)], "id long, a int, b int")
    order = np.lexsort((np.arange(900), -(x @ [2.0, 3.0])))
    for k in (1, 50, 300):
        r = rank.kth_threshold(df, ["a", "b"], [2.0, 3.0], k).first()
        assert r["score"] == float((x @ [2.0, 3.0])[order[k - 1]]) and r["depth"] <= 900


def test_stored_indexes(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(300, 8))
    df, qs = frame(spark, x).cache(), x[:6].tolist()
    for i, index in enumerate((ann.PQ("l2", m=4, nbits=5, nlist=4, nprobe=2), ann.SignHash("cosine", nbits=128, wide=50), ann.Graph("l2", m=8, part_rows=128), ann.Graph("l2", m=8, pq_m=4, pq_nbits=6))):
        rows = lambda built: sorted((r["qid"], r["id"], r["rank"]) for r in built.batch(qs, 5).collect())
        plain, path = rows(index.build(df)), str(tmp_path / str(i))
        kept = index.build(df, path)
        assert rows(kept) == plain and len(kept.knn(qs[0], 5).collect()) == 15
        kept_again = rows(kept)
        assert kept_again == plain and P.stored_bytes(spark, path) > 0


def test_samples_of_large_tables(spark):
    df = spark.range(20_000)
    plain = [r["id"] for r in df.orderBy(sampling.hashed(F.col("id")), "id").limit(100).collect()]
    assert [r["id"] for r in sampling.sample(df, 100).collect()] == plain
    same = df.select(F.lit(5).cast("long").alias("id"))
    assert sampling.sample(same, 10).count() == 10


def test_splits_and_boxes(spark):
    x = np.random.default_rng(5).normal(size=(400, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    w, t, balance = cells.best_split(df, ["a", "b"])
    left = int(((x @ np.array(w)) <= t).sum())
    assert abs(sum(v * v for v in w) - 1) < 1e-12 and abs(balance - abs(2 * left - 400) / 400) < 1e-12 and balance < 0.05
    vecs = frame(spark, x[:50])
    far = ranges.farthest_pair(vecs, F.col("vec"), "id").first()
    d = np.linalg.norm(x[:50, None] - x[None, :50], axis=2)
    assert abs(far["distance"] - d.max()) < 1e-9 and d[far["a"], far["b"]] == d.max()
    with pytest.raises(ValueError):
        ranges.farthest_pair(vecs, F.col("vec"), "id", most=10)
    big = spark.range(1).select(ranges.volume([F.lit(0.0)] * 2, [F.lit(1e200)] * 2).alias("v"), ranges.volume([F.lit(1.0), F.lit(2.0)], [F.lit(3.0), F.lit(2.5)]).alias("u")).first()
    assert big["v"] == float("inf") and abs(big["u"] - 1.0) < 1e-12
    assert metrics.split_balance(df, V.dot([F.col("a"), F.col("b")], w) <= t).first()["balance"] == balance


def test_prepared_sets(spark, tmp_path):
    d = f"{tmp_path}/tiny-2-angular"
    frame(spark, [[0, 0], [3, 4], [1, 0], [0, 2], [5, 5]]).write.parquet(f"{d}/train")
    frame(spark, [[0, 0], [0, 7]]).write.parquet(f"{d}/test")
    spark.createDataFrame([(0, [4, 1]), (1, [3, 1, 2])], "qid long, ids array<long>").write.parquet(f"{d}/neighbors")
    points, queries, near = P.load_dataset(spark, "tiny-2-angular", folder=str(tmp_path))
    assert (points.count(), queries.count(), near.count()) == (5, 2, 2)
    points, queries, near = P.load_dataset(spark, "tiny-2-angular", 3, True, str(tmp_path))
    got = sorted((r["id"], round(sum(c * c for c in r["vec"]), 9)) for r in points.collect())
    assert got == [(0, 1.0), (1, 1.0), (2, 1.0)] and queries.count() == 1
    assert all(set(r["ids"]) <= {0, 1, 2} for r in near.collect())
    assert len(P.CATALOGUE) == 6 and set(P.CATALOGUE.values()) == {"angular", "euclidean"} and P.data_dir(spark)
    people = spark.createDataFrame([(1, "x", 2.0, True)], "id int, name string, size double, own boolean")
    assert prep.feature_names(people, "id") == ["size", "name", "own"]
