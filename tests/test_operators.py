"""Small seeded inputs against brute force and known answers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinate.functions import vectors as V
from ordinate.operators import ann, balls, cells, klevel, metrics, prep, ranges, rank, sampling
from ordinate.sources import points as P

P8 = [("A", 1.0, 2.0), ("B", 3.0, 4.0), ("C", 5.0, 1.0), ("D", 2.0, 6.0), ("E", 4.0, 3.0), ("F", 6.0, 5.0), ("G", 1.5, 3.5), ("H", 4.5, 2.5)]


def ids(df, column="id"):
    return [r[column] for r in df.collect()]


@pytest.fixture(scope="module")
def p8(spark):
    return spark.createDataFrame(P8, "id string, x double, y double").cache()


def frame(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vec array<double>")


def xy():
    return [F.col("x"), F.col("y")]


def test_slabs_and_boxes(p8):
    got = lambda c: "".join(sorted(ids(p8.filter(c))))
    assert got(ranges.stripe(xy(), (1, 1), 4, 8)) == "BCDEGH"
    assert got(ranges.stripe(xy(), (2, -1), 1, 5)) == "BE"
    assert got(ranges.slabs(xy(), [((1, 1), 4, 8), ((2, -1), 1, 5)])) == "BE"
    assert got(ranges.slabs(xy(), [])) == "ABCDEFGH"
    assert got(ranges.halfspace_upper(xy(), (1, 1), 6)) == "ACG"
    assert got(ranges.halfspace_lower(xy(), (1, 1), 8)) == "DF"
    assert got(ranges.box(xy(), (2, 2), (5, 4))) == "BEH"
    with pytest.raises(ValueError):
        ranges.stripe(xy(), (1, 1), 2, 1)
    with pytest.raises(ValueError):
        V.dot(xy(), (1, 2, 3))


def test_order_and_levels(p8, spark):
    order = "FDBEHCGA"
    for k, want in enumerate(order, 1):
        for got in (rank.kth_exhaustive(p8, V.dot(xy(), (0.6, 0.8)), k), rank.kth_certified(p8, V.dot(xy(), (0.6, 0.8)), k, direct=0), rank.kth_fagin(p8, ["x", "y"], (0.6, 0.8), k), rank.kth_threshold(p8, ["x", "y"], (0.6, 0.8), k)):
            assert ids(got) == [want]
    with pytest.raises(IndexError):
        rank.kth_exhaustive(p8, F.col("x"), 9)
    assert ids(rank.kth_fagin(p8, ["x", "y"], (0.6, 0.8), 99)) == ["A"]
    assert ids(rank.kth_threshold(p8, ["x", "y"], (0.6, 0.8), 99)) == ["A"]
    points = p8.withColumnRenamed("id", "id")
    assert ids(klevel.kth_on_ray(points, 1, math.pi / 4)) == ["F"] and ids(klevel.kth_on_ray(points, 6, math.pi / 4)) == ["C"]
    table = klevel.levels(points, 3).cache()
    for angle in np.linspace(0.013, 6.2, 25):
        for k in (1, 3):
            assert ids(klevel.lookup(table, k, float(angle))) == ids(klevel.kth_on_ray(points, k, float(angle)))
    with pytest.raises(ValueError):
        klevel.levels(points, 0)


def test_certified_with_ties(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 40, 3000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, v double")
    want = sorted(range(3000), key=lambda i: (-values[i], i))
    for k in (1, 2, 700, 1500, 2999, 3000):
        assert ids(rank.kth_certified(df, F.col("v"), k, direct=5)) == [want[k - 1]]


def test_quickselect(spark):
    line = frame(spark, [[0], [1], [1], [2]])
    assert [ids(rank.quickselect(line, V.l2_distance(F.col("vec"), [0.0]), k))[0] for k in range(4)] == [0, 1, 1, 3]
    for k in (-1, 4):
        with pytest.raises(ValueError):
            rank.quickselect(line, V.l2_distance(F.col("vec"), [0.0]), k)
    axes = frame(spark, [[1, 0], [0, 1], [-1, 0]])
    assert [ids(rank.quickselect(axes, V.score(F.col("vec"), [1.0, 0.0], "cosine"), k))[0] for k in range(3)] == [0, 1, 2]
    with pytest.raises(ValueError):
        V.score(F.col("vec"), [1.0], "other")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        frame(spark, [[0, 0], [1, 0]]).select(V.cosine_distance(F.col("vec"), [1.0, 0.0])).collect()
    assert frame(spark, [[0, 0]]).select(V.cosine_distance(F.col("vec"), [1.0, 0.0], "one")).first()[0] == 1.0


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_neighbour_indexes(spark, metric):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16))
    x[11], x[12] = x[10], x[10]
    df = frame(spark, x).cache()
    q = rng.normal(size=16).tolist()
    dist = np.linalg.norm(x - q, axis=1) if metric == "l2" else 1 - x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q)
    want = sorted(range(300), key=lambda i: (dist[i], i))
    flat = ids(ann.Flat(metric).build(df).knn(q, 5))
    assert flat == want[:15]
    assert ids(ann.IVF(metric, nlist=8, nprobe=8).build(df).knn(q, 5)) == want[:15]
    for index in (ann.IVF(metric, nlist=8, nprobe=4), ann.PQ(metric, m=8, nbits=6), ann.PQ(metric, m=8, nbits=5, nlist=4, nprobe=4), ann.SignHash("cosine", nbits=512), ann.Graph(metric, m=8), ann.Graph(metric, m=8, pq_m=8, pq_nbits=6)):
        got = ids(index.build(df).knn(q, 10))
        assert len(got) == len(set(got)) == 20
        assert len(set(got) & set(want[:10])) >= (4 if metric == "l2" and isinstance(index, ann.SignHash) else 7)
    near = balls.NeighbourIndex.build(df, metric, balls=8)
    for k in (1, 20, 299):
        assert want[k - 1] in ids(near.candidates(q, k)) and ids(near.kth(q, k)) in ([want[k - 1]], [10], [11], [12])
    with pytest.raises(ValueError):
        near.candidates(q, 0)
    with pytest.raises(ValueError):
        ann.Flat("other").build(df)
    with pytest.raises(RuntimeError):
        ann.Flat("l2").knn(q, 1)


def test_codes_as_many_as_vectors_are_exact(spark):
    x = np.random.default_rng(1).normal(size=(30, 8))
    df = frame(spark, x)
    q = x[10].tolist()
    got = ids(ann.PQ("l2", m=4, nbits=5).build(df).knn(q, 5))
    assert got[0] == 10 and len(got) == 15
    assert ids(ann.Flat("l2").build(df).knn(q, 30))[0] == 10 and len(ids(ann.Flat("l2").build(df).knn(q, 30))) == 30
    assert ann.fitting_blocks(10, 8) == 5


def test_ball_and_cell_tables(spark):
    x = np.random.default_rng(4).normal(size=(400, 6))
    df = frame(spark, x).cache()
    index = balls.BallIndex.build(df, balls=12)
    for b in index.members.join(index.balls.select("ball_id", "center", "radius"), "ball_id").collect():
        assert np.linalg.norm(np.array(b["vec"]) - b["center"]) <= b["radius"] + 1e-9
    for w in ([2.0, 0, 0, 1, -1, 3], [0.1] * 6):  # of any length
        s = x @ np.array(w)
        for lo, hi in ((-1, 1), (0.5, 9), (50, 60)):
            assert sorted(ids(index.stripe(w, lo, hi))) == np.flatnonzero((s >= lo) & (s <= hi)).tolist()
    up = index.parents(3).collect()
    assert sum(r["n"] for r in up) == 400
    flat = df.select("id", *(F.col("vec")[i].alias(f"c{i}") for i in range(3)))
    table = cells.CellIndex.build(flat.filter("id < 300"), ["c0", "c1", "c2"], "id", depth=4).append(flat.filter("id >= 300"))
    assert table.check()
    s = x[:, :3] @ [1, -2, 0.5]
    assert sorted(ids(table.stripe((1, -2, 0.5), -1, 0.3))) == np.flatnonzero((s >= -1) & (s <= 0.3)).tolist()
    near = balls.fixed_balls(df, [1.0, 0, 0, 0, 0, 0], -0.2, 0.2)
    assert set(ids(near)) <= set(np.flatnonzero(np.abs(x[:, 0]) <= 0.2).tolist())


def test_sampling(spark):
    df = spark.range(500)
    assert sampling.sample(df, 50).count() == len(set(ids(sampling.sample(df, 50)))) == 50 and sampling.sample(df, 900).count() == 500
    assert ids(sampling.sample(df, 50)) == ids(sampling.sample(df.repartition(7), 50))
    assert [sampling.sample_size(16, e) for e in (1 / 16, 1 / 64, 1 / 512)] == [13, 293, 27739]
    lo, hi = rank.find_stripe(df, F.col("id").cast("double"), 1, 500, 0.01)
    assert hi == math.inf and lo < 500
    assert rank.find_stripe(df, F.col("id").cast("double"), 1, 500, 0.01, one_sided=False)[1] == 499
    z = P.zipf(spark, 2000, 2)
    assert z.filter("vec[0] < 1").isEmpty() and z.groupBy(F.col("vec")[0]).count().orderBy(F.desc("count")).first()[1] > 200


def test_preparation(spark):
    df = spark.createDataFrame([(1, 5.0, "b", 2.0), (2, None, None, 2.0), (3, 10.0, "a", 2.0)], "id int, v double, s string, c double")
    f = prep.fill_zero(df)
    assert [(r["v"], r["s"]) for r in f.orderBy("id").collect()] == [(5.0, "b"), (0.0, "0"), (10.0, "a")]
    assert [(r["v"], r["c"]) for r in prep.scale(f, ["v", "c"]).orderBy("id").collect()] == [(0.0, -1.0), (-1.0, -1.0), (1.0, -1.0)]
    coded = prep.encode_ordinal(df, ["s"], df.filter("s = 'a'"))
    assert [r["s"] for r in coded.orderBy("id").collect()] == [-1, -1, 0]
    assert [r["v"] for r in prep.fill_mean(df, ["v"]).orderBy("id").collect()] == [5.0, 7.5, 10.0]
    assert ids(prep.drop_zero_norm(frame(spark, [[0, 0], [1, 0]]))) == [1]
    v = frame(spark, [[0, 0], [3, 4]]).select(V.normalize(F.col("vec"), "one").alias("n")).collect()
    assert [list(r["n"]) for r in v] == [[0, 0], [0.6000000000000001, 0.8]] or [list(r["n"]) for r in v] == [[0, 0], [0.6, 0.8]]


def test_metrics(spark):
    a, b = spark.createDataFrame([(1,), (2,), (9,)], "id int"), spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")
    r = metrics.recall(a, b, ["id"]).first()
    assert (r["recall"], r["size_ratio"]) == (0.5, 0.75)
    assert metrics.recall(a, b.limit(0), ["id"]).first()["recall"] == 1.0
    assert metrics.same_rows(a, a) and not metrics.same_rows(a, b)


def test_csv_round_trip(spark, tmp_path):
    P.write_csv(spark.createDataFrame([(1, 2.5, "x")], "a int, b double, c string"), str(tmp_path / "o"))
    assert P.read_csv(spark, str(tmp_path / "o")).collect()[0].asDict() == {"a": 1, "b": 2.5, "c": "x"}


def test_streamed_append(spark, tmp_path):
    from ordinate.streaming import append

    x = np.random.default_rng(2).normal(size=(60, 3))
    frame(spark, x[:40]).write.parquet(str(tmp_path / "in"))
    frame(spark, x[40:]).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, vec array<double>").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = append.append_points(stream, balls.lloyd(x, 4), str(tmp_path / "m"), str(tmp_path / "b"), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert append.ball_table(spark, str(tmp_path / "b")).agg(F.sum("n")).first()[0] == 60
    assert spark.read.parquet(str(tmp_path / "m")).count() == 60
