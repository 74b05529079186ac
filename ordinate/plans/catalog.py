"""Registered queries of the engine, each over its whole tables, and the SQL that checks them.

An exact or certified operator must equal the plain full scan, so queries by an index share the SQL of their scan.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordinate.functions import vectors as V
from ordinate.operators import ann, balls, cells, farthest, hierarchy, join, keep, kmeans, klevel, lists, metrics, prep, ranges, rank, sampling, tree
from ordinate.sources import points as P

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

W2 = (12.5, -0.75)  # weights of (p_size, p_retailprice)
WP = (20.0, 0.5)
W4 = [0.3 * math.cos(i) for i in range(64)]  # a direction for the 64-d vectors


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _part(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_retailprice")


def _emb(spark, d):
    return P.read_vectors(spark, f"{d}/embeddings.parquet", "vec_id", "embedding")


def _q(spark, d, vec_id: int = 7) -> list[float]:
    """A query: a stored row's vector, doubled and shifted in its first half so that metrics differ."""
    return _shifted(_emb(spark, d).filter(F.col("id") == vec_id).first()["vec"])


def _shifted(v) -> list[float]:
    return [2 * x + (0.1 if i < 32 else 0.0) for i, x in enumerate(v)]


PC = ["p_size", "p_retailprice"]
_COLS = [F.col, "p_size", "p_retailprice"]


def _cols():
    return [F.col(c) for c in PC]


def _score(w, alias: str = "score"):
    return F.round(V.dot(_cols(), w), 6).alias(alias)


_E = "SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings"
_QV = "(SELECT list_transform(embedding::DOUBLE[], lambda x, i: 2 * x + CASE WHEN i <= 32 THEN 0.1 ELSE 0.0 END) AS q FROM embeddings WHERE vec_id = 7)"
_L2 = "list_distance(vec, q)"
_COS = "(1 - list_dot_product(vec, q) / (sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(q, q))))"
_S2 = "(p_size * 12.5 + p_retailprice * -0.75)"
_SP = "(p_size * 20.0 + p_retailprice * 0.5)"
_W4 = "[" + ", ".join(repr(x) for x in W4) + "]::DOUBLE[]"


# Ranges ---------------------------------------------------------------------------------------------------------------

_STRIPE = f"SELECT p_partkey AS id, round({_S2}, 6) AS score FROM part WHERE {_S2} BETWEEN -500.0003 AND -300.0003"
_SLAB = (-500.0003, -300.0003)


@query(_STRIPE)
def stripe_filter(spark, d):
    return _part(spark, d).filter(ranges.stripe(_cols(), W2, *_SLAB)).select("id", _score(W2))


@query(f"SELECT p_partkey AS id, round({_S2}, 6) AS score FROM part WHERE {_S2} <= -500.0003")
def halfspace_upper(spark, d):
    return _part(spark, d).filter(ranges.halfspace_upper(_cols(), W2, -500.0003)).select("id", _score(W2))


@query(f"SELECT p_partkey AS id, round({_S2}, 6) AS score FROM part WHERE {_S2} >= -200.0003")
def halfspace_lower(spark, d):
    return _part(spark, d).filter(ranges.halfspace_lower(_cols(), W2, -200.0003)).select("id", _score(W2))


@query(f"SELECT p_partkey AS id FROM part WHERE {_S2} BETWEEN -900.0003 AND -300.0003 AND {_SP} BETWEEN 900.0003 AND 1500.0003")
def slab_intersection(spark, d):
    return _part(spark, d).filter(ranges.slabs(_cols(), [(W2, -900.0003, -300.0003), (WP, 900.0003, 1500.0003)])).select("id")


_BOX = "SELECT p_partkey AS id, p_size, p_retailprice FROM part WHERE p_size BETWEEN 10 AND 30 AND p_retailprice BETWEEN 950.0 AND 1400.0"


@query(_BOX)
def box_range(spark, d):
    return _part(spark, d).filter(ranges.box(_cols(), (10, 950.0), (30, 1400.0)))


@query(_BOX)
def cell_pruned_box(spark, d):
    return cells.CellIndex.build(_part(spark, d), PC, "id").box((10, 950.0), (30, 1400.0)).select("id", *PC)


@query(_STRIPE)
def cell_pruned_stripe(spark, d):
    return cells.CellIndex.build(_part(spark, d), PC, "id").stripe(W2, *_SLAB).select("id", _score(W2))


_EMB_STRIPE = f"SELECT id, round(list_dot_product(vec, {_W4}), 6) AS score FROM ({_E}) WHERE list_dot_product(vec, {_W4}) BETWEEN -0.1000003 AND 0.2000003"


@query(_EMB_STRIPE)
def vector_stripe(spark, d):
    return _emb(spark, d).filter(ranges.stripe(F.col("vec"), W4, -0.1000003, 0.2000003)).select("id", F.round(V.dot(F.col("vec"), W4), 6).alias("score"))


@query(_EMB_STRIPE)
def ball_pruned_stripe(spark, d):
    return balls.BallIndex.build(_emb(spark, d)).stripe(W4, -0.1000003, 0.2000003).select("id", F.round("score", 6).alias("score"))


_CENTERS = [[0.1 * math.sin(i + j) for i in range(64)] for j in range(5)]


@query(f"SELECT id FROM ({_E}) WHERE list_dot_product(vec, {_W4}) BETWEEN -0.1000003 AND 0.2000003 AND (" + " OR ".join(f"list_distance(vec, [{', '.join(map(repr, c))}]::DOUBLE[]) <= 1.1000003" for c in _CENTERS) + ")")
def ball_union_range(spark, d):
    return _emb(spark, d).filter(ranges.stripe(F.col("vec"), W4, -0.1000003, 0.2000003) & ranges.in_balls(F.col("vec"), _CENTERS, [1.1000003] * 5)).select("id")


@query(f"SELECT id, round({_L2}, 6) AS score FROM ({_E}), {_QV} WHERE {_L2} <= 2.2000003")
def radius_search(spark, d):
    q = _q(spark, d)
    return _emb(spark, d).select("id", V.l2_distance(F.col("vec"), q).alias("s")).filter("s <= 2.2000003").select("id", F.round("s", 6).alias("score"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND a.p_size = b.p_size AND abs(a.p_retailprice - b.p_retailprice) <= 2.000003")
def radius_join(spark, d):
    """Fixed-radius neighbours of one size: points that differ meet once, each with its ids in rows of bounded lists; only pairs that
    are near are made from the lists, so the work is that of the result."""
    r, ids = 2.000003, 1024
    w = Window.partitionBy("p_size", "p_retailprice").orderBy("id")
    p = _part(spark, d).withColumn("part", F.floor((F.row_number().over(w) - 1) / ids))
    p = p.groupBy("p_size", "p_retailprice", "part").agg(F.collect_list("id").alias("ids"))
    # buckets wider than r by more than rounding: a price and one that is up to r above it are in the same or in neighbouring ones
    p = p.withColumn("bucket", F.floor(F.col("p_retailprice") / (1.001 * r)).cast("long"))
    a = p.select("p_size", F.col("p_retailprice").alias("x"), F.col("part").alias("m"), F.col("ids").alias("own"), F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    b = p.select("p_size", F.col("p_retailprice").alias("y"), F.col("part").alias("n"), F.col("ids").alias("others"), "bucket")
    # a stated number is not coalesced: these tables are small, what they become is not
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    a, b = (t.repartition(n, "p_size", "bucket") for t in (a, b))
    met = a.join(b.hint("merge"), ["p_size", "bucket"]).filter((F.abs(F.col("x") - F.col("y")) <= r) & ((F.col("x") < F.col("y")) | ((F.col("x") == F.col("y")) & (F.col("m") <= F.col("n")))))
    one = ((F.col("x") == F.col("y")) & (F.col("m") == F.col("n"))).alias("one")
    pairs = met.select(one, F.explode("own").alias("i"), "others").select("one", "i", F.explode("others").alias("j"))
    return pairs.filter((F.col("i") < F.col("j")) | (~F.col("one") & (F.col("i") > F.col("j")))).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))


@query("SELECT p_brand, min(p_size) AS lo_p_size, max(p_size) AS hi_p_size, min(p_retailprice) AS lo_p_retailprice, max(p_retailprice) AS hi_p_retailprice, count(*) AS n FROM part GROUP BY p_brand")
def bbox_agg(spark, d):
    return ranges.box_of(_t(spark, d, "part"), PC, ["p_brand"])


_BB = "(SELECT p_brand, min(p_size) AS a, max(p_size) AS b, min(p_retailprice) AS c, max(p_retailprice) AS e FROM part GROUP BY p_brand)"


@query(f"""SELECT p_brand, round(12.5 * a - 0.75 * e, 6) AS least, round(12.5 * b - 0.75 * c, 6) AS most,
  CASE WHEN 12.5 * b - 0.75 * c < -740.0003 OR 12.5 * a - 0.75 * e > -300.0003 THEN 0 WHEN 12.5 * a - 0.75 * e >= -740.0003 AND 12.5 * b - 0.75 * c <= -300.0003 THEN 2 ELSE 1 END AS meets,
  round(ln(greatest(b - a, 1e-10)) + ln(greatest(e - c, 1e-10)), 6) AS log_volume FROM {_BB}""")
def box_slab_overlap(spark, d):
    b = ranges.box_of(_t(spark, d, "part"), PC, ["p_brand"])
    lo, hi = [F.col(f"lo_{c}") for c in PC], [F.col(f"hi_{c}") for c in PC]
    least, most = ranges.box_score_bounds(lo, hi, W2)
    return b.select("p_brand", F.round(least, 6).alias("least"), F.round(most, 6).alias("most"), ranges.box_overlap(lo, hi, W2, -740.0003, -300.0003).alias("meets"), F.round(ranges.log_volume(lo, hi), 6).alias("log_volume"))


@query(f"SELECT x.p_brand AS a, y.p_brand AS b FROM {_BB} x JOIN {_BB} y ON x.p_brand < y.p_brand AND x.a <= y.b AND y.a <= x.b AND x.c <= y.e AND y.c <= x.e")
def box_overlap_join(spark, d):
    b = ranges.box_of(_t(spark, d, "part"), PC, ["p_brand"])
    x, y = (b.select(*(F.col(c).alias(f"{s}_{c}") for c in b.columns)) for s in "xy")
    meet = ranges.boxes_meet(*([F.col(f"{s}_{e}_{c}") for c in PC] for s, e in (("x", "lo"), ("x", "hi"), ("y", "lo"), ("y", "hi"))))
    return x.join(y, (F.col("x_p_brand") < F.col("y_p_brand")) & meet).select(F.col("x_p_brand").alias("a"), F.col("y_p_brand").alias("b"))


@query(f"SELECT p_partkey AS id, CAST(sign({_S2} + 400.0003) AS DOUBLE) AS side FROM part")
def split_side(spark, d):
    return _part(spark, d).select("id", V.side(_cols(), W2, -400.0003).alias("side"))


@query("SELECT count(*) FILTER (p_size <= 20) AS n_left, count(*) FILTER (p_size > 20) AS n_right, round(abs(count(*) FILTER (p_size <= 20) - count(*) FILTER (p_size > 20)) / count(*), 9) AS balance FROM part")
def split_balance(spark, d):
    return metrics.split_balance(_part(spark, d), F.col("p_size") <= 20).withColumn("balance", F.round("balance", 9))


@query("SELECT quantile_cont(p_retailprice, 0.3) AS q30, quantile_cont(p_retailprice, 0.5) AS q50, quantile_cont(p_retailprice, 0.7) AS q70 FROM part")
def quantile_splits(spark, d):
    return _part(spark, d).agg(*(F.percentile("p_retailprice", x / 100).alias(f"q{x}") for x in (30, 50, 70)))


# Ranks ----------------------------------------------------------------------------------------------------------------


def _kth_sql(k: int, s: str = _SP) -> str:
    return f"SELECT p_partkey AS id, round({s}, 6) AS score FROM part ORDER BY {s} DESC, p_partkey LIMIT 1 OFFSET {k - 1}"


def _r(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"))


@query(_kth_sql(37))
def kth_exhaustive(spark, d):
    return _r(rank.kth_exhaustive(_part(spark, d), V.dot(_cols(), WP), 37))


_LISTS: dict[tuple[str, str], lists.SortedLists] = {}


def _sorted_lists(spark, d) -> lists.SortedLists:
    """The parts' sorted lists: stored once in a session, read by all its queries."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _LISTS:
        _LISTS[key] = lists.SortedLists.build(_part(spark, d), PC, WP)
    return _LISTS[key]


@query(_kth_sql(23))
def kth_fagin(spark, d):
    return _r(_sorted_lists(spark, d).fagin(WP, 23))


@query(_kth_sql(23))
def kth_ta(spark, d):
    return _r(_sorted_lists(spark, d).threshold(WP, 23))


_RANKS = f"SELECT p_partkey AS id, {_SP} AS s, row_number() OVER (ORDER BY p_size * 20.0 DESC, p_partkey) AS r1, row_number() OVER (ORDER BY p_retailprice * 0.5 DESC, p_partkey) AS r2, p_size * 20.0 AS c1, p_retailprice * 0.5 AS c2 FROM part"


@query(f"SELECT greatest(r1, r2)::INTEGER AS depth FROM ({_RANKS}) ORDER BY 1 LIMIT 1 OFFSET 22")
def fagin_depth(spark, d):
    return _sorted_lists(spark, d).fagin(WP, 23).select("depth")


@query(f"""WITH r AS ({_RANKS}), t AS (SELECT a.r1 AS x, a.c1 + b.c2 AS threshold FROM r a JOIN r b ON a.r1 = b.r2)
SELECT min(x)::INTEGER AS depth FROM (SELECT t.x FROM t JOIN r ON least(r.r1, r.r2) <= t.x AND r.s >= t.threshold GROUP BY t.x HAVING count(*) >= 23)""")
def ta_depth(spark, d):
    return _sorted_lists(spark, d).threshold(WP, 23).select("depth")


@query("SELECT o_orderkey AS id, round(o_totalprice, 6) AS score FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1 OFFSET (SELECT count(*) // 3 - 1 FROM orders)")
def kth_certified(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    return _r(rank.kth_certified(o, F.col("o_totalprice"), o.count() // 3, direct=100))


@query("SELECT event_id AS id, round(value, 6) AS score FROM events ORDER BY value DESC, event_id LIMIT 1 OFFSET (SELECT count(*) // 2 - 1 FROM events)")
def kth_certified_ties(spark, d):
    e = _t(spark, d, "events").select(F.col("event_id").alias("id"), "value")
    return _r(rank.kth_certified(e, F.col("value"), e.count() // 2, direct=100))


_MANY = [(j, (round(math.cos(j * 0.37), 3) * 20, round(math.sin(j * 0.37), 3)), 2 + j % 7) for j in range(50)]


@query(f"""WITH w(wid, a, b, part) AS (VALUES {', '.join(f"({j}, {w[0]!r}::DOUBLE, {w[1]!r}::DOUBLE, {part})" for j, w, part in _MANY)})
SELECT wid, id, round(s, 6) AS score FROM (SELECT wid::BIGINT AS wid, p_partkey AS id, part, p_size * a + p_retailprice * b AS s, row_number() OVER (PARTITION BY wid ORDER BY p_size * a + p_retailprice * b DESC, p_partkey) AS r FROM part, w) WHERE r = (SELECT count(*) FROM part) // part""")
def kth_many(spark, d):
    """The row at rank n / 2 .. n / 8 by each of fifty weights."""
    p = _part(spark, d)
    n = p.count()
    return rank.kth_many(p, PC, [(j, w, n // part) for j, w, part in _MANY], most=100).select("wid", "id", F.round("score", 6).alias("score"))


@query(f"""WITH s AS (SELECT {_SP} AS s, row_number() OVER (ORDER BY {sampling.hashed_sql('p_partkey')}, p_partkey) AS h FROM part), m AS (SELECT s, row_number() OVER (ORDER BY s DESC) - 1 AS r FROM s WHERE h <= 100), n AS (SELECT count(*) AS n FROM part)
SELECT round((SELECT s FROM m, n WHERE r = least(99, ceil(((n // 4)::DOUBLE / n + 0.05) * 100))), 6) AS lo, round((SELECT s FROM m, n WHERE r = greatest(0, floor(((n // 4)::DOUBLE / n - 0.05) * 100))), 6) AS hi""")
def find_stripe(spark, d):
    p = _part(spark, d)
    s = sampling.sample(p, 100)
    n = p.count()
    lo, hi = rank.find_stripe(s, V.dot(_cols(), WP), n // 4, n, 0.05, one_sided=False)
    return spark.createDataFrame([(round(lo, 6), round(hi, 6))], "lo double, hi double")


@query(f"""WITH s AS (SELECT p_partkey AS id, {_SP} AS score, row_number() OVER (ORDER BY {sampling.hashed_sql('p_partkey')}, p_partkey) AS h FROM part), c AS (SELECT count(*) AS n, least(count(*), {sampling.sample_size(2, 1 / 64)}) AS m FROM part), o AS (SELECT score, row_number() OVER (ORDER BY score DESC) - 1 AS r FROM s, c WHERE h <= m),
b AS (SELECT floor((0.25 - 1/64.0) * m) AS f, ceil((0.25 + 1/64.0) * m) AS l, m FROM c)
SELECT id, round(score, 6) AS score FROM s, b WHERE score >= CASE WHEN l >= m - 1 THEN '-infinity'::DOUBLE ELSE (SELECT score FROM o, b WHERE r = l) END AND score <= CASE WHEN f <= 0 THEN 'infinity'::DOUBLE ELSE (SELECT score FROM o, b WHERE r = f) END""")
def kth_candidates(spark, d):
    p = _part(spark, d)
    return _r(rank.kth_candidates(p, V.dot(_cols(), WP), p.count() // 4, 1 / 64, 2))


@query(f"WITH s AS (SELECT id, {_L2} AS score FROM ({_E}), {_QV}) SELECT min(id) AS id, round(score, 6) AS score FROM s WHERE score = (SELECT score FROM s ORDER BY score LIMIT 1 OFFSET 40) GROUP BY score")
def quickselect_l2(spark, d):
    return _r(rank.quickselect(_emb(spark, d), V.l2_distance(F.col("vec"), _q(spark, d)), 40))


@query(f"WITH s AS (SELECT id, {_COS} AS score FROM ({_E}), {_QV}) SELECT min(id) AS id, round(score, 6) AS score FROM s WHERE score = (SELECT score FROM s ORDER BY score LIMIT 1 OFFSET 40) GROUP BY score")
def quickselect_cosine(spark, d):
    return _r(rank.quickselect(_emb(spark, d), V.score(F.col("vec"), _q(spark, d), "cosine"), 40))


@query("""WITH s AS (SELECT value AS s, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM events), w AS (SELECT greatest(1, (n * 0.05)::INTEGER) AS w FROM (SELECT floor(count(*) * 1.0) AS n FROM events)),
c AS (SELECT a.s AS lo, b.s AS hi, a.i, a.n AS total, (SELECT count(*) FROM events e WHERE e.value BETWEEN a.s AND b.s) AS n FROM s a, w JOIN s b ON b.i = a.i + w.w - 1)
SELECT round(lo, 6) AS lo, round(hi, 6) AS hi, n FROM c ORDER BY abs(n / total - 0.05), i LIMIT 1""")
def sample_stripe(spark, d):
    return rank.sample_stripe(_t(spark, d, "events"), F.col("value"), 0.05).select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


@query(f"SELECT p_partkey AS id FROM part ORDER BY {sampling.hashed_sql('p_partkey')}, p_partkey LIMIT 64")
def epsilon_sample(spark, d):
    return sampling.sample(_part(spark, d), 64).select("id")


@query(f"WITH h AS (SELECT {sampling.hashed_sql('p_partkey')} / 4294967296.0 AS h FROM part) SELECT layer, count(*) AS n FROM (SELECT (h < 0.5)::INTEGER + (h < 0.25)::INTEGER + (h < 0.125)::INTEGER AS layer FROM h) GROUP BY layer")
def sampling_layers(spark, d):
    return sampling.layers(_part(spark, d), 2, 3).groupBy("layer").agg(F.count("*").alias("n"))


# Neighbours -----------------------------------------------------------------------------------------------------------


def _knn_sql(s: str, k: int) -> str:
    return f"SELECT id, round({s}, 6) AS score, row_number() OVER (ORDER BY {s}, id) AS rank FROM ({_E}), {_QV} ORDER BY {s}, id LIMIT {k}"


def _rr(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"), "rank")


@query(_knn_sql(_L2, 20))
def knn_flat_l2(spark, d):
    return _rr(ann.Flat("l2").build(_emb(spark, d)).knn(_q(spark, d), 10))


@query(_knn_sql(_COS, 20))
def knn_flat_cosine(spark, d):
    return _rr(ann.Flat("angular").build(_emb(spark, d)).knn(_q(spark, d), 10))


@query(_knn_sql(_L2, 12))
def nearest_neighbor(spark, d):
    return _rr(ann.Flat("l2").build(_emb(spark, d)).nearest(_q(spark, d), 12))


@query(f"SELECT id FROM ({_E}), {_QV} ORDER BY {_L2}, id LIMIT 25")
def knn_lifted_l2(spark, d):
    s = V.dot(V.lift(F.col("vec")), V.lift_query(_q(spark, d)))
    return _emb(spark, d).select("id", s.alias("score")).orderBy(F.desc("score"), "id").limit(25).select("id")


@query(f"SELECT id FROM ({_E}), {_QV} ORDER BY {_L2}, id LIMIT 1 OFFSET 59")
def kth_nn_ball_l2(spark, d):
    return balls.NeighbourIndex.build(_emb(spark, d), "l2").kth(_q(spark, d), 60)


@query(f"SELECT id FROM ({_E}), {_QV} ORDER BY {_COS}, id LIMIT 1 OFFSET 59")
def kth_nn_ball_cosine(spark, d):
    return balls.NeighbourIndex.build(_emb(spark, d), "cosine", spherical=True).kth(_q(spark, d), 60)


_BQ = [(i, [0.2 * math.sin(i * 7 + j) for j in range(64)]) for i in range(4)]


@query("WITH q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, [{', '.join(map(repr, v))}]::DOUBLE[])" for i, v in _BQ) + f") t(qid, q)) SELECT qid, id, round(s, 6) AS score, rank FROM (SELECT qid, id, {_L2} AS s, row_number() OVER (PARTITION BY qid ORDER BY {_L2}, id) AS rank FROM ({_E}), q) WHERE rank <= 10")
def knn_batch(spark, d):
    return ann.batch_knn(_emb(spark, d), _BQ, 10).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query(_knn_sql(_L2, 20))
def knn_ivf_all_lists(spark, d):
    return _rr(ann.IVF("l2", nlist=16, nprobe=16).build(_emb(spark, d)).knn(_q(spark, d), 10))


#: The approximate indexes with the reference's settings (blocks that don't divide the dimensions get fewer); sign hashes and residual codes are ordered again.
INDEXES = {
    "knn_ivf": lambda: ann.IVF("cosine", nlist=128, nprobe=64),
    "knn_pq": lambda: ann.PQ("l2", m=100, nbits=8),
    "knn_ivfpq": lambda: ann.PQ("l2", m=50, nbits=8, nlist=1024, nprobe=128, wide=200),
    "knn_lsh": lambda: ann.SignHash("cosine", nbits=2048, wide=200),
    "knn_hnsw": lambda: ann.Graph("l2", m=32),
    "knn_hnsw_pq": lambda: ann.Graph("l2", m=64, pq_m=100, pq_nbits=8, ef_search=64),
}


_BUILT: dict[tuple[str, str, str], str] = {}


def index(spark, d, name: str):
    """An approximate index of the embeddings: built and stored once in a session, then read by all its queries."""
    key, made = (spark.sparkContext.applicationId, d, name), INDEXES[name]()
    if key not in _BUILT:
        path = f"{keep.shared_dir(spark)}/index-{uuid.uuid4().hex}"
        made.build(_emb(spark, d), path)
        _BUILT[key] = path
    return type(made).load(_emb(spark, d), _BUILT[key])


def _approximate(spark, d, name: str) -> DataFrame:
    return _rr(index(spark, d, name).knn(_q(spark, d), 10))


@query()
def knn_ivf(spark, d):
    return _approximate(spark, d, "knn_ivf")


@query()
def knn_pq(spark, d):
    return _approximate(spark, d, "knn_pq")


@query()
def knn_ivfpq(spark, d):
    return _approximate(spark, d, "knn_ivfpq")


@query()
def knn_lsh(spark, d):
    return _approximate(spark, d, "knn_lsh")


@query()
def knn_hnsw(spark, d):
    return _approximate(spark, d, "knn_hnsw")


@query()
def knn_hnsw_pq(spark, d):
    return _approximate(spark, d, "knn_hnsw_pq")


@query(_knn_sql(_L2, 10))
def knn_pq_reranked(spark, d):
    """Codes fetch a wide set; exact distances order it."""
    e, q = _emb(spark, d), _q(spark, d)
    return _rr(ann.rerank(ann.PQ("l2", m=32, nbits=6).build(e).knn(q, 200), e, q, "l2", 10))


@query("SELECT 10::BIGINT AS truth, 10::BIGINT AS hits, 1.0::DOUBLE AS recall, 2.0::DOUBLE AS size_ratio")
def recall_of_index(spark, d):
    e, q = _emb(spark, d), _q(spark, d)
    return metrics.recall(ann.IVF("l2", nlist=16, nprobe=16).build(e).knn(q, 10), ann.Flat("l2").build(e).nearest(q, 10), ["id"])


@query("SELECT qid, 1.0::DOUBLE AS recall FROM (VALUES (0), (1), (2), (3)) t(qid)")
def recall_at_k(spark, d):
    e = _emb(spark, d)
    return metrics.recall_at_k(ann.batch_knn(e, _BQ, 15), ann.batch_knn(e, _BQ, 10), 10)


_ASKED = "(SELECT vec_id AS qid, list_transform(embedding::DOUBLE[], lambda x, i: 2 * x + CASE WHEN i <= 32 THEN 0.1 ELSE 0.0 END) AS q FROM embeddings WHERE vec_id % 50 = 0)"


def _asked(spark, d) -> DataFrame:
    """(qid, vec): the queries of every id divisible by 50."""
    return _emb(spark, d).filter("id % 50 = 0").select(F.col("id").alias("qid"), F.transform("vec", lambda x, i: 2 * x + F.when(i < 32, 0.1).otherwise(0.0)).alias("vec"))


def _knn_join_sql(s: str) -> str:
    return f"SELECT qid, id, round(s, 6) AS score, rank FROM (SELECT qid, id, {s} AS s, row_number() OVER (PARTITION BY qid ORDER BY {s}, id) AS rank FROM ({_E}), {_ASKED}) WHERE rank <= 10"


@query(_knn_join_sql(_L2), "knn_join")
def knn_join_l2(spark, d):
    """The ten nearest rows of every id divisible by 50."""
    return join.knn_join(_asked(spark, d), _emb(spark, d), 10).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query(_knn_join_sql(_COS))
def knn_join_cosine(spark, d):
    return join.knn_join(_asked(spark, d), _emb(spark, d), 10, "cosine").select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query(f"SELECT qid, id, round(s, 6) AS score FROM (SELECT a.p_partkey AS qid, b.p_partkey AS id, s, row_number() OVER (PARTITION BY a.p_partkey ORDER BY s, b.p_partkey) AS r FROM (SELECT p_partkey, p_size * 7.31 AS x, p_retailprice AS y FROM part WHERE p_partkey % 50 = 0) a, (SELECT p_partkey, p_size * 7.31 AS x, p_retailprice AS y FROM part) b, LATERAL (SELECT sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS s)) WHERE r <= 5")
def knn_join_part(spark, d):
    """The five nearest parts, by size and price, of every part whose key 50 divides."""
    p = _part(spark, d).select("id", V.as_vec(F.col("p_size") * 7.31, F.col("p_retailprice")).alias("vec"))
    return join.knn_join(p.filter("id % 50 = 0").withColumnRenamed("id", "qid"), p, 5, rows=1024).select("qid", "id", F.round("score", 6).alias("score"))


@query()
def knn_join_copies(spark, d):
    """To how many groups of points each query of knn_join_part goes."""
    p = _part(spark, d).select("id", V.as_vec(F.col("p_size") * 7.31, F.col("p_retailprice")).alias("vec"))
    return join.PivotIndex.build(p, rows=1024).copies(p.filter("id % 50 = 0").withColumnRenamed("id", "qid"), 5)


@query()
def recall_of_lossy_indexes(spark, d):
    """Mean recall of each approximate index's best 10 against the exact ones, over the queries of every id divisible by 50."""
    e, asked = _emb(spark, d), _asked(spark, d)
    exact = {metric: keep.stored(join.knn_join(asked, e, 10, metric)) for metric in ("l2", "cosine")}
    rows = []
    for name in INDEXES:
        own = index(spark, d, name)
        each = metrics.recall_at_k(own.batch(asked, 10), exact[own.metric], 10)
        rows.append(each.agg(F.lit(name).alias("index"), F.count("*").alias("queries"), F.round(F.avg("recall"), 6).alias("recall")))
    return metrics.concat(*rows)


_LABEL = "(SELECT label, list_transform(range(1, 65), lambda i: 0.0) AS z FROM embeddings GROUP BY label)"


@query(f"WITH f AS (SELECT label, vec_id, unnest(range(1, 65)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM f GROUP BY label, i) SELECT f.label, round(max(r), 6) AS radius, count(*) AS n FROM (SELECT f.label, vec_id, sqrt(sum((x - m) * (x - m))) AS r FROM f JOIN c ON f.label = c.label AND f.i = c.i GROUP BY f.label, vec_id) f GROUP BY f.label")
def group_balls(spark, d):
    """Centroid and enclosing radius of each label's vectors."""
    e = _t(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("vec"))
    center = e.groupBy("label").agg(F.array(*(F.avg(F.col("vec")[i]) for i in range(64))).alias("center"))
    return e.join(center, "label").groupBy("label").agg(F.round(F.max(V.l2_distance(F.col("vec"), F.col("center"))), 6).alias("radius"), F.count("*").alias("n"))


@query(f"SELECT id, arg_min(j, s) AS ball_id FROM (SELECT id, j, list_distance(vec, c) AS s FROM ({_E}), (VALUES " + ", ".join(f"({j}, [{', '.join(map(repr, c))}]::DOUBLE[])" for j, c in enumerate(_CENTERS)) + ") t(j, c)) GROUP BY id")
def nearest_centers(spark, d):
    import numpy as np

    return balls.assign(_emb(spark, d), np.array(_CENTERS)).select("id", "ball_id")


@query(f"SELECT id, round(list_dot_product(vec, vec), 6) AS last, len(vec) + 1 AS dims FROM ({_E})")
def paraboloid_lift(spark, d):
    v = V.lift(F.col("vec"))
    return _emb(spark, d).select("id", F.round(F.element_at(v, -1), 6).alias("last"), F.size(v).cast("long").alias("dims"))


@query(f"SELECT id, round(vec[1] * 3 / greatest(sqrt(list_dot_product(vec, vec)) * 3, 1e-10), 6) AS first FROM ({_E})")
def row_normalize(spark, d):
    return _emb(spark, d).select("id", F.round(V.normalize(F.transform("vec", lambda x: x * 3))[0], 6).alias("first"))


@query(f"SELECT id FROM (SELECT id, list_transform(vec, lambda x: x * (id % 3)) AS vec FROM ({_E})) WHERE sqrt(list_dot_product(vec, vec)) > 1e-12")
def drop_zero_norm(spark, d):
    return prep.drop_zero_norm(_emb(spark, d).withColumn("vec", F.expr("transform(vec, x -> x * (id % 3))"))).select("id")


@query("SELECT count(*) AS n, 64::INTEGER AS dims, true AS unit FROM embeddings")
def dataset_info(spark, d):
    return P.dataset_info(_emb(spark, d))


@query("WITH e AS (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r, label FROM embeddings), n AS (SELECT label AS qid, list(vec_id ORDER BY r) AS ids FROM e WHERE r <= 8 GROUP BY label) SELECT qid, array_to_string(list_transform(list_filter(ids, lambda x: x % 2 = 0), lambda x: x + 1000000), ',') AS ids FROM n")
def neighbor_remap(spark, d):
    from pyspark.sql import Window

    e = _t(spark, d, "embeddings")
    r = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    n = e.withColumn("r", r).filter("r <= 8").groupBy(F.col("label").alias("qid")).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "vec_id"))), lambda x: x["vec_id"]).alias("ids"))
    ids = e.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("old"), (F.col("vec_id") + 1_000_000).alias("new"))
    return P.remap_neighbours(n, ids).select("qid", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("WITH n AS (SELECT label AS qid, list(vec_id ORDER BY vec_id) AS ids FROM embeddings GROUP BY label), k AS (SELECT list(DISTINCT doc_id) AS kept FROM labels) SELECT qid, array_to_string(list_transform(list_filter(ids, lambda x: list_contains(kept, x)), lambda x: x + 1000000), ',') AS ids FROM n, k")
def neighbor_remap_whole(spark, d):
    """Every id of each label; those that `labels` has are kept."""
    e = _t(spark, d, "embeddings")
    n = e.groupBy(F.col("label").alias("qid")).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    kept = _t(spark, d, "labels").select(F.col("doc_id").alias("vec_id")).distinct()
    ids = e.join(kept, "vec_id", "left_semi").select(F.col("vec_id").alias("old"), (F.col("vec_id") + 1_000_000).alias("new")).distinct()
    return P.remap_neighbours(n, ids).select("qid", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


# Levels ---------------------------------------------------------------------------------------------------------------


def _nations(spark, d):
    return _t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") * 0.37 - 3.1).alias("x"), (F.col("n_regionkey") * 1.13 - 1.7 + F.col("n_nationkey") * 0.01).alias("y"))


_N = "(SELECT n_nationkey AS id, n_nationkey * 0.37 - 3.1 AS x, n_regionkey * 1.13 - 1.7 + n_nationkey * 0.01 AS y FROM nation)"
_MEET = f"(SELECT a.id AS a, b.id AS b, (b.y - a.y) / (a.x * b.y - b.x * a.y) AS x, (a.x - b.x) / (a.x * b.y - b.x * a.y) AS y FROM {_N} a JOIN {_N} b ON a.id < b.id WHERE abs(a.x * b.y - b.x * a.y) >= 1e-10)"


@query(f"SELECT a, b, round(x, 6) AS x, round(y, 6) AS y FROM {_MEET}")
def line_intersections(spark, d):
    return klevel.intersections(_nations(spark, d)).select("a", "b", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"""WITH t AS (SELECT DISTINCT t FROM (SELECT round(CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END, 9) AS t FROM {_MEET} UNION ALL SELECT round(i * pi() / 2, 9) FROM range(4) r(i)) WHERE t < 6.283185307),
r AS (SELECT t AS t0, coalesce(lead(t) OVER (ORDER BY t), 2 * pi()) AS t1 FROM t), h AS (SELECT t0, t1, id, x * cos((t0 + t1) / 2) + y * sin((t0 + t1) / 2) AS s FROM r, {_N}),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t0 ORDER BY s DESC, id) AS k FROM h WHERE s > 1e-10 AND s <= 1e10) WHERE k <= 5),
i AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY t0) AS island FROM (SELECT *, CASE WHEN lag(id) OVER w = id AND lag(t1) OVER w = t0 THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY k ORDER BY t0)))
SELECT k, round(min(t0), 6) AS t0, round(max(t1), 6) AS t1, any_value(id) AS id FROM i GROUP BY k, island""")
def klevel_segments(spark, d):
    return klevel.levels(_nations(spark, d), 5).select("k", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"), "id")


@query(f"SELECT id FROM (SELECT id, x * cos(0.7) + y * sin(0.7) AS s FROM {_N}) WHERE s > 1e-10 ORDER BY s DESC, id LIMIT 1 OFFSET 2")
def klevel_lookup(spark, d):
    return klevel.lookup(klevel.levels(_nations(spark, d), 3), 3, 0.7 + 4 * math.pi).select("id")


_SUP = "(SELECT s_suppkey AS id, s_acctbal / 1000 AS x, s_nationkey + 0.5 AS y FROM supplier)"


@query(f"SELECT id, round(s, 6) AS score FROM (SELECT id, x * cos(2.0) + y * sin(2.0) AS s FROM {_SUP}) WHERE s > 1e-10 AND s <= 1e10 ORDER BY s DESC, id LIMIT 1 OFFSET 4")
def klevel_ray(spark, d):
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 1000).alias("x"), (F.col("s_nationkey") + 0.5).alias("y"))
    return _r(klevel.kth_on_ray(s, 5, 2.0))


@query(f"SELECT i AS ray, id, round(1 / s, 6) AS t FROM (SELECT i, id, x * cos(i * 0.5) + y * sin(i * 0.5) AS s FROM range(8) r(i), {_SUP}) WHERE s > 1e-10 AND s <= 1e10")
def ray_hits(spark, d):
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 1000).alias("x"), (F.col("s_nationkey") + 0.5).alias("y"))
    rays = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("ray"), klevel.ray_distance(F.col("x"), F.col("y"), F.lit(i * 0.5)).alias("t")) for i in range(8))))
    return s.select("id", rays.alias("r")).filter("r.t IS NOT NULL").select("r.ray", "id", F.round("r.t", 6).alias("t"))


_SUP0 = "(SELECT s_suppkey AS id, s_acctbal / 1000 - 4.5 AS x, s_nationkey - 12.25 AS y FROM supplier)"


@query(f"""WITH m AS (SELECT (b.y - a.y) / (a.x * b.y - b.x * a.y) AS x, (a.x - b.x) / (a.x * b.y - b.x * a.y) AS y FROM {_SUP0} a JOIN {_SUP0} b ON a.id < b.id WHERE abs(a.x * b.y - b.x * a.y) >= 1e-10),
g AS (SELECT atan2(y, x) AS t FROM m UNION ALL SELECT atan2(y, x) + q FROM {_SUP0}, (VALUES (pi() / 2), (-pi() / 2)) v(q) UNION ALL SELECT i * pi() / 2 FROM range(4) r(i)),
t AS (SELECT DISTINCT t FROM (SELECT round(CASE WHEN t < 0 THEN t + 2 * pi() ELSE t END, 9) AS t FROM g) WHERE t < 6.283185307),
r AS (SELECT t AS t0, coalesce(lead(t) OVER (ORDER BY t), 2 * pi()) AS t1 FROM t), h AS (SELECT t0, t1, id, x * cos((t0 + t1) / 2) + y * sin((t0 + t1) / 2) AS s FROM r, {_SUP0}),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t0 ORDER BY s DESC, id) AS k FROM h WHERE s > 1e-10 AND s <= 1e10) WHERE k <= (SELECT count(*) // 2 - 1 FROM supplier)),
i AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY t0) AS island FROM (SELECT *, CASE WHEN lag(id) OVER w = id AND lag(t1) OVER w = t0 THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY k ORDER BY t0)))
SELECT k, round(min(t0), 6) AS t0, round(max(t1), 6) AS t1, any_value(id) AS id FROM i GROUP BY k, island""")
def klevel_supplier(spark, d):
    """All levels 1 .. n/2 - 1 of the suppliers."""
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 1000 - 4.5).alias("x"), (F.col("s_nationkey") - 12.25).alias("y"))
    # angles of nine digits, rounded half up as whole numbers: as F.round, which goes by decimal text and takes longer than the rest
    t0, t1 = ((F.floor((F.rint(F.col(t) * 1e9) + 500) / 1000) / 1e6).alias(t) for t in ("t0", "t1"))
    return klevel.levels(s, s.count() // 2 - 1, limit=None).select("k", t0, t1, "id")


@query("""WITH p AS (SELECT p_partkey AS id, p_size - 25.5 AS x, p_retailprice / 4 - 237.4 AS y FROM part), s AS (SELECT i AS ray, id, x * cos(i * 0.1 + 0.05) + y * sin(i * 0.1 + 0.05) AS s FROM range(62) r(i), p)
SELECT ray, id FROM (SELECT ray, id, row_number() OVER (PARTITION BY ray ORDER BY s DESC, id) AS k FROM s WHERE s > 1e-10 AND s <= 1e10) WHERE k = 32""")
def klevel_part(spark, d):
    """Level 32 of the parts, looked up along 62 rays."""
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") - 25.5).alias("x"), (F.col("p_retailprice") / 4 - 237.4).alias("y"))
    return klevel.lookup_many(klevel.levels(p, 32, 32, limit=None), 32, [i * 0.1 + 0.05 for i in range(62)]).select("ray", "id")


@query("SELECT s_suppkey AS id, s_acctbal / 1000 AS a, s_nationkey + 0.5 AS b, -1.0 AS c FROM supplier")
def dual_lines(spark, d):
    line = V.dual_line(F.col("s_acctbal") / 1000, (F.col("s_nationkey") + 0.5).cast("double"))
    return _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), line.alias("l")).select("id", "l.*")


# Preparation and logs -------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, round(-1 + 2 * (p_size - lo) / (hi - lo)::DOUBLE, 6) AS p_size, round(-1 + 2 * (p_retailprice - l2) / (h2 - l2), 6) AS p_retailprice FROM part, (SELECT min(p_size) AS lo, max(p_size) AS hi, min(p_retailprice) AS l2, max(p_retailprice) AS h2 FROM part)")
def minmax_scale(spark, d):
    return prep.scale(_part(spark, d), PC).select("id", *(F.round(c, 6).alias(c) for c in PC))


@query("SELECT o_orderkey AS id, (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::INTEGER AS o_orderstatus, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS o_orderpriority FROM orders")
def ordinal_encode(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority")
    return prep.encode_ordinal(o, ["o_orderstatus", "o_orderpriority"])


@query("SELECT event_id AS id, coalesce(CASE WHEN event_type <> 'click' THEN event_type END, '0') AS event_type, coalesce(CASE WHEN value > 1 THEN value END, 0.0) AS value FROM events")
def fill_and_cast(spark, d):
    e = _t(spark, d, "events").select(F.col("event_id").alias("id"), F.expr("CASE WHEN event_type <> 'click' THEN event_type END").alias("event_type"), F.expr("CASE WHEN value > 1 THEN value END").alias("value"))
    return prep.fill_zero(e)


@query("SELECT event_id AS id, round(coalesce(CASE WHEN value > 1 THEN value END, (SELECT avg(value) FROM events WHERE value > 1)), 6) AS value FROM events")
def mean_fill(spark, d):
    e = _t(spark, d, "events").select(F.col("event_id").alias("id"), F.expr("CASE WHEN value > 1 THEN value END").alias("value"))
    return prep.fill_mean(e, ["value"]).select("id", F.round("value", 6).alias("value"))


@query("SELECT c_custkey AS id, round(-1 + 2 * (c_nationkey - a) / (b - a)::DOUBLE, 6) AS x0, round(-1 + 2 * (c_acctbal - c) / (e - c), 6) AS x1, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::DOUBLE AS x2 FROM customer, (SELECT min(c_nationkey) AS a, max(c_nationkey) AS b, min(c_acctbal) AS c, max(c_acctbal) AS e FROM customer)")
def table_to_points(spark, d):
    p = prep.to_points(_t(spark, d, "customer"), "c_custkey", ["c_name"])
    return p.select("id", *(F.round(F.col("vec")[i], 6).alias(f"x{i}") for i in range(3)))


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice FROM lineitem GROUP BY 1, 2")
def group_mean(spark, d):
    g = metrics.group_mean(_t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"])
    return g.select("l_returnflag", "l_linestatus", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_extendedprice", 4).alias("l_extendedprice"))


@query("SELECT round(avg(value), 6) AS value, count(*) AS n FROM events WHERE event_type = 'view'")
def filtered_mean(spark, d):
    return _t(spark, d, "events").filter("event_type = 'view'").agg(F.round(F.avg("value"), 6).alias("value"), F.count("*").alias("n"))


@query("SELECT c.c_custkey, c.c_mktsegment, o.n FROM customer c LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c.c_custkey = o.c_custkey")
def left_merge(spark, d):
    o = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return metrics.merge(_t(spark, d, "customer").select("c_custkey", "c_mktsegment"), o, ["c_custkey"])


@query("SELECT a.nation, a.n AS n_x, b.n AS n_y FROM (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1) a JOIN (SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY 1) b ON a.nation = b.nation")
def inner_merge(spark, d):
    a = _t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    b = _t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    return metrics.merge(a, b, ["nation"], "inner")


@query("SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def concat_logs(spark, d):
    return metrics.concat(_t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")), _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, d):
    return metrics.value_counts(_t(spark, d, "events"), "event_type")


@query("SELECT event_id AS id, 2.0 ** -least(19, greatest(1, CASE WHEN v >= 0.5 THEN 1 ELSE (SELECT i FROM range(1, 20) r(i) ORDER BY abs(v - 2.0 ** -i), i LIMIT 1) END)) AS near FROM (SELECT event_id, (value % 1)::DOUBLE AS v FROM events)")
def nearest_pow2(spark, d):
    return _t(spark, d, "events").select(F.col("event_id").alias("id"), V.nearest_power_fraction(F.col("value") % 1).alias("near"))


@query("SELECT p_partkey AS id, CASE WHEN lower(trim(p_type)) = 'angular' OR (p_type IS NULL AND lower(p_name) LIKE '%angular%') THEN 'angular' ELSE 'euclidean' END AS metric FROM part")
def distance_name(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), V.metric_name(F.col("p_type"), F.col("p_name")).alias("metric"))


@query(f"SELECT p_partkey AS id FROM part WHERE {_S2} <= -700.0003 UNION SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")
def candidate_union(spark, d):
    p = _part(spark, d)
    return p.filter(ranges.halfspace_upper(_cols(), W2, -700.0003)).select("id").union(p.filter(F.col("p_size").between(10, 20)).select("id")).distinct()


@query(f"SELECT p_partkey AS id FROM part WHERE {_S2} <= -500.0003 AND p_size BETWEEN 10 AND 30")
def candidate_intersection(spark, d):
    p = _part(spark, d)
    return p.filter(ranges.halfspace_upper(_cols(), W2, -500.0003)).select("id").intersect(p.filter(F.col("p_size").between(10, 30)).select("id"))


@query("SELECT true AS same")
def same_as_scan(spark, d):
    """The cell table's answer against the scan's, both ways."""
    p = _part(spark, d)
    a = cells.CellIndex.build(p, PC, "id").stripe(W2, *_SLAB).select("id")
    return spark.createDataFrame([(metrics.same_rows(a, p.filter(ranges.stripe(_cols(), W2, *_SLAB)).select("id")),)], "same boolean")


@query("SELECT event_id AS id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r > 1")
def drop_first_rows(spark, d):
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))
    return _t(spark, d, "events").withColumn("r", r).filter("r > 1").select(F.col("event_id").alias("id"))


@query()
def zipf_points(spark, d):
    n = _t(spark, d, "orders").count()
    return P.zipf(spark, n, 4).select("id", *(F.col("vec")[i].alias(f"x{i}") for i in range(4)))


_ZU = lambda j: f"floor(pow(({sampling.hashed_sql('id', 42 + j)} + 0.5) / 4294967296.0, -2.0))"


@query("SELECT id, " + ", ".join(f"round(ln({_ZU(j)}), 6) AS x{j}" for j in range(4)) + " FROM (SELECT (row_number() OVER () - 1)::BIGINT AS id FROM orders)")
def zipf_logs(spark, d):
    """The generator's coordinates by their logarithms, as far ones have more digits than a power is exact to."""
    n = _t(spark, d, "orders").count()
    return P.zipf(spark, n, 4).select("id", *(F.round(F.ln(F.col("vec")[i]), 6).alias(f"x{i}") for i in range(4)))


# Several levels, splits ------------------------------------------------------------------------------------------------


@query(_EMB_STRIPE)
def hierarchy_stripe(spark, d):
    return hierarchy.Hierarchy.build(_emb(spark, d)).stripe(W4, -0.1000003, 0.2000003).select("id", F.round("score", 6).alias("score"))


@query(_EMB_STRIPE)
def ball_tree_stripe(spark, d):
    """By balls of several levels whose number follows the table's rows."""
    return tree.BallTree.build(_emb(spark, d), fan=8, top=16).stripe(W4, -0.1000003, 0.2000003).select("id", F.round("score", 6).alias("score"))


def _share(level: str) -> str:
    return f"(SELECT count(*) FROM embeddings WHERE {sampling.hashed_sql('vec_id')} < 4294967296 // CAST(4 ** {level} AS BIGINT))"


@query(f"""WITH s AS (SELECT l.level - 1 AS level, {_share('l.level')} AS nodes FROM range(1, 12) l(level)), top AS (SELECT min(level) AS top FROM s WHERE nodes <= 16)
SELECT level::INTEGER AS level, nodes, (SELECT count(*) FROM embeddings) AS n, true AS held FROM s, top WHERE level <= top""")
def ball_tree_levels(spark, d):
    """The levels' nodes, the points under them, and whether every ball holds what is under it."""
    t = tree.BallTree.build(_emb(spark, d), fan=4, top=16)
    held = t.check()
    return metrics.concat(*(x.agg(F.count("*").alias("nodes"), F.sum("n").alias("n")).select(F.lit(level).alias("level"), "nodes", "n", F.lit(held).alias("held")) for level, x in enumerate(t.levels)))


@query(_BOX)
def partition_tree_box(spark, d):
    """By cells of bounded rows, split where the points are."""
    return tree.PartitionTree.build(_part(spark, d), PC, leaf_rows=64).box((10, 950.0), (30, 1400.0)).select("id", *PC)


@query(_STRIPE)
def partition_tree_stripe(spark, d):
    return tree.PartitionTree.build(_part(spark, d), PC, leaf_rows=64).stripe(W2, *_SLAB).select("id", _score(W2))


@query("SELECT count(*) AS n, 0::BIGINT AS over, true AS held FROM orders")
def partition_tree_leaves(spark, d):
    """Points of the orders' tree, its leaves of over 256 rows that could be split, and whether boxes and counts hold."""
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", F.unix_date(F.col("o_orderdate").cast("date")).alias("day"))
    t = tree.PartitionTree.build(o, ["o_totalprice", "day"], leaf_rows=256)
    parts = (F.col("lo_o_totalprice") < F.col("hi_o_totalprice")) | (F.col("lo_day") < F.col("hi_day"))
    return t.leaves.agg(F.sum("n").alias("n"), F.count_if((F.col("n") > 256) & parts).alias("over")).withColumn("held", F.lit(t.check()))


@query(_BOX)
def partition_tree_inserts(spark, d):
    """A quarter of the parts built, the others inserted in three batches."""
    p = _part(spark, d)
    t = tree.PartitionTree.build(p.filter("id % 4 = 0"), PC, leaf_rows=64)
    for batch in (1, 2, 3):
        t = t.insert(p.filter(f"id % 4 = {batch}"))
    return t.box((10, 950.0), (30, 1400.0)).select("id", *PC)


@query("SELECT doc_id AS id, n_chars FROM documents WHERE n_chars BETWEEN 500 AND 1500 AND doc_id BETWEEN 100 AND 40000")
def partition_tree_documents(spark, d):
    """Documents by length and number: half of them built, half inserted."""
    p = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars", F.col("doc_id").alias("number"))
    t = tree.PartitionTree.build(p.filter("id % 2 = 0"), ["n_chars", "number"], leaf_rows=1024, file_rows=16_384).insert(p.filter("id % 2 <> 0"))
    return t.box((500, 100), (1500, 40000)).select("id", "n_chars")


_C5 = "(VALUES " + ", ".join(f"({j}, [{', '.join(map(repr, c))}]::DOUBLE[])" for j, c in enumerate(_CENTERS)) + ") t(j, c)"


@query(f"""WITH e AS ({_E}), a1 AS (SELECT id, vec, arg_min(j, list_distance(vec, c)) AS j FROM e, {_C5} GROUP BY id, vec),
m1 AS (SELECT j, list(x ORDER BY i) AS c FROM (SELECT j, i, avg(x) AS x FROM (SELECT j, unnest(range(1, 65)) AS i, unnest(vec) AS x FROM a1) GROUP BY j, i) GROUP BY j),
c1 AS (SELECT t.j, coalesce(m1.c, t.c) AS c FROM {_C5} LEFT JOIN m1 ON m1.j = t.j),
a2 AS (SELECT id, vec, arg_min(j, list_distance(vec, c)) AS j, min(list_distance(vec, c)) AS s FROM e, c1 GROUP BY id, vec)
SELECT j AS center, count(*) AS n, round(sum(vec[1]), 6) AS first, (SELECT round(sum(s * s), 4) FROM a2) AS cost FROM a2 GROUP BY j""")
def kmeans_passes(spark, d):
    """The second pass over all rows from five fixed centres: the points of each centre, their sum, and the cost."""
    import numpy as np

    e = _emb(spark, d)
    n, sums, cost = kmeans.sums_of(e, kmeans.refined(e, np.array(_CENTERS), 1)[0])
    return spark.createDataFrame([(j, int(n[j]), round(float(sums[j][0]), 6), round(cost, 4)) for j in range(len(n)) if n[j]], "center int, n long, first double, cost double")


@query(f"""WITH p AS (SELECT label, a.id AS a, b.id AS b, list_distance(a.vec, b.vec) AS s FROM (SELECT label, vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings) a JOIN (SELECT label, vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings) b USING (label) WHERE a.id < b.id)
SELECT label, a, b, round(s, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, a, b) AS r FROM p) WHERE r = 1""")
def farthest_pairs(spark, d):
    """The two vectors of each label that are farthest from each other."""
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vec"))
    return farthest.farthest_pairs(e, "label").withColumn("distance", F.round("distance", 6))


@query("""WITH p AS (SELECT p_brand, p_partkey AS id, p_size * 7.31 AS x, p_retailprice AS y FROM part), q AS (SELECT a.p_brand, a.id AS a, b.id AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS s FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.id < b.id)
SELECT p_brand, round(max(s), 6) AS distance FROM q GROUP BY p_brand""")
def farthest_parts(spark, d):
    """How far the parts of each brand are apart, by size and price."""
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", V.as_vec(F.col("p_size") * 7.31, F.col("p_retailprice")).alias("vec"))
    return farthest.farthest_pairs(p, "p_brand", ball_rows=256).select("p_brand", F.round("distance", 6).alias("distance"))


@query("SELECT k, true AS held FROM (VALUES (1), (20), (100)) t(k)")
def hierarchy_candidates(spark, d):
    """Whether the candidates of rank k hold the row that a scan finds there."""
    e = _emb(spark, d)
    h = hierarchy.Hierarchy.build(e, branching=2)
    rows = [(k, not h.candidates(W4, k).join(rank.kth_exhaustive(e, V.dot(F.col("vec"), W4), k), "id", "left_semi").isEmpty()) for k in (1, 20, 100)]
    return spark.createDataFrame(rows, "k int, held boolean")


@query("SELECT min(p_size) AS lo_p_size, max(p_size) AS hi_p_size, min(p_retailprice) AS lo_p_retailprice, max(p_retailprice) AS hi_p_retailprice, count(*) AS n, round(greatest(max(p_size) - min(p_size), 1e-10) * greatest(max(p_retailprice) - min(p_retailprice), 1e-10), 3) AS area FROM part")
def box_union(spark, d):
    """The box round the brands' boxes, and its area."""
    u = ranges.union_of(ranges.box_of(_t(spark, d, "part"), PC, ["p_brand"]), PC)
    return u.withColumn("area", F.round(ranges.volume([F.col(f"lo_{c}") for c in PC], [F.col(f"hi_{c}") for c in PC]), 3))


@query(f"SELECT x.p_brand AS a, y.p_brand AS b, round(sqrt(((x.a + x.b) / 2.0 - (y.a + y.b) / 2.0) ** 2 + ((x.c + x.e) / 2 - (y.c + y.e) / 2) ** 2), 6) AS distance FROM {_BB} x JOIN {_BB} y ON x.p_brand < y.p_brand ORDER BY 3 DESC, 1, 2 LIMIT 1")
def split_seeds(spark, d):
    """The two brands whose boxes' centres are farthest apart."""
    b = ranges.box_of(_t(spark, d, "part"), PC, ["p_brand"])
    center = V.as_vec(*((F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2 for c in PC))
    return ranges.farthest_pair(b, center, "p_brand").withColumn("distance", F.round("distance", 6))


_RU = V.random_unit(2, 7)
_SR = f"(p_size * {_RU[0]!r}::DOUBLE + p_retailprice * {_RU[1]!r}::DOUBLE)"


@query(f"""WITH s AS (SELECT {_SR} AS s, row_number() OVER (ORDER BY {_SR}) AS i, count(*) OVER () AS n FROM part), w AS (SELECT greatest(1, floor(count(*) * 0.1)::INTEGER) AS w FROM part),
c AS (SELECT a.s AS lo, b.s AS hi, a.i, a.n AS total, (SELECT count(*) FROM s e WHERE e.s BETWEEN a.s AND b.s) AS n FROM s a, w JOIN s b ON b.i = a.i + w.w - 1)
SELECT round(lo, 6) AS lo, round(hi, 6) AS hi, n FROM c ORDER BY abs(n / total - 0.1), i LIMIT 1""")
def random_stripe(spark, d):
    """A stripe along a random direction that holds a tenth of the points."""
    return rank.sample_stripe(_part(spark, d), V.dot(_cols(), _RU), 0.1).select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


@query("SELECT index, (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0) AS queries, true AS enough FROM (VALUES ('knn_ivf'), ('knn_pq'), ('knn_ivfpq'), ('knn_lsh'), ('knn_hnsw'), ('knn_hnsw_pq')) t(index)")
def lossy_recall_reached(spark, d):
    """Whether each approximate index finds nine tenths of the exact best 10, over the queries of every id divisible by 50."""
    return recall_of_lossy_indexes(spark, d).select("index", "queries", (F.col("recall") >= 0.9).alias("enough"))
