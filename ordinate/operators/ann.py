"""Nearest neighbours: exact top-k, and indexes (inverted lists, product codes, sign hashes, neighbour graphs). All give
(id, score, rank) of the k + 10 best, best first; fewer rows where there are fewer points."""

from __future__ import annotations

import pickle
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordinate.functions import vectors as V
from ordinate.operators import balls, join, keep, kmeans, sampling

EXTRA = 10
#: Rows that are kept out of the centres' training, by which the number of lists to read is chosen.
HELD_OUT = 128
#: Walks over a graph that go side by side, and the most distances of a table of theirs (fewer walks go over larger parts).
WALKS, TABLE = 256, 4_194_304
FOUND = "qid long, id long, score double"


def _metric(metric: str) -> str:
    if metric in ("cosine", "angular"):
        return "cosine"
    if metric in ("euclidean", "l2"):
        return "l2"
    raise ValueError(f"unknown metric: {metric}")


def distance(vec: Column, q: Sequence[float], metric: str) -> Column:
    if _metric(metric) == "l2":
        return V.l2_distance(vec, q)
    size = max(sum(x * x for x in q) ** 0.5, V.EPS_NORM)
    return 1 - V.dot(V.normalize(vec), [x / size for x in q])


def _top(scored: DataFrame, k: int) -> DataFrame:
    """A top-k merge, then ranks over its k rows."""
    best = scored.orderBy("score", "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("score", "id")))


@dataclass
class Flat:
    metric: str = "l2"
    points: DataFrame | None = field(default=None, repr=False)

    def build(self, points: DataFrame) -> Flat:
        _metric(self.metric)
        self.points = points
        return self

    def _checked(self) -> DataFrame:
        if self.points is None:
            raise RuntimeError("build the index first")
        return self.points

    def knn(self, q: Sequence[float], k: int, extra: int = EXTRA) -> DataFrame:
        return _top(self._checked().select("id", distance(F.col("vec"), q, self.metric).alias("score")), k + extra)

    def nearest(self, q: Sequence[float], k: int) -> DataFrame:
        return self.knn(q, k, 0)


def batch_knn(points: DataFrame, queries: Sequence[tuple[int, Sequence[float]]], k: int, metric: str = "l2") -> DataFrame:
    """(qid, id, score, rank): a few literal queries against all points in one scan; ranks are limited before the shuffle."""
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("qid"), distance(F.col("vec"), q, metric).alias("score")) for i, q in queries)))
    scored = points.select("id", rows.alias("s")).select("s.qid", "id", "s.score")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("score", "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def rerank(candidates: DataFrame, points: DataFrame, q: Sequence[float], metric: str, size: int) -> DataFrame:
    """Candidates' exact distances, the best `size` of them."""
    return _top(points.join(candidates.select("id").distinct(), "id", "left_semi").select("id", distance(F.col("vec"), q, metric).alias("score")), size)


def _prepared(points: DataFrame, metric: str) -> DataFrame:
    return points.select("id", V.normalize(F.col("vec")).alias("vec")) if _metric(metric) == "cosine" else points.select("id", "vec")


def _query(q: Sequence[float], metric: str) -> np.ndarray:
    x = np.array(q, float)
    return x / max(np.linalg.norm(x), V.EPS_NORM) if _metric(metric) == "cosine" else x


def _best(rows: DataFrame, scores, k: int) -> DataFrame:
    """(qid, id, score) of each batch's best k for each query; scores(batch) gives each query's scores in turn, infinite for what it doesn't read."""

    def run(batches):
        for b in batches:
            ids = np.asarray(b.column(0), np.int64)
            for qid, s in enumerate(scores(b) if b.num_rows else ()):
                near = np.flatnonzero(np.isfinite(s))
                if len(near) > k:
                    near = near[s[near] <= np.partition(s[near], k - 1)[k - 1]]
                near = near[np.lexsort((ids[near], s[near]))[:k]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), qid, np.int32)), pa.array(ids[near]), pa.array(s[near].astype(float))], names=["qid", "id", "score"])

    return rows.mapInArrow(run, "qid int, id long, score double")


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def _exact(b: pa.RecordBatch, queries: np.ndarray, metric: str):
    """Each query's distances to a batch of (id, vec); vectors and queries are prepared."""
    x = _vectors(b.column(1))
    return (1 - x @ q if _metric(metric) == "cosine" else np.sqrt(((x - q) ** 2).sum(axis=1)) for q in queries)


def as_queries(points: DataFrame, queries: DataFrame | Sequence[Sequence[float]], metric: str) -> DataFrame:
    """(qid, vec), prepared for the metric: a table of any size as it is, or a short list numbered from 0."""
    if not isinstance(queries, DataFrame):
        queries = points.sparkSession.createDataFrame([(i, [float(v) for v in q]) for i, q in enumerate(queries)], "qid long, vec array<double>")
    return join.prepared(queries, "qid", _metric(metric))


def _to_lists(queries: DataFrame, centers: np.ndarray, nprobe: int) -> DataFrame:
    """queries (qid, vec), once for each of the nprobe lists (group) with the nearest centres, in their order (place)."""
    shared = queries.sparkSession.sparkContext.broadcast(centers)

    def run(batches):
        c = shared.value
        size, n = (c**2).sum(axis=1), max(1, min(nprobe, len(c)))
        for b in batches:
            near = np.argsort(size - 2 * join.vectors(b.column(1)) @ c.T, axis=1, kind="stable")[:, :n].astype(np.int32) if b.num_rows else np.zeros((0, n), np.int32)
            groups = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, n, dtype=np.int32)), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), groups], names=["qid", "vec", "groups"])

    return queries.mapInArrow(run, "qid long, vec array<double>, groups array<int>").select("qid", "vec", F.posexplode("groups").alias("place", "group"))


def _in_lists(points: DataFrame, asked: DataFrame, fn, k: int, nprobe: int) -> DataFrame:
    """(qid, id, score, rank): the best k of each query in its lists. The first eighth of them give a k-th score, and of the others
    only what is no worse is sent on."""
    near = max(1, nprobe // 8)
    first = keep.stored(join.ranked(join.meet(points, asked.filter(F.col("place") < near).drop("place"), fn, FOUND), k))
    if near >= nprobe:
        return first
    limit = first.filter(F.col("rank") == k).select("qid", F.col("score").alias("limit"))
    rest = asked.filter(F.col("place") >= near).drop("place").join(limit, "qid", "left")
    return join.ranked(first.drop("rank").unionByName(join.meet(points, rest, fn, FOUND)), k)


class Stored:
    """Indexes that a path keeps: rows as a table, all else in a table of one row."""

    def _save(self, path: str | None, spark) -> None:
        self.kept = path is not None
        if path:
            model = {k: v for k, v in vars(self).items() if not isinstance(v, DataFrame)}
            spark.createDataFrame([(pickle.dumps(model),)], "model binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")

    def _rows(self) -> DataFrame:
        """The index's rows, in the shared folder if no path keeps them: a batch reads them more than once."""
        rows = getattr(self, self.ROWS)
        if rows is None:
            raise RuntimeError("build the index first")
        if not getattr(self, "kept", False):
            rows, self.kept = keep.stored(rows), True
            setattr(self, self.ROWS, rows)
        return rows

    @classmethod
    def load(cls, points: DataFrame, path: str):
        """The index that build(points, path) stored there; points are what it was built of."""
        spark = points.sparkSession
        index = cls()
        vars(index).update(pickle.loads(spark.read.parquet(f"{path}/model").first()["model"]))
        setattr(index, cls.ROWS, spark.read.parquet(f"{path}/rows"))
        index.points = points
        return index


def _nearest_lists(centers: np.ndarray, q: np.ndarray, nprobe: int) -> np.ndarray:
    return np.argsort(((centers - q) ** 2).sum(axis=1), kind="stable")[: max(1, nprobe)]


def flat_batch(points: DataFrame, queries: Sequence[Sequence[float]], k: int, metric: str = "l2") -> DataFrame:
    """(qid, id, score, rank): the exact best k of many queries, numbered from 0, in one scan."""
    qs = np.array([_query(q, metric) for q in queries])
    return join.ranked(_best(_prepared(points, metric).select(F.col("id").cast("long"), "vec"), lambda b: _exact(b, qs, metric), k), k)


def _reordered(near: DataFrame, points: DataFrame, queries: DataFrame, metric: str, k: int) -> DataFrame:
    """(qid, id, score, rank): the best k of each query's candidates (qid, id) by their exact distances."""

    def exact(batches):
        for b in batches:
            if b.num_rows:
                x, q = join.vectors(b.column(2)), join.vectors(b.column(3))
                s = 1 - (x * q).sum(axis=1) if metric == "cosine" else np.sqrt(((x - q) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], names=["qid", "id", "score"])

    found = near.select("qid", "id").join(_prepared(points, metric), "id").join(queries.select("qid", F.col("vec").alias("q")), "qid")
    return join.ranked(found.select("qid", F.col("id").cast("long").alias("id"), "vec", "q").mapInArrow(exact, FOUND), k)


@dataclass
class IVF(Stored):
    """Inverted lists: the nprobe lists with the nearest centres are read; nprobe = nlist is exact. passes: how often the centres,
    which a bounded sample gives, are moved to the means of all rows."""

    ROWS = "members"
    metric: str = "l2"
    nlist: int = 128
    nprobe: int = 64
    passes: int = 0
    centers: np.ndarray | None = None
    members: DataFrame | None = field(default=None, repr=False)

    def build(self, points: DataFrame, path: str | None = None) -> IVF:
        """With a path the lists are written there in their order, and a query reads the files of those it probes."""
        data = _prepared(points, self.metric)
        n = points.count()
        self.nlist = max(1, min(self.nlist, n))
        self.nprobe = min(self.nprobe, self.nlist)
        round_ones = _metric(self.metric) == "cosine"
        self.centers = balls.train_centers(data, self.nlist, spherical=round_ones)
        self.centers = kmeans.refined(data, self.centers, self.passes, round_ones)[0]
        self.members = balls.assign(data, self.centers)
        if path:
            self.members = keep.clustered(self.members, "ball_id", "id", n, f"{path}/rows")
        self._save(path, points.sparkSession)
        return self

    def _lists(self, q: np.ndarray) -> DataFrame:
        if self.members is None:
            raise RuntimeError("build the index first")
        near = _nearest_lists(self.centers, q, self.nprobe)
        return self.members.filter(F.col("ball_id").isin(near.tolist()))

    def knn(self, q: Sequence[float], k: int, extra: int = EXTRA) -> DataFrame:
        return _top(self._lists(_query(q, self.metric)).select("id", distance(F.col("vec"), list(q), self.metric).alias("score")), k + extra)

    def batch(self, queries: DataFrame | Sequence[Sequence[float]], k: int) -> DataFrame:
        """(qid, id, score, rank): queries and lists meet by a join, each in pieces of bounded size."""
        members = self._rows()
        asked = _to_lists(as_queries(members, queries, self.metric), self.centers, self.nprobe)
        points = members.select(F.col("ball_id").alias("group"), "id", "vec")
        return _in_lists(points, asked, join.nearest_in(_metric(self.metric), k), k, self.nprobe)


def _codebooks(spark, x: np.ndarray, m: int, nbits: int) -> np.ndarray:
    """(m, codes, width), each block's trained in a task of its own."""
    width = x.shape[1] // m
    k = min(1 << nbits, len(x))
    shared = spark.sparkContext.broadcast(x)  # a bounded sample

    def run(batches):
        for b in batches:
            for j in b.column(0).to_pylist():
                book = balls.lloyd(shared.value[:, j * width : (j + 1) * width], k, seed=j)
                yield pa.RecordBatch.from_arrays([pa.array([j]), pa.array([book.tobytes()], pa.binary())], names=["block", "book"])

    books = spark.range(0, m, 1, m).mapInArrow(run, "block long, book binary").orderBy("block").collect()
    return np.stack([np.frombuffer(r["book"]).reshape(k, width) for r in books])


def _encode(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    width = books.shape[2]
    return np.stack([balls.nearest(x[:, j * width : (j + 1) * width], b) for j, b in enumerate(books)], axis=1).astype(np.int16)


def _coded(points: DataFrame, books: np.ndarray, centers: np.ndarray | None) -> DataFrame:
    """(id, ball_id, code): of the vectors, or of what is left of them at their list's centre."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(1).flatten(), float).reshape(b.num_rows, -1)
                ball = np.asarray(b.column(2), np.int32)
                code = _encode(x - centers[ball] if centers is not None else x, books)
                arrays = pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, code.shape[1], dtype=np.int32)), pa.array(code.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ball), arrays], names=["id", "ball_id", "code"])

    return points.mapInArrow(run, "id long, ball_id int, code array<smallint>")


def fitting_blocks(d: int, m: int) -> int:
    """The largest number of blocks up to m that divides d."""
    return max(j for j in range(1, min(m, d) + 1) if d % j == 0)


@dataclass
class PQ(Stored):
    """Product codes, scored by the distance to what they stand for; lists > 1 puts inverted lists before them (residual codes).
    wide > 0: the wide nearest by codes are ordered by their exact distances. reach: how many lists are read, at least nprobe, is
    chosen once, so that of the best ten of HELD_OUT rows that the centres have not seen, this share is in the lists read. passes:
    how often the lists' centres are moved to the means of all other rows."""

    ROWS = "codes"
    metric: str = "l2"
    m: int = 100
    nbits: int = 8
    nlist: int = 1
    nprobe: int = 1
    wide: int = 0
    reach: float | None = 0.95
    train_rows: int | None = None
    passes: int = 0
    codes: DataFrame | None = field(default=None, repr=False)
    points: DataFrame | None = field(default=None, repr=False)

    def build(self, points: DataFrame, path: str | None = None) -> PQ:
        """Trained on at most train_rows (balls.TRAIN_ROWS) rows and half the table. With a path the codes are written there in the order of the
        lists, and queries read the files of those they probe."""
        self.points, data = points, _prepared(points, self.metric)
        n = points.count()
        train = max(1, min(self.train_rows or balls.TRAIN_ROWS, n - n // 2))
        drawn = sampling.sample(data, train + min(HELD_OUT, n // 8)).collect()
        x = np.array([r["vec"] for r in drawn[:train]], float).reshape(min(train, len(drawn)), -1)
        self.m = fitting_blocks(x.shape[1], self.m)
        self.nbits = max(1, min(self.nbits, int(np.log2(max(2, len(x))))))
        self.nlist = max(1, min(self.nlist, len(x) // 4))
        self.nprobe = min(self.nprobe, self.nlist)
        self.centers = balls.lloyd(x, self.nlist) if self.nlist > 1 else np.zeros((1, x.shape[1]))
        if self.passes and self.nlist > 1:
            rest = data.filter(~F.col("id").isin([r["id"] for r in drawn[train:]])) if drawn[train:] else data
            self.centers = kmeans.refined(rest, self.centers, self.passes)[0]
        self.books = _codebooks(points.sparkSession, x - self.centers[balls.nearest(x, self.centers)], self.m, self.nbits)
        self.codes = _coded(balls.assign(data, self.centers), self.books, self.centers)
        if path:
            self.codes = keep.clustered(self.codes, "ball_id", "id", n, f"{path}/rows")
        if self.reach and self.nlist > 1:
            self.nprobe = self._enough(drawn[train:], data)
        self._save(path, points.sparkSession)
        return self

    def _enough(self, held: list, data: DataFrame, k: int = 10) -> int:
        """The fewest lists, nprobe at least, in which the share `reach` of the held-out rows' best k lie on average."""
        if not held:
            return self.nlist
        vecs = {i: np.array(r["vec"], float) for i, r in enumerate(held)}
        exact = flat_batch(data, [v.tolist() for v in vecs.values()], k + 1, "l2")  # prepared rows: at most HELD_OUT * (k + 1) come back
        lists = exact.join(self.codes.select("id", "ball_id"), "id").select("qid", "id", "ball_id").collect()
        place = {i: np.argsort(_nearest_lists(self.centers, v, self.nlist)) for i, v in vecs.items()}
        ranks = sorted(int(place[r["qid"]][r["ball_id"]]) for r in lists if r["id"] != held[r["qid"]]["id"])
        at = min(len(ranks) - 1, int(np.ceil(self.reach * len(ranks))))
        return max(self.nprobe, min(self.nlist, ranks[at] + 1 if ranks else self.nlist))

    def knn(self, q: Sequence[float], k: int, extra: int = EXTRA) -> DataFrame:
        if self.codes is None:
            raise RuntimeError("build the index first")
        x, size = _query(q, self.metric), max(k + extra, self.wide)
        near = _nearest_lists(self.centers, x, self.nprobe).tolist()
        decoded = _decoder(self.books, self.centers)
        scores = lambda b: [np.sqrt(((decoded(b.column("ball_id"), b.column("code")) - x) ** 2).sum(axis=1))]
        found = _top(_best(self.codes.filter(F.col("ball_id").isin(near)), scores, size).select("id", "score"), size)
        return rerank(found, self.points, q, self.metric, k + extra) if self.wide else found

    def batch(self, queries: DataFrame | Sequence[Sequence[float]], k: int) -> DataFrame:
        """(qid, id, score, rank), as IVF.batch."""
        rows = self._rows()
        size, asked = max(k, self.wide), as_queries(rows, queries, self.metric)
        decoded = _decoder(self.books, self.centers)

        def fn(p: pa.Table, q: pa.Table) -> pa.Table:
            x, y = decoded(p["group"], p["code"]), join.vectors(q["vec"])
            own, other = (x * x).sum(axis=1), (y * y).sum(axis=1)
            scores = lambda lo, hi: np.sqrt(np.maximum(own + other[lo:hi, None] - 2 * y[lo:hi] @ x.T, 0))
            return join.best(np.asarray(q["qid"]), np.asarray(p["id"]), scores, size, limit=join.limits(q))

        codes = rows.select(F.col("ball_id").alias("group"), "id", "code")
        found = _in_lists(codes, _to_lists(asked, self.centers, self.nprobe), fn, size, self.nprobe)
        return _reordered(found, self.points, asked, _metric(self.metric), k) if self.wide else found


def _decoder(books: np.ndarray, centers: np.ndarray):
    """What codes of a list stand for."""

    def decoded(ball: pa.ChunkedArray, code: pa.ChunkedArray) -> np.ndarray:
        code = join.vectors(code).astype(int)
        return centers[np.asarray(ball)] + np.concatenate([book[code[:, j]] for j, book in enumerate(books)], axis=1)

    return decoded


@dataclass
class SignHash(Stored):
    """Bits of random projections' signs, packed 63 to a long; Hamming distance. wide > 0: the wide nearest by it (at least those
    asked for) are ordered by their exact distances, which are then the scores."""

    ROWS = "codes"
    metric: str = "cosine"
    nbits: int = 2048
    seed: int = 5
    wide: int = 0
    codes: DataFrame | None = field(default=None, repr=False)
    points: DataFrame | None = field(default=None, repr=False)

    def build(self, points: DataFrame, path: str | None = None) -> SignHash:
        self.points, data = points, _prepared(points, self.metric)
        first = data.select("vec").first()
        d = len(first["vec"]) if first else 1
        self.planes = np.random.default_rng(self.seed).normal(size=(d, self.nbits))
        planes = self.planes

        def run(batches):
            for b in batches:
                if b.num_rows:
                    x = np.asarray(b.column(1).flatten(), float).reshape(b.num_rows, -1)
                    w = _packed(x @ planes >= 0)
                    arrays = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), pa.array(w.ravel()))
                    yield pa.RecordBatch.from_arrays([b.column(0), arrays], names=["id", "bits"])

        self.codes = data.select(F.col("id").cast("long"), "vec").mapInArrow(run, "id long, bits array<long>")
        if path:
            self.codes = keep.written(self.codes, f"{path}/rows")
        self._save(path, points.sparkSession)
        return self

    def knn(self, q: Sequence[float], k: int, extra: int = EXTRA) -> DataFrame:
        if self.codes is None:
            raise RuntimeError("build the index first")
        w = _packed((_query(q, self.metric)[None, :] @ self.planes) >= 0)[0]
        other = F.array(*(F.lit(int(x)) for x in w))
        h = F.aggregate(F.zip_with("bits", other, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
        near = _top(self.codes.select("id", h.cast("double").alias("score")), max(k + extra, self.wide))
        return rerank(near, self.points, q, self.metric, k + extra) if self.wide else near

    def batch(self, queries: DataFrame | Sequence[Sequence[float]], k: int) -> DataFrame:
        """(qid, id, score, rank): every query meets all codes, both in pieces."""
        codes = self._rows()
        size, asked, planes = max(k, self.wide), as_queries(codes, queries, self.metric), self.planes

        def fn(p: pa.Table, q: pa.Table) -> pa.Table:
            bits = p["bits"].combine_chunks()
            w = np.asarray(bits.flatten()).reshape(len(bits), -1)
            own = _packed(join.vectors(q["vec"]) @ planes >= 0)
            scores = lambda lo, hi: (np.bitwise_count(w ^ x).sum(axis=1).astype(float) for x in own[lo:hi])
            return join.best(np.asarray(q["qid"]), np.asarray(p["id"]), scores, size)

        everywhere = F.lit(0).alias("group")
        near = join.ranked(join.meet(codes.select(everywhere, "id", "bits"), asked.select(everywhere, "qid", "vec"), fn, FOUND), size)
        return _reordered(near, self.points, asked, _metric(self.metric), k) if self.wide else near


def _packed(bits: np.ndarray) -> np.ndarray:
    n, m = bits.shape
    words = -(-m // 63)
    padded = np.zeros((n, words * 63), np.int64)
    padded[:, :m] = bits
    return (padded.reshape(n, words, 63) << np.arange(63)).sum(axis=2)


def _merged(far: np.ndarray, items: np.ndarray, row: np.ndarray, item: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (far, items) in ascending order, infinite where empty, with more items put in: each row's least, as many as it had
    room for, and of equal ones those that came first."""
    order = np.argsort(row, kind="stable")
    row, count = row[order], np.bincount(row, minlength=len(far))
    at = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    more, own = np.full((len(far), count.max(initial=0)), np.inf), np.zeros((len(far), count.max(initial=0)), items.dtype)
    more[row, at], own[row, at] = dist[order], item[order]
    far = np.concatenate([far, more], axis=1)
    least = np.argsort(far, axis=1, kind="stable")[:, : items.shape[1]]
    return np.take_along_axis(far, least, axis=1), np.take_along_axis(np.concatenate([items, own], axis=1), least, axis=1)


class _Graph:
    """A layered neighbour graph over one part's vectors. Walks go side by side, a step of all of them at a time, over a table of
    their distances: a walk meets up to two thirds of a part's points, and one product costs less than what they take singly. Points
    are put in by batches, each at most a quarter of those before it, which walk the graph as it was and then also see each other."""

    def __init__(self, x: np.ndarray, m: int, ef: int, seed: int = 9):
        self.x, self.size, self.m, self.ef = x, (x * x).sum(axis=1), m, ef
        rng, n = np.random.default_rng(seed), len(x)
        self.level = np.floor(-np.log(np.maximum(rng.random(n), 1e-12)) / np.log(max(2, m))).astype(int)
        self.links = [np.full((n, m if layer else 2 * m), -1, np.int32) for layer in range(int(self.level.max(initial=0)) + 1)]
        self.walks = max(1, min(WALKS, TABLE // max(1, n)))
        self.entry = 0 if n else -1
        far, done = [np.full(own.shape, np.inf) for own in self.links], min(1, n)
        while done < n:
            size = min(self.walks, max(1, done // 4), n - done)
            self._insert(done, done + size, far)
            done += size

    def _table(self, q: np.ndarray, rows: int) -> np.ndarray:
        """Squared distances to the first points; the last column stands for no point."""
        out = np.full((len(q), rows + 1), np.inf)
        out[:, :rows] = np.maximum((q * q).sum(axis=1)[:, None] + self.size[:rows] - 2 * q @ self.x[:rows].T, 0)
        return out

    def _walk(self, table: np.ndarray, start: np.ndarray, ef: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """(distances, points) of the ef nearest that each walk meets, ascending; empty places are infinite and -1. What was near
        enough to be taken becomes infinite in the table, and so is taken once."""
        every, links = np.arange(len(table)), self.links[layer]
        far, items = np.full((len(table), ef), np.inf), np.full((len(table), ef), -2)  # twice the point, odd until its links are followed
        far[:, 0], items[:, 0] = table[every, start], 2 * start + 1
        table[every, start] = np.inf
        at = every
        while True:
            todo = (items[at] & 1).astype(bool)
            first = todo.argmax(axis=1)
            more = todo[np.arange(len(at)), first]
            at, first = at[more], first[more]
            if not len(at):
                return far, items >> 1
            items[at, first] -= 1
            to = links[items[at, first] >> 1]
            dist = table[at[:, None], to]
            row, place = np.nonzero(dist < far[at, -1:])
            if len(row):
                ids, dist = to[row, place].astype(int), dist[row, place]
                table[at[row], ids] = np.inf
                far[at], items[at] = _merged(far[at], items[at], row, 2 * ids + 1, dist)

    def _insert(self, lo: int, hi: int, far: list[np.ndarray]) -> None:
        new, top, highest, ef = np.arange(lo, hi), self.level[lo:hi], int(self.level[self.entry]), max(self.ef, self.m)
        table, at = self._table(self.x[lo:hi], hi), np.full(hi - lo, self.entry)
        a, b = np.triu_indices(len(new), 1)
        mates = table[a, lo + b]
        for layer in range(max(int(top.max()), highest), -1, -1):
            own, under = np.flatnonzero(top >= layer), np.flatnonzero(top < layer)
            near, found = np.full((len(own), ef), np.inf), np.full((len(own), ef), -1)
            if layer <= highest:
                at[under] = self._walk(table[under], at[under], 1, layer)[1][:, 0]
                near[:, : self.ef], found[:, : self.ef] = self._walk(table[own], at[own], self.ef, layer)
                at[own] = found[:, 0]
            place, both = np.searchsorted(own, np.arange(len(new))), (top[a] >= layer) & (top[b] >= layer)
            one, other = a[both], b[both]
            near, found = _merged(near, found, place[np.r_[one, other]], new[np.r_[other, one]], np.tile(mates[both], 2))
            row, rank = np.nonzero(found[:, : self.m] >= 0)
            source, to, dist = new[own[row]], found[row, rank], np.tile(near[row, rank], 2)
            key, once = np.unique(np.r_[source, to] * len(self.x) + np.r_[to, source], return_index=True)  # links of mates come twice
            rows, row = np.unique(key // len(self.x), return_inverse=True)
            far[layer][rows], self.links[layer][rows] = _merged(far[layer][rows], self.links[layer][rows], row, (key % len(self.x)).astype(np.int32), dist[once])
        if top.max() > highest:
            self.entry = lo + int(top.argmax())

    def knn(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's row, point, squared distance) of the k nearest that are found, query by query, best first."""
        out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        for lo in range(0, len(q) if self.entry >= 0 else 0, self.walks):
            own = q[lo : lo + self.walks]
            table, at = self._table(own, len(self.x)), np.full(len(own), self.entry)
            for layer in range(int(self.level[self.entry]), 0, -1):
                at = self._walk(table.copy(), at, 1, layer)[1][:, 0]
            found = self._walk(table, at, max(k, self.ef), 0)[1][:, :k]
            row, rank = np.nonzero(found >= 0)
            ids = found[row, rank]
            exact = ((self.x[ids] - own[row]) ** 2).sum(axis=1)  # products are good to some 1e-8 of a distance
            order = np.lexsort((exact, row))
            out.append((lo + row[order], ids[order], exact[order]))
        return tuple(np.concatenate(c) for c in zip(*out))


@dataclass
class Graph(Stored):
    """A neighbour graph for each part of about part_rows points, searched in its own task; the parts' best are merged.
    pq_m > 0: the graph stands over vectors rebuilt from product codes."""

    ROWS = "data"
    metric: str = "l2"
    m: int = 32
    ef_construction: int = 40
    ef_search: int = 32
    pq_m: int = 0
    pq_nbits: int = 8
    part_rows: int = 4096
    data: DataFrame | None = field(default=None, repr=False)

    def build(self, points: DataFrame, path: str | None = None) -> Graph:
        """With a path each part's graph is built once and stored there; without, it is built as part of every query."""
        data = _prepared(points, self.metric)
        self.parts = max(1, -(-points.count() // self.part_rows))
        books = None
        if self.pq_m:
            x = np.array([r["vec"] for r in sampling.sample(data, balls.TRAIN_ROWS).select("vec").collect()], float)
            self.pq_m = fitting_blocks(x.shape[1], self.pq_m)
            books = _codebooks(points.sparkSession, x, self.pq_m, max(1, min(self.pq_nbits, int(np.log2(max(2, len(x)))))))
        m, ef = self.m, max(self.ef_construction, self.ef_search)

        def run(t: pa.Table) -> pa.Table:
            ids = np.asarray(t["id"], np.int64)
            order = np.argsort(ids)[np.random.default_rng(11).permutation(len(ids))]  # copies that follow one another would be islands
            ids, x = ids[order], join.vectors(t["vec"])[order]
            if books is not None:
                code = _encode(x, books)
                x = np.concatenate([b[code[:, j]] for j, b in enumerate(books)], axis=1)
            return pa.table({"part": t["part"][:1], "graph": pa.array([pickle.dumps((ids, _Graph(x, m, ef)))], pa.binary())})

        part = F.expr(f"cast(pmod(xxhash64(id), {self.parts}) AS int)").alias("part")
        self.data = data.select(part, F.col("id").cast("long"), "vec").groupBy("part").applyInArrow(run, "part int, graph binary")
        if path:
            self.data = keep.written(self.data, f"{path}/rows")
        self._save(path, points.sparkSession)
        return self

    def knn(self, q: Sequence[float], k: int, extra: int = EXTRA) -> DataFrame:
        if self.data is None:
            raise RuntimeError("build the index first")
        x, size = _query(q, self.metric), k + extra

        def run(batches):
            for b in batches:
                for blob in b.column("graph"):
                    ids, graph = pickle.loads(blob.as_buffer())
                    _, found, far = graph.knn(x[None, :], size)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(np.sqrt(far))], names=["id", "score"])

        return _top(self.data.mapInArrow(run, "id long, score double"), size)

    def batch(self, queries: DataFrame | Sequence[Sequence[float]], k: int) -> DataFrame:
        """(qid, id, score, rank): every query searches every part's graph."""
        data = self._rows()

        def fn(p: pa.Table, q: pa.Table) -> pa.Table:
            ids, graph = pickle.loads(p["graph"][0].as_buffer())
            row, found, far = graph.knn(join.vectors(q["vec"]), k)
            return pa.table({"qid": pa.array(np.asarray(q["qid"], np.int64)[row]), "id": pa.array(ids[found]), "score": pa.array(np.sqrt(far))})

        graphs = data.select(F.col("part").alias("group"), F.col("part").alias("id"), "graph")
        asked = as_queries(data, queries, self.metric).select("qid", "vec", F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))).alias("group"))
        return join.ranked(join.meet(graphs, asked, fn, FOUND), k)
