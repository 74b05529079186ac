"""Exact top-k by inner product: a ball tree a shard, searched best-first by the bound q.c + |q| r.

Vectors are dealt to shards by the nearest of a bounded number of pivots, so that a shard's own ball bounds its scores; a
pivot with many vectors has several shards. Queries go in blocks. In rounds, each query is taken to the shards of the highest
bounds that it has not seen, and to no shard whose bound is under its kth score so far: that score is shared, as the next
round's searches in all shards start from it. The first round takes the best shard, the next a few, the last all that are left.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordinate.llm import common as C

K, LEAF, SHARD_ROWS, BLOCK_QUERIES = 10, 64, 8192, 128
#: Pivots by which vectors are dealt (collected from a sample), roots that are bounded together, blocks that meet one copy of a tree.
PIVOTS, ROOTS, TOGETHER = 1024, 1024, 128
#: The shards that each round takes a query to, by their place in the order of its bounds.
ROUNDS = ((0, 1), (1, 5), (5, 1 << 60))
LEAST, MOST = -(2**63), 2**63 - 1
_TREE = "dim int, shard long, ids binary, vectors binary, copies binary, lo binary, hi binary, center binary, radius binary"
_ROOTS = "dim int, chunk int, shards binary, centers binary, radii binary"
_BLOCK = "dim int, block long, ids binary, vectors binary, copies binary, least binary"
_ASK = "dim int, shard long, block long, at binary, ids binary, vectors binary, least binary"
_FOUND = "dim int, block long, at int, query_id long, vec_id long, score long, copies long"


def build(vectors: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, ...]:
    """(order, lo, hi, center, radius): node i covers order[lo[i]:hi[i]], its children are 2i+1 and 2i+2 where hi > lo.
    A node is split at the middle of its order along the direction between two far points."""
    order = np.arange(len(vectors))
    lo, hi, center, radius = [], [], [], []
    level = [(0, len(vectors))]
    while level:
        below = []
        for a, b in level:
            rows = vectors[order[a:b]]
            c = rows.mean(axis=0) if b > a else np.zeros(vectors.shape[1])
            d = np.sqrt(((rows - c) ** 2).sum(axis=1)) if b > a else np.zeros(0)
            lo.append(a)
            hi.append(b)
            center.append(c)
            radius.append(d.max() if len(d) else 0.0)
            below += [(a, b)] if b - a > leaf else []
        if not below:
            break
        nxt = []
        for a, b in level:
            if b - a > leaf:
                rows = vectors[order[a:b]]
                p = rows[np.argmax(((rows - rows.mean(axis=0)) ** 2).sum(axis=1))]
                q = rows[np.argmax(((rows - p) ** 2).sum(axis=1))]
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(rows @ (q - p), mid)] if (p != q).any() else order[a:b]
                nxt += [(a, a + mid), (a + mid, b)]
            else:
                nxt += [(a, a), (a, a)]  # nothing below a leaf
        level = nxt
    return order, np.array(lo), np.array(hi), np.array(center).reshape(len(lo), -1), np.array(radius)


def scaled(e: np.ndarray, exact: bool) -> np.ndarray:
    """floor(1024 * x): as floats, or as whole numbers of any size."""
    with np.errstate(over="ignore"):
        f = np.floor(e * 1024)
    if not exact:
        return f
    if np.abs(f).max(initial=0) < 2.0**62:
        return f.astype(np.int64)
    return np.array([int(np.floor(x * 1024)) if abs(x) < 2.0**52 else int(x) * 1024 for x in e.ravel().tolist()], object).reshape(e.shape)


def paired(v: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as integers of a kind in which their products are exact: float64, int64, or Python's."""
    most = lambda x: float(np.abs(x).max(initial=0)) * 1024 + 1
    with np.errstate(over="ignore"):
        reach = most(v) * most(q) * max(1, v.shape[1])
    if reach < 2.0**52:
        return scaled(v, False), scaled(q, False)
    v, q = scaled(v, True), scaled(q, True)
    return (v, q) if reach < 2.0**62 else (v.astype(object), q.astype(object))


def bounds(q: np.ndarray, center: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """(queries, balls): no score of a ball's vector is above; with slack for rounding."""
    with np.errstate(all="ignore"):
        norm = np.sqrt((q**2).sum(axis=1))
        reach = q @ center.T + norm[:, None] * radius
        out = reach + 1e-9 * (np.abs(reach) + norm[:, None] * (radius + np.abs(center).max(initial=0))) + 1e-6
    return np.maximum(np.where(np.isnan(out), np.inf, out), float(LEAST))


def search(q: np.ndarray, own: np.ndarray, least: float, k: int, vectors, ids, copies, lo, hi, leaf: int, bound: np.ndarray) -> list[tuple[int, int]]:
    """The (score, -id) of the k best rows, best-first over nodes by upper bound. own: the rows of the query's id and vector,
    one of which is the query itself; least: a score that k others reach already. Scores beyond a long are the nearest long."""
    best: list[tuple[int, int]] = []
    heap = [(-bound[0], 0)]
    while heap:
        top, node = heapq.heappop(heap)
        kth = max(least, best[0][0] if len(best) == k else -np.inf)
        if -top < kth:
            break
        if hi[node] - lo[node] > leaf:
            for child in (2 * node + 1, 2 * node + 2):
                if bound[child] >= kth:
                    heapq.heappush(heap, (-bound[child], child))
            continue
        a, b = lo[node], hi[node]
        scores = vectors[a:b] @ q
        for i in np.flatnonzero(scores >= kth).tolist():
            x = (min(MOST, max(LEAST, int(scores[i]))), -int(ids[a + i]))
            for _ in range(min(k, int(copies[a + i]) - (a + i in own))):
                if len(best) < k:
                    heapq.heappush(best, x)
                elif x > best[0]:
                    heapq.heapreplace(best, x)
                else:
                    break
    return best


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.zeros((0, dim)), *(np.asarray(c.flatten(), float).reshape(len(c), dim) for c in chunks)])


def _row(names: str, values: list[tuple]) -> pa.Table:
    """A table of these rows; arrays become bytes."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split(" ") for x in names.split(", ")]
    cells = [[C.packed(x) if isinstance(x, np.ndarray) else x for x in v] for v in values]
    return pa.table({n: pa.array([c[i] for c in cells], kinds[t]) for i, (n, t) in enumerate(fields)})


def _nearest(pivots: dict[int, np.ndarray]):
    """Each row's pivot: the nearest of its dimension."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims, out = np.asarray(batch.column("dim")), np.zeros(batch.num_rows, np.int32)
        for dim in np.unique(dims).tolist():
            if dim and dim in pivots:
                rows = np.flatnonzero(dims == dim)
                c = pivots[dim]
                with np.errstate(all="ignore"):
                    far = (c**2).sum(axis=1) - 2 * _matrix(batch.column("e").take(pa.array(rows)), dim) @ c.T
                out[rows] = np.nan_to_num(far, nan=np.inf).argmin(axis=1)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "pivot"])

    return run


def _tree(leaf: int):
    def run(t: pa.Table) -> pa.Table:
        dim, shard = t["dim"][0].as_py(), t["shard"][0].as_py()
        e, ids, copies = _matrix(t["e"], dim), np.asarray(t["id"], np.int64), np.asarray(t["copies"], np.int64)
        with np.errstate(all="ignore"):
            order, lo, hi, center, radius = build(np.nan_to_num(scaled(e, False)), leaf)
        return _row(_TREE, [(dim, shard, ids[order], e[order], copies[order], lo.astype(np.int64), hi.astype(np.int64), center, radius)])

    return run


def _roots(t: pa.Table) -> pa.Table:
    dim = t["dim"][0].as_py()
    first = [(np.frombuffer(c, float)[:dim], np.frombuffer(r, float)[0]) for c, r in zip(t["center"].to_pylist(), t["radius"].to_pylist())]
    return _row(_ROOTS, [(dim, t["chunk"][0].as_py(), np.asarray(t["shard"], np.int64), np.array([c for c, _ in first]), np.array([r for _, r in first]))])


def _block(t: pa.Table) -> pa.Table:
    dim = t["dim"][0].as_py()
    return _row(_BLOCK, [(dim, t["block"][0].as_py(), np.asarray(t["id"], np.int64), _matrix(t["e"], dim), np.asarray(t["copies"], np.int64), np.full(len(t), -np.inf))])


def _asks(first: int, upto: int):
    """Which of a block's queries go to which shard in this round: by place in the order of their bounds, and bounds that reach the kth score."""

    def run(blocks: pa.Table, roots: pa.Table) -> pa.Table:
        out = []
        for r in roots.to_pylist():
            shards, radius = np.frombuffer(r["shards"], np.int64), np.frombuffer(r["radii"], float)
            center = np.frombuffer(r["centers"], float).reshape(len(shards), -1)
            for b in blocks.to_pylist():
                ids, least = np.frombuffer(b["ids"], np.int64), np.frombuffer(b["least"], float)
                e = np.frombuffer(b["vectors"], float).reshape(len(ids), b["dim"])
                bound = bounds(scaled(e, False), center, radius)
                place = np.empty_like(bound, dtype=np.int64)
                np.put_along_axis(place, np.argsort(-bound, axis=1, kind="stable"), np.arange(len(shards))[None, :], axis=1)
                go = (place >= first) & (place < upto) & (bound >= least[:, None])
                for j in np.flatnonzero(go.any(axis=0)).tolist():
                    at = np.flatnonzero(go[:, j])
                    out.append((b["dim"], int(shards[j]), b["block"], at, ids[at], e[at], least[at]))
        return _row(_ASK, out)

    return run


def _searched(k: int, leaf: int):
    def run(asks: pa.Table, trees: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for t in trees.to_pylist():
            ids, copies, lo, hi = (np.frombuffer(t[x], np.int64) for x in ("ids", "copies", "lo", "hi"))
            e, radius = np.frombuffer(t["vectors"], float).reshape(len(ids), t["dim"]), np.frombuffer(t["radius"], float)
            center = np.frombuffer(t["center"], float).reshape(len(radius), t["dim"])
            order = np.argsort(ids, kind="stable")
            for a in asks.to_pylist():
                qids, least, at = np.frombuffer(a["ids"], np.int64), np.frombuffer(a["least"], float), np.frombuffer(a["at"], np.int64)
                qe = np.frombuffer(a["vectors"], float).reshape(len(qids), a["dim"])
                v, q = paired(e, qe)
                bound = np.where(hi > lo, bounds(scaled(qe, False), center, radius), -np.inf)
                from_, to = np.searchsorted(ids[order], qids), np.searchsorted(ids[order], qids, "right")
                for i in range(len(qids)):
                    own = [j for j in order[from_[i] : to[i]].tolist() if (e[j] == qe[i]).all()]
                    best = search(q[i], own, float(least[i]), k, v, ids, copies, lo, hi, leaf, bound[i])
                    out += [(a["dim"], a["block"], int(at[i]), int(qids[i]), -neg, s, 1) for s, neg in best]
        return _row(_FOUND, out)

    return run


def _raised(k: int):
    """A block with its queries' kth scores as all searches so far have them."""

    def run(blocks: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        at, score = np.asarray(found["at"], np.int64), np.asarray(found["score"], np.int64)
        order = np.lexsort((-score, at))
        at, score = at[order], score[order]
        begin = np.searchsorted(at, at)
        kth = np.arange(len(at)) - begin == k - 1
        for b in blocks.to_pylist():
            least = np.frombuffer(b["least"], float).copy()
            least[at[kth]] = np.maximum(least[at[kth]], np.nextafter(score[kth].astype(float), -np.inf))  # a float may be above the score
            out.append((b["dim"], b["block"], b["ids"], b["vectors"], b["copies"], least))
        return _row(_BLOCK, out)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, leaf: int = LEAF, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query's k highest integer inner products, ties to the smaller vec_id.

    vectors, queries: (vec_id, embedding). Components become floor(1024 * x). Vectors that are null, or hold a null or
    non-finite component, and rows with a null id take no part; a query meets only vectors of its own length. Each query
    row has an answer of its own: its candidates are all rows but one of the same id and vector (itself), so other rows of
    its id are among them, and a repeated row is a candidate each time. Sums are exact whatever their size; a score beyond
    a long is given, and ranked, as the nearest long. Fewer than k candidates: all. Empty: no rows.
    """
    spark = vectors.sparkSession

    def whole(df: DataFrame) -> DataFrame:
        x = df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("e")).filter("id IS NOT NULL AND e IS NOT NULL")
        x = x.filter(~F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
        return x.select("id", "e", F.size("e").alias("dim"))

    v = whole(vectors)
    wanted = max(1, min(PIVOTS, v.count() // shard_rows))
    pivots: dict[int, list] = {}
    for r in C.sampled(v.select("e", "dim"), wanted).collect():  # at most PIVOTS rows
        pivots.setdefault(r["dim"], []).append(r["e"])
    near = _nearest({d: np.array(x, float).reshape(len(x), d) for d, x in pivots.items()})

    def dealt(x: DataFrame, rows: int, name: str, seed: int) -> DataFrame:
        """Distinct rows, how often each is there, and their number: pivot and, where a pivot has more than `rows`, a piece of it."""
        one = C.stored(C.arrow_map(x.groupBy("id", "e", "dim").agg(F.count("*").alias("copies")), near, "id long, e array<double>, dim int, copies long, pivot int"))
        many = one.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / rows).alias("pieces"))
        number = F.shiftleft(F.col("pivot").cast("long"), 32) + F.expr(f"pmod(xxhash64(id, e, {seed}), pieces)")
        return one.join(many, ["dim", "pivot"]).select("dim", number.alias(name), "id", "e", "copies")

    trees = C.stored(dealt(v, shard_rows, "shard", 7).groupBy("dim", "shard").applyInArrow(_tree(leaf), _TREE))
    blocks = C.stored(dealt(whole(queries), block_queries, "block", 11).groupBy("dim", "block").applyInArrow(_block, _BLOCK))
    shards, m = trees.count(), blocks.count()
    chunks, salts = max(1, -(-shards // ROOTS)), max(1, -(-m // TOGETHER))
    roots = C.stored(trees.select("dim", "shard", "center", "radius", F.expr(f"cast(pmod(xxhash64(shard, 5), {chunks}) AS int) AS chunk")).groupBy("dim", "chunk").applyInArrow(_roots, _ROOTS))
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    salt = F.expr(f"cast(pmod(xxhash64(block, 13), {salts}) AS int)").alias("salt")

    def met(left: DataFrame, right: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(fn, schema)

    found = []
    for first, upto in ROUNDS:
        if first and first >= shards:
            break
        asks = met(blocks.select("*", salt).select("*", each(chunks, "chunk")), roots.select("*", each(salts, "salt")), ["dim", "chunk", "salt"], _asks(first, upto), _ASK)
        hits = met(asks.select("*", salt), trees.select("*", each(salts, "salt")), ["dim", "shard", "salt"], _searched(k, leaf), _FOUND)
        found.append(C.stored(hits))
        if upto < shards:
            all_found = found[0] if len(found) == 1 else found[0].unionByName(found[1])
            blocks = C.stored(met(blocks, all_found, ["dim", "block"], _raised(k), _BLOCK))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    rank = F.row_number().over(Window.partitionBy("dim", "block", "at").orderBy(F.desc("score"), "vec_id"))
    ranked = out.withColumn("rank", rank).filter(F.col("rank") <= k)
    return _repeated(ranked, blocks).select("query_id", "rank", "vec_id", "score")


def _repeated(ranked: DataFrame, blocks: DataFrame) -> DataFrame:
    """An answer for each of the rows that one distinct query stands for."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(r["dim"], r["block"], i, int(n)) for r in batch.to_pylist() for i, n in enumerate(np.frombuffer(r["copies"], np.int64)) if n > 1]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 4, (pa.int32(), pa.int64(), pa.int32(), pa.int64()))], names=["dim", "block", "at", "rows"])

    often = C.arrow_map(blocks.select("dim", "block", "copies"), run, "dim int, block long, at int, rows long")
    return ranked.join(often, ["dim", "block", "at"], "left").withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("rows", F.lit(1).cast("long")))))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(e, e.filter("vec_id % 100 = 0"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
