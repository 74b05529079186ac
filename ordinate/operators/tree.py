"""Trees that grow with their table, built and stored on the cluster: balls of several levels, and cells by splits.

Both keep a table a level (or one of all leaves) and the points in the order of the leaves, in folders of bounded rows. A query
goes down the levels as joins of tables, and what it is left with says which folders are read.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinate.functions import vectors as V
from ordinate.operators import join, keep, ranges, rank, sampling

#: Most nodes of the top level, which is broadcast; most parts that a query names one by one.
TOP, NAMED = 1024, 10_000
#: Rows by which a cell's splits are chosen, and most cells that it falls into at once.
SAMPLE, CELLS = 16_384, 256


@dataclass
class BallTree:
    """levels[0] are the lowest balls, about n / fan of them, each level above has about a fan-th as many: (node, parent, center,
    radius, n), at the lowest also (first, last), the parts that it lies in. members (id, vec, node, far, part)."""

    members: DataFrame
    levels: list[DataFrame]
    n: int
    sample: DataFrame = field(repr=False)
    eps: float = 0.02

    @classmethod
    def build(cls, points: DataFrame, fan: int = 32, path: str | None = None, eps: float = 0.02, seed: int = 42, top: int = TOP, file_rows: int = keep.FILE_ROWS) -> BallTree:
        """Centres of the levels are nested samples by a hash of the id: a share of fan^-l for level l. Every point goes down
        from the top, which is broadcast, to the nearest centre among the children of the one before, by a join a level, so
        that it is compared with some fan centres a level however many there are. Rows with a null id or vector are left out;
        ids are unique."""
        data = join.prepared(points, "id", "l2").withColumn("h", sampling.hashed(F.col("id"), seed))
        most = 12
        limit = [int(4294967296.0 / fan**level) for level in range(1, most + 1)]
        n, least, *counts = data.agg(F.count("*"), F.min("h"), *(F.count_if(F.col("h") < t) for t in limit)).first()
        if not n:
            empty = points.sparkSession.createDataFrame([], "node long, parent long, center array<double>, radius double, n long, first int, last int")
            return cls(data.select("id", "vec", F.lit(0).cast("long").alias("node"), F.lit(0.0).alias("far"), F.lit(0).alias("part")), [empty], 0, data, eps)
        depth = next(i for i, c in enumerate(counts) if c <= top)
        limit, counts = limit[: depth + 1], counts[: depth + 1]
        while len(limit) > 1 and not counts[-1]:
            limit, counts = limit[:-1], counts[:-1]
        if not counts[-1]:
            limit[-1] = int(least) + 1  # fewer points than fan: one ball
        state, edges = keep.stored(_by_top(data, limit[-1])), []
        children = None
        for level in range(len(limit) - 1, -1, -1):
            if level < len(limit) - 1:
                met = join.meet(children, state.select(F.col("node").alias("group"), F.col("id").alias("qid"), "vec", "h"), _nearest_child, "id long, vec array<double>, h long, node long, far double", once=True)
                state = keep.stored(met)
            # nodes of the next level under each of these: centres that stand here, and each node itself
            if level:
                own = state.filter((F.col("h") < limit[level - 1]) & (F.col("h") >= limit[level])).select(F.col("node").alias("group"), "id", "vec", "far")
                same = state.filter(F.col("h") < limit[level]).select(F.col("id").alias("group"), "id", "vec", F.lit(0.0).alias("far"))
                children = keep.stored(own.unionByName(same))
                edges.append(children.select(F.col("id").alias("node"), F.col("group").alias("parent"), F.col("vec").alias("center"), "far"))
        kept = cls._stored(state, edges, data, limit, n, path or f"{keep.shared_dir(points.sparkSession)}/tree-{uuid.uuid4().hex}", file_rows)
        size = min(n, sampling.sample_size(len(data.first()["vec"]), eps, constant=sampling.NEIGHBOUR_CONSTANT), 16_384)
        return cls(kept[0], kept[1], n, sampling.sample(data.select("id", "vec"), size, seed=seed), eps)

    @classmethod
    def _stored(cls, state: DataFrame, edges: list[DataFrame], data: DataFrame, limit: list[int], n: int, path: str, file_rows: int) -> tuple[DataFrame, list[DataFrame]]:
        """Members in the order of their way from the top, and the tables of the levels with radii from below."""
        tops = data.filter(F.col("h") < limit[-1]).select(F.col("id").alias("node"), F.lit(None).cast("long").alias("parent"), F.col("vec").alias("center"), F.lit(0.0).alias("far"))
        down = [*edges[::-1], tops]  # from the lowest level up
        way = down[0].select("node", F.array("parent", "node").alias("way"), F.col("parent").alias("up"))
        for above in down[1:-1]:
            way = way.join(above.select(F.col("node").alias("up"), F.col("parent").alias("over")), "up").select("node", F.concat(F.array("over"), "way").alias("way"), F.col("over").alias("up"))
        placed = state.select("id", "vec", "node", "far").join(keep.stored(way.select("node", "way")), "node")
        members = keep.parted(placed, ["way", "id"], n, file_rows, f"{path}/members").drop("way")
        low = members.groupBy("node").agg(F.max("far").alias("radius"), F.count("*").alias("n"), F.min("part").alias("first"), F.max("part").alias("last"))
        levels = []
        for level, own in enumerate(down):
            table = own.select("node", "parent", "center", F.col("far").alias("off")).join(low, "node")
            table = keep.written(table, f"{path}/level-{level}")
            levels.append(table.drop("off"))
            up = F.max(F.col("off") + F.col("radius")).alias("radius")
            low = table.groupBy(F.col("parent").alias("node")).agg(up, F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
        return members, levels

    def descend(self, w: Sequence[float], lo: float, hi: float) -> DataFrame:
        """(node, whole, first, last): the lowest balls that the slab meets; whole: the slab holds all of the ball, or of one
        above it."""
        s, size = V.dot(F.col("center"), w), float(np.linalg.norm(w))
        reach = F.col("radius") * size + F.lit(1e-9) * (1 + F.col("radius") * size)
        active = None
        for table in self.levels[::-1]:
            own = table.select("node", "parent", "first", "last", ranges.ball_meets(F.col("center"), F.col("radius"), w, lo, hi).alias("meets"), ((s - reach >= lo) & (s + reach <= hi)).alias("inside"))
            if active is not None:
                own = own.join(active.select(F.col("node").alias("parent"), "whole"), "parent")
                active = own.filter(F.col("whole") | F.col("meets")).select("node", (F.col("whole") | F.col("inside")).alias("whole"), "first", "last")
            else:
                active = own.filter("meets").select("node", F.col("inside").alias("whole"), "first", "last")
        return active

    def read(self, balls: DataFrame) -> DataFrame:
        """The members in the parts of these balls; beyond NAMED parts all are read."""
        return _in_parts(self.members, balls)

    def stripe(self, w: Sequence[float], lo: float, hi: float) -> DataFrame:
        """(id, score) of the points in the slab; those of whole balls without a test."""
        active = self.descend(w, lo, hi)
        near = self.read(active).join(active.select("node", "whole"), "node")
        return near.select("id", V.dot(F.col("vec"), w).alias("score"), "whole").filter(F.col("whole") | F.col("score").between(lo, hi)).drop("whole")

    def candidates(self, w: Sequence[float], k: int) -> DataFrame:
        """The stripe in which rank k (from 1, descending) should lie, in the order of ids."""
        lo, hi = rank.find_stripe(self.sample, V.dot(F.col("vec"), w), k, self.n, self.eps)
        return self.stripe(w, lo, hi).select("id").orderBy("id")

    def check(self) -> bool:
        """Every point is inside its ball, every ball inside its parent's, and counts add up at every level."""
        low = self.levels[0].select("node", "center", "radius")
        loose = self.members.join(low, "node").filter(V.l2_distance(F.col("vec"), F.col("center")) > F.col("radius") + 1e-6)
        whole = all(t.agg(F.sum("n")).first()[0] == self.n for t in self.levels)
        inside = True
        for own, above in zip(self.levels, self.levels[1:]):
            up = above.select(F.col("node").alias("parent"), F.col("center").alias("c"), F.col("radius").alias("r"))
            inside = inside and own.join(up, "parent").filter(V.l2_distance(F.col("center"), F.col("c")) + F.col("radius") > F.col("r") + 1e-6).isEmpty() and own.join(up, "parent", "left_anti").isEmpty()
        return whole and inside and loose.isEmpty() and self.members.count() == self.n


def _in_parts(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members in the parts from first to last of some nodes; beyond NAMED parts all."""
    parts = [r[0] for r in nodes.select(F.explode(F.sequence("first", "last")).alias("part")).distinct().limit(NAMED + 1).collect()]
    return members.filter(F.col("part").isin(parts)) if len(parts) <= NAMED else members


def _by_top(data: DataFrame, limit: int) -> DataFrame:
    """(id, vec, h, node, far): each point with its nearest centre of the top level, of which there are at most TOP."""
    rows = data.filter(F.col("h") < limit).orderBy("h", "id").select("id", "vec").collect()
    shared = data.sparkSession.sparkContext.broadcast((np.array([r["id"] for r in rows], np.int64), np.array([r["vec"] for r in rows], float)))

    def run(batches):
        ids, centers = shared.value
        for b in batches:
            x = join.vectors(b.column("vec"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "vec", "h")), *_nearest(x, np.asarray(b.column("id")), ids, centers)], names=["id", "vec", "h", "node", "far"])

    return data.select("id", "vec", "h").mapInArrow(run, "id long, vec array<double>, h long, node long, far double")


def _nearest(x: np.ndarray, own: np.ndarray, ids: np.ndarray, centers: np.ndarray, block: int = 2048) -> tuple[pa.Array, pa.Array]:
    """The nearest centre's id, and its distance; a centre is its own."""
    node, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    place = {int(i): j for j, i in enumerate(ids)}
    for lo in range(0, len(x), block):
        part = x[lo : lo + block]
        at = ((centers**2).sum(axis=1) - 2 * part @ centers.T).argmin(axis=1)
        at = np.array([place.get(int(i), int(j)) for i, j in zip(own[lo : lo + block], at)], int)
        node[lo : lo + block], far[lo : lo + block] = ids[at], np.sqrt(((part - centers[at]) ** 2).sum(axis=1))
    return pa.array(node), pa.array(far)


def _nearest_child(p: pa.Table, q: pa.Table) -> pa.Table:
    near = _nearest(join.vectors(q["vec"]), np.asarray(q["qid"]), np.asarray(p["id"]), join.vectors(p["vec"]))
    return pa.table({"id": q["qid"], "vec": q["vec"], "h": q["h"], "node": near[0], "far": near[1]})


# Cells ------------------------------------------------------------------------------------------------------------------


def best_cut(x: np.ndarray, seed: int, tries: int = 5) -> tuple[np.ndarray, float] | None:
    """(normal, threshold) of the most even of all coordinates' 0.3, 0.5 and 0.7 quantiles and `tries` random directions' middles;
    scores up to the threshold go left. None if no cut parts the rows."""
    rng, n, d = np.random.default_rng(seed), len(x), x.shape[1]
    spread = np.maximum(np.ptp(x, axis=0), 1e-300)
    normals = [(np.eye(d)[j], q) for j in range(d) for q in (0.3, 0.5, 0.7)] + [(v / np.linalg.norm(v), 0.5) for v in rng.normal(size=(tries, d)) / spread]
    best, even = None, n
    for w, q in normals:
        s = np.sort(x @ w)
        at = s[min(n - 1, int(q * n))]
        for t in (at, s[np.searchsorted(s, at) - 1] if s[0] < at else at):  # ties may lie on either side
            left = int(np.searchsorted(s, t, "right"))
            if 0 < left < n and abs(2 * left - n) < even:
                best, even = (w, float(t)), abs(2 * left - n)
    return best


def _subtree(x: np.ndarray, rows: float, most: int, seed: int) -> tuple:
    """Nested (normal, threshold, left, right), leaves by number, until each has at most `rows` of the sampled rows."""
    number = 0

    def grown(own: np.ndarray, cells: int, seed: int):
        nonlocal number
        cut = best_cut(own, seed) if len(own) > rows and cells > 1 else None
        if cut is None:
            number += 1
            return number - 1
        left = own @ cut[0] <= cut[1]
        return (*cut, grown(own[left], cells // 2, 2 * seed + 1), grown(own[~left], cells - cells // 2, 2 * seed + 2))

    tree = grown(x, most, seed)
    return tree, number


def _leaf(tree, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int32)
    todo = [(tree, np.arange(len(x)))]
    while todo:
        node, at = todo.pop()
        if isinstance(node, tuple):
            left = x[at] @ node[0] <= node[1]
            todo += [(node[2], at[left]), (node[3], at[~left])]
        else:
            out[at] = node
    return out


@dataclass
class PartitionTree:
    """leaves (cell, n, lo_c, hi_c, first, last) and members (the points with cell and part; first = last, as a leaf lies whole in
    one part). A cell's name is its way down, two hexadecimal digits for each round of splitting, so the nodes above a leaf are
    the beginnings of its name. rewritten and appended count the parts that the last insert wrote anew or added rows to."""

    members: DataFrame
    leaves: DataFrame
    columns: list[str]
    id_column: str
    leaf_rows: int
    file_rows: int
    path: str
    seed: int = 42
    turns: int = 0
    rewritten: int = 0
    appended: int = 0

    @classmethod
    def build(cls, df: DataFrame, columns: Sequence[str], id_column: str = "id", leaf_rows: int = SAMPLE, path: str | None = None, file_rows: int = keep.FILE_ROWS, seed: int = 42) -> PartitionTree:
        """All cells of over leaf_rows rows are split at once, round by round, each by a tree of cuts over a bounded sample of
        its own rows into up to CELLS cells. A cell whose sampled rows no cut parts is split no further once all its rows are
        equal; else by other samples. Points with a null coordinate are left out."""
        own = cls(df, df, list(columns), id_column, leaf_rows, file_rows, path or f"{keep.shared_dir(df.sparkSession)}/tree-{uuid.uuid4().hex}", seed)
        out, own.turns = own._grown(own._clean(df).withColumn("cell", F.lit("")), 0)
        own._write(out, 0, "overwrite")
        own._publish(own._stats(own.members))
        return own

    def _clean(self, df: DataFrame) -> DataFrame:
        return df.filter(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in self.columns))

    def _grown(self, state: DataFrame, turn: int) -> tuple[DataFrame, int]:
        """state with the names of its cells, split until none has over leaf_rows rows that differ."""
        done, state = [], keep.stored(state)
        while True:
            ends = [F.when(F.min(c) < F.max(c), F.struct(F.lit(i).alias("at"), F.min(c).cast("double").alias("least"))) for i, c in enumerate(self.columns)]
            counts = state.groupBy("cell").agg(F.count("*").alias("rows"), F.coalesce(*ends).alias("cut"))
            open_cells = keep.stored(counts.filter(F.col("cut").isNotNull() & (F.col("rows") > self.leaf_rows)))
            if open_cells.isEmpty():
                done.append(state)
                break
            done.append(state.join(F.broadcast(open_cells.select("cell")), "cell", "left_anti"))
            rest = state.join(F.broadcast(open_cells), "cell")
            state, turn = keep.stored(self._split(rest, self.columns, self.id_column, self.leaf_rows, self.seed + 1000 * turn)), turn + 1
        out = done[0]
        for x in done[1:]:
            out = out.unionByName(x)
        return out, turn

    def _write(self, rows: DataFrame, first: int, mode: str) -> None:
        """rows into parts numbered from `first`, each of whole leaves in the order of their names. A leaf of more rows than a
        file (they are all equal) is written by several tasks."""
        cells = rank.ranked(rows.groupBy("cell").agg(F.count("*").alias("n")), "cell", "n")
        part = keep.stored(cells.select("cell", (F.lit(first) + F.expr(f"before div {self.file_rows}")).cast("int").alias("part"), F.ceil(F.col("n") / self.file_rows).cast("int").alias("files")))
        total = rows.count()
        if not total:
            self.members = keep.written(rows.withColumn("part", F.lit(0)), f"{self.path}/members")
            return
        placed = rows.join(F.broadcast(part), "cell").withColumn("file", F.pmod(F.xxhash64(self.id_column), "files")).drop("files")
        dealt = placed.repartition(max(1, -(-total // self.file_rows)), "part", "file").sortWithinPartitions("part", "cell").drop("file")
        dealt.write.mode(mode).partitionBy("part").parquet(f"{self.path}/members")
        self.members = rows.sparkSession.read.parquet(f"{self.path}/members")

    def _stats(self, rows: DataFrame) -> DataFrame:
        ends = (f(c).alias(f"{s}_{c}") for c in self.columns for s, f in (("lo", F.min), ("hi", F.max)))
        return rows.groupBy("cell").agg(F.count("*").alias("n"), *ends, F.min("part").alias("first"), F.max("part").alias("last"))

    def _publish(self, leaves: DataFrame) -> None:
        """The leaves' table anew, under a name of its own: readers of the one before keep it."""
        self.leaves = keep.written(leaves, f"{self.path}/leaves-{uuid.uuid4().hex}")

    def insert(self, df: DataFrame) -> PartitionTree:
        """The tree with more points. Each goes down the nodes to the child whose box it widens least. Leaves that stay within
        leaf_rows get their rows as further files of their part; the parts of those that overflow are read, split and written
        under new numbers, and no leaf names the old ones any more, which earlier trees may still read."""
        rows = keep.stored(self._chosen(self._clean(df)))
        more = rows.groupBy("cell").agg(F.count("*").alias("m"), *(f(c).alias(f"{s}_{c}") for c in self.columns for s, f in (("l", F.min), ("h", F.max))))
        grown = self.leaves.join(more, "cell", "full").withColumn("n", F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0)))
        for c in self.columns:
            grown = grown.withColumn(f"lo_{c}", F.least(f"lo_{c}", f"l_{c}")).withColumn(f"hi_{c}", F.greatest(f"hi_{c}", f"h_{c}"))
        grown = keep.stored(grown)
        differ = " OR ".join(f"`lo_{c}` < `hi_{c}`" for c in self.columns)
        over = (F.col("n") > self.leaf_rows) & F.expr(differ) & F.col("m").isNotNull() | F.col("first").isNull()
        touched = keep.stored(grown.filter(over).select("first", "last").distinct())
        moved = keep.stored(grown.join(F.broadcast(touched.select("first")), "first", "left_semi").select("cell").unionByName(grown.filter("first IS NULL").select("cell")))
        out = PartitionTree(self.members, self.leaves, self.columns, self.id_column, self.leaf_rows, self.file_rows, self.path, self.seed, self.turns)
        names = self.members.columns
        stay = rows.join(F.broadcast(moved), "cell", "left_anti").join(F.broadcast(self.leaves.select("cell", F.col("first").alias("part"))), "cell").select(*names)
        adds = stay.select("part").distinct().count()
        kept = grown.join(F.broadcast(moved), "cell", "left_anti").select(*self.leaves.columns)
        fresh = rows.join(F.broadcast(moved), "cell", "left_semi").select(*(c for c in names if c != "part"))
        anew = touched.filter("first IS NOT NULL").count()
        old = _in_parts(self.members, touched.filter("first IS NOT NULL")).join(F.broadcast(touched.select(F.col("first").alias("part"))), "part", "left_semi").drop("part") if anew else None
        if adds:
            stay.repartition("part").write.mode("append").partitionBy("part").parquet(f"{self.path}/members")
        if not moved.isEmpty():
            split, out.turns = out._grown(fresh.unionByName(old) if anew else fresh, self.turns)
            first = 1 + (self.members.agg(F.max("part")).first()[0] or 0)
            out._write(split, first, "append")
            kept = kept.unionByName(out._stats(out.members.filter(F.col("part") >= first)).select(*kept.columns))
        else:
            out.members = df.sparkSession.read.parquet(f"{self.path}/members")
        out._publish(kept)
        out.rewritten, out.appended = anew, adds
        return out

    def _chosen(self, df: DataFrame) -> DataFrame:
        """df with the leaf that each point goes to. From the root down, a point meets the children of its node, up to CELLS."""
        names, columns = df.columns, self.columns
        state = df.withColumn("cell", F.lit(""))
        deep = (self.leaves.agg(F.max(F.length("cell"))).first()[0] or 0) // 2
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

        def chosen(p: pa.Table, q: pa.Table) -> pa.Table:
            lo, hi = (np.stack([np.asarray(p[f"{s}_{c}"], float) for c in columns], axis=1) for s in ("lo", "hi"))
            x = np.stack([np.asarray(q[c].cast(pa.float64()), float) for c in columns], axis=1)
            order = np.lexsort((np.array(p["cell"].to_pylist()), (hi - lo).sum(axis=1)))
            lo, hi, cells = lo[order], hi[order], np.array(p["cell"].to_pylist())[order]
            own = []
            for at in range(0, len(x), 4096):
                y = x[at : at + 4096, None, :]
                own.append((np.maximum(lo - y, 0) + np.maximum(y - hi, 0)).sum(axis=2).argmin(axis=1))
            return pa.table({**{n: q[n] for n in names}, "cell": pa.array(cells[np.concatenate(own)].tolist(), pa.string())})

        for level in range(deep):
            name, above = F.left("cell", F.lit(2 * level + 2)), F.left("cell", F.lit(2 * level))
            boxes = [f(f"{s}_{c}").alias(f"{s}_{c}") for c in columns for s, f in (("lo", F.min), ("hi", F.max))]
            nodes = self.leaves.filter(F.length("cell") > 2 * level).groupBy(above.alias("group"), name.alias("name")).agg(*boxes)
            children = keep.stored(nodes.withColumnRenamed("name", "cell").withColumn("id", F.xxhash64("cell")))
            state = keep.stored(state)
            inner = children.select("group").distinct()
            asked = state.withColumnRenamed("cell", "group").withColumn("qid", F.xxhash64(self.id_column))
            down = join.meet(children, asked, chosen, f"{kinds}, cell string", query_rows=4 * join.POINTS)
            state = down.unionByName(state.join(F.broadcast(inner.withColumnRenamed("group", "cell")), "cell", "left_anti").select(*names, "cell"))
        return state

    @staticmethod
    def _split(rest: DataFrame, columns: list[str], id_column: str, leaf_rows: int, seed: int) -> DataFrame:
        """rest (with its cell and the cell's rows) in its new cells."""
        share = F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("rows"))
        drawn = rest.filter(sampling.hashed(F.xxhash64(id_column, F.lit(seed)), seed) / F.lit(4294967296.0) <= share)
        names = [f for f in rest.columns if f not in ("cell", "rows", "cut")]

        def grown(t: pa.Table) -> pa.Table:
            x = np.stack([np.asarray(t[c], float) for c in columns], axis=1)
            n = t["rows"][0].as_py()
            tree, cells = _subtree(x, max(1.0, leaf_rows * min(1.0, SAMPLE / n) * 0.75), CELLS, seed)
            if cells == 1:
                cut = t["cut"][0].as_py()
                tree = (np.eye(len(columns))[cut["at"]], cut["least"], 0, 1)
            return pa.table({"group": t["cell"][:1], "id": pa.array([0], pa.int64()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

        trees = keep.stored(drawn.select("cell", "rows", "cut", *(F.col(c).cast("double").alias(c) for c in columns)).groupBy("cell").applyInArrow(grown, "group string, id long, tree binary"))

        def placed(p: pa.Table, q: pa.Table) -> pa.Table:
            x = np.stack([np.asarray(q[c].cast(pa.float64()), float) for c in columns], axis=1)
            leaf = _leaf(pickle.loads(p["tree"][0].as_py()), x)
            cell = pa.array([f"{g}{i:02x}" for g, i in zip(q["group"].to_pylist(), leaf.tolist())], pa.string())
            return pa.table({"cell": cell, **{n: q[n] for n in names}})

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.select(*names).schema)
        asked = rest.drop("rows", "cut").withColumnRenamed("cell", "group").withColumn("qid", F.xxhash64(id_column))
        return join.meet(trees, asked, placed, f"cell string, {kinds}", query_rows=4 * join.POINTS).select(*names, "cell")

    def _ends(self) -> tuple[list[Column], list[Column]]:
        return [F.col(f"lo_{c}") for c in self.columns], [F.col(f"hi_{c}") for c in self.columns]

    def stripe_leaves(self, w: Sequence[float], lo: float, hi: float) -> DataFrame:
        """The leaves that the slab meets; `whole`: those that it holds all of."""
        low, high = self._ends()
        overlap = ranges.box_overlap(low, high, w, lo - 1e-9, hi + 1e-9)
        inner = ranges.box_overlap(low, high, w, lo + 1e-9, hi - 1e-9) == 2
        return self.leaves.filter(overlap > 0).withColumn("whole", inner)

    def box_leaves(self, lo: Sequence[float], hi: Sequence[float]) -> DataFrame:
        low, high = self._ends()
        meets = ranges.boxes_meet(low, high, [F.lit(float(x)) for x in lo], [F.lit(float(x)) for x in hi])
        inner = F.expr(" AND ".join(f"`lo_{c}` >= {float(a)!r}D AND `hi_{c}` <= {float(b)!r}D" for c, a, b in zip(self.columns, lo, hi)))
        return self.leaves.filter(meets).withColumn("whole", inner)

    def read(self, leaves: DataFrame) -> DataFrame:
        """The members in the parts of these leaves; beyond NAMED parts all are read."""
        return _in_parts(self.members, leaves)

    def _in(self, leaves: DataFrame, residual: Column) -> DataFrame:
        near = self.read(leaves).join(leaves.select("cell", F.col("first").alias("part"), "whole"), ["cell", "part"]).filter(F.col("whole") | residual)
        return near.select(*self.members.columns)

    def stripe(self, w: Sequence[float], lo: float, hi: float) -> DataFrame:
        """The points in the slab; those of whole leaves without a test."""
        return self._in(self.stripe_leaves(w, lo, hi), ranges.stripe([F.col(c) for c in self.columns], w, lo, hi))

    def box(self, lo: Sequence[float], hi: Sequence[float]) -> DataFrame:
        """The points in the box, likewise."""
        return self._in(self.box_leaves(lo, hi), ranges.box([F.col(c) for c in self.columns], lo, hi))

    def check(self) -> bool:
        """Every point is inside its leaf's box, and the leaves count all points."""
        joined = self.members.join(self.leaves.withColumn("part", F.col("first")), ["cell", "part"])
        out = joined.filter(" OR ".join(f"`{c}` < `lo_{c}` OR `{c}` > `hi_{c}`" for c in self.columns))
        return out.isEmpty() and (self.leaves.agg(F.sum("n")).first()[0] or 0) == joined.count()
