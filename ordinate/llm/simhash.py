"""SimHash near-dedup by a segment-popcount embedding.

A fingerprint is cut into 32 segments of two bits; the vector of the segments' popcounts embeds it so that the Manhattan
distance of two vectors is a lower bound of the fingerprints' Hamming distance. The join is a range join on a grid of that
space: with the coordinates in m groups, some choice of s groups holds so little of a distance of 4 or less that the two
vectors are within Manhattan distance 2 there. In the unit grid over those groups each vector enters its own cell and all
cells at distance 1, so two vectors within 2 meet in one. Who meets is compared by the bound over all coordinates, then
exactly. Within a cell, links are kept as a spanning forest; cells over a size are dealt in pairs of blocks. Components come
from label passing with pointer jumping over distinct fingerprints, on the cluster, until one task can hold the links left.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinate.llm import common as C

SHINGLE, SEED, DISTANCE = 4, 42, 4
SEGMENTS = 32
#: Most fingerprints of one cell that one task compares with each other; most rows of a table that is broadcast, which the driver
#: builds and serves to every executor; most links that one task joins.
CELL, FEW, LINKS = 2048, 20_000, 1_000_000
_ODD = np.uint64(0x5555555555555555)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.r_[0, ends + 1][: len(words) - shingle + 1].tolist()
    stops = np.r_[ends, len(joined)][shingle - 1 :].tolist()
    h64 = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(starts)
    for lo in range(0, n, 1 << 16):
        h = np.array([h64(joined[a:b], seed) for a, b in zip(starts[lo : lo + (1 << 16)], stops[lo : lo + (1 << 16)])], np.uint64)
        counts += _bit_counts(h)
    return sum(1 << i for i in range(64) if 2 * int(counts[i]) > n)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the words have each bit, least significant first."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def embed(fp: np.ndarray) -> np.ndarray:
    """(n, 32) popcounts of the two-bit segments."""
    pairs = (fp & _ODD) + ((fp >> np.uint64(1)) & _ODD)  # each two bits hold their own popcount
    return ((pairs[:, None] >> np.arange(0, 64, 2, dtype=np.uint64)) & np.uint64(3)).astype(np.int8)


def spread_of(distance: int, m: int, s: int) -> int:
    """The most that the s closest of m groups can differ by, all together, in vectors that differ by `distance`."""
    each, more = divmod(distance, m)
    return s * each + max(0, s - (m - more))


def meetings(m: int, s: int, coordinates: int = SEGMENTS) -> tuple[float, float]:
    """(cells that a vector enters, random vectors that it meets there, of one): two-bit popcounts differ by 0, 1, 2 with
    chances 3/8, 1/2, 1/8."""
    k, choices = coordinates * s / m, comb(m, s)
    near = 0.375**k + k / 2 * 0.375 ** (k - 1) + (k * (k - 1) / 8 + k / 8) * 0.375 ** (k - 2)
    return choices * (1 + 1.5 * k), choices * near


def grid_for(n: int, distance: int = DISTANCE) -> tuple[int, int]:
    """(m, s) with the fewest cells among those in which n random fingerprints seldom meet; their meetings would grow with the
    square of n. Where none is so, the one with the fewest meetings."""
    fits = [(m, s) for m in range(2, 3 * distance + 4) for s in range(1, m) if 1 <= spread_of(distance, m, s) <= 2 and meetings(m, s)[0] <= 400]
    if not fits:
        raise ValueError(f"distance {distance} is too wide for this grid")
    seldom = [g for g in fits if n * meetings(*g)[1] <= 1]
    return min(seldom, key=lambda g: meetings(*g)) if seldom else min(fits, key=lambda g: meetings(*g)[1])


def _cells(m: int, s: int):
    """A row for each cell that a fingerprint enters: the cell's key and the fingerprint."""
    bounds = np.linspace(0, SEGMENTS, m + 1).astype(int)
    choices = [[j for g in groups for j in range(bounds[g], bounds[g + 1])] for groups in combinations(range(m), s)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.asarray(batch.column(0)).view(np.uint64)
        v = (fp & _ODD) + ((fp >> np.uint64(1)) & _ODD)  # two bits a coordinate
        keys, owners = [], []
        for number, coordinates in enumerate(choices):
            mask = np.uint64(sum(3 << (2 * j) for j in coordinates))
            own, salt = v & mask, np.uint64(((number + 1) * 0x9E3779B97F4A7C15) % 2**64)
            keys.append(own ^ salt)
            owners.append(fp)
            for j in coordinates:
                at, one = (v >> np.uint64(2 * j)) & np.uint64(3), np.uint64(1 << (2 * j))
                up, down = at < 2, at > 0
                keys += [(own[up] + one) ^ salt, (own[down] - one) ^ salt]
                owners += [fp[up], fp[down]]
        return pa.RecordBatch.from_arrays([pa.array(_mix(np.concatenate(keys)).view(np.int64)), pa.array(np.concatenate(owners).view(np.int64))], names=["cell", "fp"])

    return run


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def forest(fp: np.ndarray, side: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """Links that connect what is linked among distinct fingerprints (between the two sides, if given), one a union.
    The popcount bound goes first, the exact distance over what it leaves; a row at a time, so memory stays linear."""
    n = len(fp)
    v = embed(fp)
    weight = v.sum(axis=1, dtype=np.int32)
    order = np.argsort(weight, kind="stable")
    fp, v, weight = fp[order], v[order], weight[order]
    side = None if side is None else side[order]
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    upto = np.searchsorted(weight, weight + distance, "right")
    for i in range(n - 1):
        hi = upto[i]
        near = np.arange(i + 1, hi)
        if side is not None:
            near = near[side[near] != side[i]]
        if not len(near):
            continue
        near = near[np.abs(v[near] - v[i]).sum(axis=1, dtype=np.int32) <= distance]
        near = near[np.bitwise_count(fp[near] ^ fp[i]) <= distance]
        for j in near.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[b] = a
                out.append((int(fp[i]), int(fp[j])))
    return out


def _links(distance: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = [], []
        for packed, sides in zip(batch.column("fps").to_pylist(), batch.column("sides").to_pylist()):
            for x, y in forest(np.array(packed, np.int64).view(np.uint64), None if sides is None else np.array(sides), distance):
                a.append(x)
                b.append(y)
        cols = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)]
        return pa.RecordBatch.from_arrays(cols, names=["a", "b"])

    return run


def links(prints: DataFrame, distance: int = DISTANCE, cell: int = CELL) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect all that are within `distance`."""
    n = prints.count()
    spread = prints.select("fp").repartition(C.shards_for(prints.sparkSession), "fp")  # few bytes each, but many cells
    dealt = C.arrow_map(spread, _cells(*grid_for(n, distance)), "cell long, fp long")
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    # a cell over the limit is cut into blocks by a hash; each pair of blocks is a task's work of its own
    blocks = F.ceil(F.col("n") / (cell // 2)).cast("int")
    known = dealt.join(C.unbounded(sizes), "cell").withColumn("k", F.when(F.col("n") <= cell, 1).otherwise(blocks))
    known = known.withColumn("own", F.expr("cast(pmod(xxhash64(fp), k) AS int)"))
    pairs = known.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    pairs = pairs.select("cell", "k", "fp", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    packed = pairs.groupBy("cell", "x", "y").agg(F.collect_list("fp").alias("fps"), F.when(F.first("x") == F.first("y"), F.lit(None)).otherwise(F.collect_list("own")).alias("sides"))
    return C.arrow_map(packed.filter("size(fps) > 1"), _links(distance), "a long, b long")


def _joined(batches):
    """(id, root) of every node of the links that one task reads: the larger root is hooked to the smaller until none differ."""
    read = [np.stack([np.asarray(b.column(i), np.int64) for i in range(2)]) for b in batches if b.num_rows]
    if not read:
        return
    ids, at = np.unique(np.concatenate(read, axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(ids))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    for lo in range(0, len(ids), 1 << 16):
        cut = slice(lo, lo + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(ids[cut]), pa.array(ids[root[cut]])], names=["id", "root"])


def components(nodes: DataFrame, edges: DataFrame, links: int = LINKS) -> DataFrame:
    """(id, root): the smallest id (as unsigned order does not matter: any one, the same for all) that each node of `edges`
    reaches. Each round takes the smallest label among a node and its neighbours, hooks the old label to it, and jumps
    pointers; rounds go with the logarithm of a component's width. Every round is a checkpoint in the shared folder. Once
    `links` edges or fewer are left, one task joins them: no round's tables then pass through the driver."""

    def at_once(left: DataFrame) -> DataFrame:
        return C.stored(left.select("a", "b").coalesce(1).mapInArrow(_joined, "id long, root long"))

    if edges.count() <= links:
        return at_once(edges)
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    state = C.stored_anew(both)
    # edges carry labels: contract each round. root maps original nodes to present labels.
    root = C.stored_anew(state.select(F.col("a").alias("id")).distinct().withColumn("root", F.col("id")))
    while True:
        left = state.count()
        if not left:
            return root
        if left <= links:
            to = at_once(state).select(F.col("id").alias("root"), F.col("root").alias("m"))
            return C.stored_anew(looked_up(root, to, "root", to.count()).select("id", F.coalesce("m", "root").alias("root")))
        near = C.stored_anew(state.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        n = near.count()
        # chains of smaller labels: two jumps shorten them
        for _ in range(2):
            jump = near.select(F.col("a").alias("m"), F.col("m").alias("m2"))
            near = C.stored_anew(looked_up(near, jump, "m", n).select("a", F.coalesce("m2", "m").alias("m")))
        to = near.select(F.col("a").alias("root"), "m")
        root = C.stored_anew(looked_up(root, to, "root", n).select("id", F.coalesce("m", "root").alias("root")))
        state = looked_up(state, near, "a", n).select(F.col("m").alias("a"), "b")
        state = C.stored_anew(looked_up(state, near.select(F.col("a").alias("b"), "m"), "b", n).select("a", F.col("m").alias("b")).filter("a <> b").distinct())


def looked_up(left: DataFrame, right: DataFrame, key: str, n: int, salts: int = 64) -> DataFrame:
    """left with the columns of right, which has one row a key and n in all; null where there is none. A key may have any share
    of left: a small right is broadcast; else the rows of frequent keys are dealt over salts, and only their rows of right are
    repeated for each salt."""
    if n <= FEW:
        return left.join(F.broadcast(right), key, "left")
    rows = left.count()
    often = left.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > max(1000, rows // 2000)).select(key, F.lit(True).alias("__often"))
    often = F.broadcast(often)  # at most 2,000 rows
    salt = F.expr(f"cast(pmod(xxhash64({', '.join(left.columns)}), {salts}) AS int)")
    a = left.join(often, key, "left").withColumn("__salt", F.when(F.col("__often"), salt).otherwise(0)).drop("__often")
    b = right.join(often, key, "left").withColumn("__salt", F.explode(F.when(F.col("__often"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("__often")
    return a.join(C.unbounded(b), [key, "__salt"], "left").drop("__salt")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with fp (long: the fingerprint's bits)."""
    carried = docs.drop("fp")
    out = [c for c in carried.columns if c != "text"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t) for t in C.binary_texts(batch.column("text"))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), pa.array(fp)], names=[*out, "fp"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema if f.name in out), "fp long"])
    return C.arrow_map(carried, run, schema)


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of docs (doc_id, text).

    Fingerprints link at `distance` or fewer differing bits; component_id is the smallest doc_id that links reach, the own
    included. Null and empty texts, and those without words, have fingerprint zero and link as any other does. A null
    doc_id is below all others as a member; if it is the smallest, component_id is null. Repeated rows, and any number of
    equal fingerprints, cost one node. An empty table gives an empty result.
    """
    marked = C.stored(fingerprints(docs.select("doc_id", "text")))
    nodes = marked.groupBy("fp").agg(F.min(C.id_key(F.col("doc_id"))).alias("first"))
    root = components(nodes, C.stored(links(nodes.select("fp"), distance)))
    linked = root.count()
    named = C.stored(looked_up(nodes, root.withColumnRenamed("id", "fp"), "fp", linked).select("fp", "first", F.coalesce("root", "fp").alias("root")))
    # fingerprints without a link are their own component; the others' is the least of their root
    first = C.stored(named.join(C.unbounded(root.select("root").distinct()), "root", "left_semi").groupBy("root").agg(F.min("first").alias("component")))
    to = C.stored(looked_up(named, first, "root", first.count()).select("fp", F.coalesce("component", "first").alias("component")))
    # rows of one fingerprint, however many, meet one row here
    out = looked_up(marked, to, "fp", to.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("component") != C.NULL_ID, F.col("component")).alias("component_id"))


def keep_first(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their component; of repeated ids, every row stays."""
    found = near_duplicates(docs, distance).filter("doc_id <=> component_id").select(C.id_key(F.col("doc_id")).alias("__id")).distinct()
    return docs.withColumn("__id", C.id_key(F.col("doc_id"))).join(C.unbounded(found), "__id", "left_semi").drop("__id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"))
