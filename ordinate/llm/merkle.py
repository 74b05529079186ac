"""Merkle manifest of a dataset: a digest for each row, tree nodes over eight each, a subtree for each language under one root, and
every row's authentication path.

Paths come from Merkle traversal scheduling. Rows are numbered within their language on the cluster and cut into aligned blocks
of 8^4. In a block each level keeps the run of nodes in which the present leaf's ancestor stands, and a treehash stack that makes
the next run: it takes in one leaf a step and is done in the step in which it is needed, so that a block's memory beside its
leaves is some eight nodes a level. The blocks' roots are the leaves of a table 8^4 times as small, which goes the same way until
each language has one node; what is above a block is made once and appended to the paths of all its leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordinate.llm import common as C

FAN, LEVELS = 8, 4
PATH = "array<struct<left: string, right: string>>"


def H(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Digest of a row: each field as its number of UTF-8 bytes, a colon and its value, or - if null."""
    fields = [c.cast("string") for c in (doc_id, source, lang, n_chars, text)]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c), F.lit(":"), c), F.lit("-")) for c in fields)), 256)


class Treehash:
    """The nodes of one level, from leaves that come one by one; of each level below, fewer than a run are held."""

    def __init__(self, level: int):
        self.stack: list[list[str]] = [[] for _ in range(level + 1)]

    def add(self, leaf: str) -> None:
        node = leaf
        for own in self.stack[:-1]:
            own.append(node)
            if len(own) < FAN:
                return
            node = H(own)
            own.clear()
        self.stack[-1].append(node)

    def finish(self) -> list[str]:
        """The level's nodes; where leaves ended, a run is closed with what it has."""
        for own, above in zip(self.stack, self.stack[1:]):
            if own:
                above.append(H(own))
                own.clear()
        return self.stack[-1]


def levels_of(block: int, n: int, levels: int = LEVELS) -> int:
    """Levels that a block of n leaves goes up: all of them, unless it is its group's only one, which ends with one node."""
    return levels if block else next(k for k in range(levels + 1) if FAN**k >= n)


def block_root(leaves: list[str], levels: int) -> str:
    tree = Treehash(levels)
    for x in leaves:
        tree.add(x)
    return tree.finish()[0]


def traversed(leaves: list[str], levels: int) -> Iterator[tuple[list[str], list[str]]]:
    """For each leaf in turn, what stands left and right of its ancestor in the run of each level, from the leaves up."""
    runs, ahead = [], [Treehash(h) for h in range(levels)]
    for h in range(levels):
        first = Treehash(h)
        for x in leaves[: FAN ** (h + 1)]:
            first.add(x)
        runs.append(first.finish())
    left, right = [""] * levels, ["".join(own[1:]) for own in runs]
    for i in range(len(leaves)):
        yield left, right
        left, right = left.copy(), right.copy()
        for h in range(levels):
            width = FAN**h
            if (at := i + FAN * width) < len(leaves):
                ahead[h].add(leaves[at])
            if (i + 1) % width:
                continue
            place = (i + 1) // width % FAN
            if not place:
                runs[h], ahead[h] = ahead[h].finish(), Treehash(h)
            left[h], right[h] = "".join(runs[h][:place]), "".join(runs[h][place + 1 :])


def numbered(df: DataFrame, group: str, by: list[str]) -> DataFrame:
    """df with `ord`, its rows' places from 0 within their group (a text that is never null) in the order of `by`. Ranges of rows
    are numbered each in its task; what a range starts with comes from the counts of those before it, one row a range. Rows that
    agree in all of `by` are told apart by a stored number, so that many of them fill several ranges."""
    names = df.columns
    df = C.stored(df.withColumn("tie", F.monotonically_increasing_id()))
    ranged = df.repartitionByRange(C.shards_for(df.sparkSession, 1), group, *by, "tie").sortWithinPartitions(group, *by, "tie").drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, so_far = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            code = np.asarray(b.column(group).dictionary_encode().indices)
            first = np.flatnonzero(np.r_[True, np.diff(code) != 0])
            own = np.arange(b.num_rows) - np.repeat(first, np.diff(np.r_[first, b.num_rows]))
            if b.column(group)[0].as_py() == last:
                own[: first[1] if len(first) > 1 else b.num_rows] += so_far
            last, so_far = b.column(group)[b.num_rows - 1].as_py(), int(own[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(own)], names=[*names, "part", "own"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    placed = C.stored(ranged.mapInArrow(run, f"{kinds}, part int, own long"))
    counts = placed.groupBy(group, "part").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.withColumn("before", earlier).filter("before > 0").drop("n")  # a range's first group alone, so one row a range
    joined = placed.join(F.broadcast(before), [group, "part"], "left")
    return joined.select(*names, (F.col("own") + F.coalesce("before", F.lit(0))).alias("ord"))


def _blocked(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"ord div {FAN**levels}"))


def _in_order(t: pa.Table) -> pa.Table:
    return t.take(pa.array(np.argsort(np.asarray(t["ord"]), kind="stable")))


def _roots(nodes: DataFrame, levels: int) -> DataFrame:
    """(group, ord, digest) of the blocks' roots, numbered as the blocks are."""

    def run(t: pa.Table) -> pa.Table:
        leaves, block = _in_order(t)["digest"].to_pylist(), t["block"][0].as_py()
        return pa.table({"group": t["group"][:1], "ord": pa.array([block], pa.int64()), "digest": [block_root(leaves, levels_of(block, len(leaves), levels))]})

    return _blocked(nodes.select("group", "ord", "digest"), levels).groupBy("group", "block").applyInArrow(run, "group string, ord long, digest string")


def climbed(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes and the tables of block roots above them, up to the one with a node for each group."""
    tables = [nodes]
    while tables[-1].agg(F.max("ord")).first()[0]:
        tables.append(C.stored(_roots(tables[-1], levels)))
    return tables


def _authenticated(nodes: DataFrame, above: DataFrame, keep: list[str], levels: int) -> DataFrame:
    """nodes with `path` and `top`: the path within the block, then the block's own, which above (group, block, path, top) has."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.select("group", "ord", "digest", *keep).schema)

    def run(own: pa.Table, upper: pa.Table) -> pa.Table:
        t = _in_order(own)
        leaves, block = t["digest"].to_pylist(), t["block"][0].as_py()
        path = upper["path"][0].as_py()
        up_left, up_right = [s["left"] for s in path], [s["right"] for s in path]
        lefts, rights, ends = [], [], [0]
        for left, right in traversed(leaves, levels_of(block, len(leaves), levels)):
            lefts += left + up_left
            rights += right + up_right
            ends.append(len(lefts))
        steps = pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], ["left", "right"])
        out = t.drop_columns(["block"]).append_column("path", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps))
        return out.append_column("top", pa.array([upper["top"][0].as_py()] * len(leaves), pa.string()))

    left = _blocked(nodes.select("group", "ord", "digest", *keep), levels).groupBy("group", "block")
    return left.cogroup(above.groupBy("group", "block")).applyInArrow(run, f"{kinds}, path {PATH}, top string")


def _descended(tables: list[DataFrame], above: DataFrame, keep: list[str], levels: int) -> DataFrame:
    """The lowest table's nodes with their whole paths; above (group, block 0, path, top) has what is over each group."""
    for table in tables[-2:0:-1]:
        above = _authenticated(table, above, [], levels).select("group", F.col("ord").alias("block"), "path", "top")
    return _authenticated(tables[0], above, keep, levels)


def manifest(docs: DataFrame, keep: tuple[str, ...] = (), levels: int = LEVELS) -> DataFrame:
    """(doc_id, lang, leaf, subroot, root, path) and the columns `keep` of docs (doc_id, text, lang, source, n_chars).

    Within a language (null is one of its own, and first) leaves stand by doc_id, nulls first, and by digest where ids are
    equal; runs of eight become one node until one is left. The languages' subroots, bytewise by language, become the root in
    the same way; a lone leaf is its subroot, a lone subroot the root. path: from the leaf up, what its run has left and right of
    it, digests one after the other (both empty where a node is alone in its run). Repeated rows are a leaf each; columns of docs
    that are named like outputs count only if kept; an empty table gives an empty result. Texts are read once, for the digests. Blocks
    have 8^levels leaves.
    """
    own = leaf_of(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")))
    group = F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0"))
    rows = docs.select(group.alias("group"), F.col("doc_id").cast("long").alias("doc_id"), "lang", own.alias("digest"), *(F.col(k).alias(f"keep_{k}") for k in keep))
    kept = ["doc_id", "lang", *(f"keep_{k}" for k in keep)]
    leaves = climbed(C.stored(numbered(rows, "group", ["doc_id", "digest"])), levels)
    subroots = numbered(leaves[-1].select(F.lit("").alias("group"), F.col("group").alias("of"), "digest"), "group", ["of"])
    langs = climbed(C.stored(subroots), levels)
    found = langs[-1].first()
    start = langs[-1].select("group", F.col("ord").alias("block"), F.array().cast(PATH).alias("path"), F.lit("").alias("top"))
    above = _descended(langs, start, ["of"], levels).select(F.col("of").alias("group"), F.lit(0).cast("long").alias("block"), "path", F.col("digest").alias("top"))
    out = _descended(leaves, above, kept, levels)
    root = F.lit(found["digest"] if found else None).cast("string")
    return out.select("doc_id", "lang", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), root.alias("root"), "path", *(F.col(f"keep_{k}").alias(k) for k in keep))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof(path: Column) -> Column:
    """Digest of all siblings of a path."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    text = F.when(hit, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    tampered = docs.withColumn("tampered", leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text))
    out = manifest(tampered, keep=("tampered",)).withColumn("folded_root", folded(F.col("tampered"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(depth: int = 9) -> str:
    """Level by level; a node alone in its language, and then alone of all, stays as it is. 8^depth rows a language at most."""
    crc = "list_reduce(list_prepend(4294967295, list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))"
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    low = f"CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    ctes = [
        f"d AS (SELECT doc_id, coalesce('1' || lang, '0') AS g, {leaf('text')} AS leaf, {leaf('low')} AS tampered FROM (SELECT *, {low} AS low FROM documents))",
        "o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d)",
        "a0 AS (SELECT g, pos, leaf AS node FROM o)",
    ]
    for k, name in [(k, "a") for k in range(depth)] + [(k, "b") for k in range(3)]:
        if name == "b" and not k:
            ctes.append(f"b0 AS (SELECT '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, node, g AS of FROM a{depth})")
        at = f"{name}{k}"
        left, right = (f"coalesce(string_agg(node, '' ORDER BY pos) OVER (PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN {x}), '')" for x in ("UNBOUNDED PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND UNBOUNDED FOLLOWING"))
        left, right = (x.replace(", '' ORDER BY pos)", ", '')") for x in (left, right))
        ctes.append(f"s{at} AS (SELECT g, pos, node, {left} AS l, {right} AS r, count(*) OVER (PARTITION BY g) > 1 AS more FROM {at})")
        ctes.append(f"{name}{k + 1} AS (SELECT g, pos // 8 AS pos, CASE WHEN any_value(more) THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE any_value(node) END AS node FROM s{at} GROUP BY g, pos // 8)")
    ctes.append("p0 AS (SELECT doc_id, g, pos, leaf, tampered AS node, '' AS proof FROM o)")
    step = "CASE WHEN more THEN sha256(l || p.node || r) ELSE p.node END AS node, CASE WHEN more THEN proof || l || r ELSE proof END AS proof"
    for k in range(depth):
        ctes.append(f"p{k + 1} AS (SELECT doc_id, p.g, p.pos // 8 AS pos, leaf, {step} FROM p{k} p JOIN sa{k} s ON p.g = s.g AND p.pos = s.pos)")
    ctes.append(f"q0 AS (SELECT doc_id, leaf, a.node AS subroot, p.node, proof, b0.pos FROM p{depth} p JOIN a{depth} a ON p.g = a.g JOIN b0 ON b0.of = p.g)")
    for k in range(3):
        ctes.append(f"q{k + 1} AS (SELECT doc_id, leaf, subroot, p.pos // 8 AS pos, {step} FROM q{k} p JOIN sb{k} s ON p.pos = s.pos)")
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, b3.node AS root, sha256(proof) AS proof_sha256, q3.node AS folded_root, q3.node = b3.node AS verified FROM q3, b3"


SQL = _sql()
