"""Sharding by vector bin packing.

The items are groups of rows of equal text. Each is a vector (bytes, tokens, rows) and goes, largest first, to the shard where
its dot product with what the shard still has room for is highest. Groups over a small share of a shard are items of their
own; the many smaller ones are summed, as whole groups, into a bounded number of hash cells. A group stays whole if any
shard can hold it with the shards' bytes near equal; only one that none can hold is dealt out in pieces. Only the items'
sums reach the driver. Rows get their shard from a table of bounded size, and their slot from their rank inside a unit (an
item, or a hash range of an item of many rows) and the unit's place in its shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordinate.llm import common as C

SHARDS, CELLS_PER_SHARD = 24, 256
#: Pieces that a shard's worth of a split group is dealt in, and the share of a shard by which a whole group may overshoot.
PIECES, SLACK = 32, 0.02
#: Hash ranges of a group's rows, by which pieces and units are cut.
RANGES = 4096


def pack(items: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each item (rows: bytes, tokens, rows), and by how much of a shard's bytes it overshoots there. Largest
    first by bytes. Of the shards with room in every dimension, else with room in bytes, the one with the highest dot
    product of its room and the item; where no shard has room, the one with the most bytes left."""
    total = np.maximum(items.sum(axis=0), 1.0)
    need = items / total * shards  # in shards' capacities
    room = np.ones((shards, items.shape[1]))
    out, over = np.zeros(len(items), np.int64), np.zeros(len(items))
    for i in np.lexsort((np.arange(len(items)), -items[:, 0])):
        fits = room >= need[i] - 1e-12
        fits = all_fit if (all_fit := fits.all(axis=1)).any() else fits[:, 0]
        best = int(np.argmax(np.where(fits, room @ need[i], -np.inf))) if fits.any() else int(np.argmax(room[:, 0]))
        out[i], over[i] = best, max(0.0, need[i, 0] - room[best, 0])
        room[best] -= need[i]
    return out, over


def _cut(ranges: list[tuple], parts: int) -> list[list[tuple]]:
    """Runs of a group's hash ranges (range, rows, ...) of about equal rows."""
    rows = np.cumsum([r[1] for r in ranges])
    at = np.minimum((rows - [r[1] for r in ranges]) * parts // rows[-1], parts - 1)
    return [[r for r, a in zip(ranges, at) if a == k] for k in np.unique(at)]


def assign_shards(docs: DataFrame, shards: int = SHARDS, cells_per_shard: int = CELLS_PER_SHARD) -> DataFrame:
    """docs with size, text_crc32, shard (0 .. shards-1) and slot (gapless from 0 within a shard).

    Law `bytes`: the sizes (UTF-8 bytes of the text, 0 for null, plus 8) of the shards are near equal. Rows of equal text
    share a shard, however many they are, unless their group has more bytes than any shard has room for (by more than SLACK
    of a shard) when its turn comes; then it is dealt in pieces by a hash of doc_id. Null text is a group of its own. Tokens
    are counted as white-space gaps plus one. Repeated rows each get a slot. Input columns with the names of the outputs
    are replaced; an empty table gives an empty result. The texts are read twice: for the groups' sums, and for the result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    gaps = F.length(text) - F.length(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))
    sizes = {"size": (F.octet_length(text) + 8).cast("long"), "text_crc32": F.crc32(text.cast("binary")), "__group": F.xxhash64("text", F.col("text").isNull())}
    by_id = F.expr(f"cast(pmod(xxhash64(doc_id, 3), {RANGES}) AS int)")
    base = docs.withColumns(sizes | {"__range": by_id})
    sums = [F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum("t").alias("t")]
    one = docs.select(F.lit(1).alias("n"), sizes["size"].alias("b"), (gaps + 1).cast("long").alias("t"), sizes["__group"].alias("__group"), by_id.alias("__range"))
    parts = C.stored(one.groupBy("__group", "__range").agg(*sums))  # rows as numbers: all that follows but the result reads this
    cells = shards * cells_per_shard
    groups = C.stored(parts.groupBy("__group").agg(*sums))
    all_rows, all_bytes = (x or 1 for x in groups.agg(F.sum("n"), F.sum("b")).first())
    # at most 2 * cells groups can be this large; the rest are summed into cells
    large = F.broadcast(groups.filter(F.greatest(F.col("b") / all_bytes, F.col("n") / all_rows) > 1 / cells).select("__group"))
    held = parts.join(large, "__group", "left_semi")
    few = F.greatest(F.lit(1), F.least(F.lit(RANGES), F.ceil(F.col("n") * cells / all_rows))).cast("int")
    # a large group is cut into ranges of about a cell's rows, and about the bytes of a piece, should it have to be dealt out
    want = F.greatest(few, F.least(F.lit(RANGES), F.ceil(F.col("b") / all_bytes * shards * PIECES))).cast("int")
    ranges = F.broadcast(groups.join(large, "__group", "left_semi").select("__group", want.alias("__k")))
    of = F.expr(f"cast(__range * __k div {RANGES} AS int)")
    own: dict[int, list[tuple]] = {}
    for r in held.join(ranges, "__group").withColumn("__of", of).groupBy("__group", "__k", "__of").agg(*sums).collect():
        own.setdefault((r["__group"], r["__k"]), []).append((r["__of"], r["n"], r["b"], r["t"]))
    rest = parts.join(large, "__group", "left_anti").groupBy(F.expr(f"pmod(__group, {cells})").alias("cell")).agg(*sums).collect()
    units, shard_of = _placed({k: sorted(own[k]) for k in sorted(own)}, sorted(tuple(r) for r in rest), shards)
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame([k for k in sorted(own)], "__group long, __k int"))
    table = F.broadcast(spark.createDataFrame([(*u, s, o) for (u, s), o in zip(units, shard_of)], "__unit long, __of int, __shard int, __offset long"))
    unit = F.when(F.col("__k").isNotNull(), F.col("__group")).otherwise(F.expr(f"pmod(__group, {cells})"))
    dealt = base.join(known, "__group", "left").withColumns({"__unit": unit, "__of": F.coalesce(of, F.lit(-1))})
    rank = F.row_number().over(Window.partitionBy("__unit", "__of").orderBy("doc_id", "text_crc32", "size"))
    out = dealt.drop("shard", "slot").withColumn("__rank", rank).join(table, ["__unit", "__of"])
    return out.withColumns({"shard": F.col("__shard"), "slot": (F.col("__offset") + F.col("__rank") - 1).cast("long")}).drop("__group", "__range", "__k", "__unit", "__of", "__rank", "__shard", "__offset")


def _placed(own: dict[tuple, list[tuple]], rest: list[tuple], shards: int) -> tuple[list[tuple], list[int]]:
    """(((group or cell, range or -1), shard) of every unit, its first slot). Groups are packed whole; those that overshoot
    are split, the largest first, and all is packed again until none does."""
    split: set = set()
    while True:
        items, members, whole = [], [], []
        for key, ranges in own.items():
            whole_rows = sum(r[1] for r in ranges)
            for piece in _cut(ranges, len(ranges)) if key in split else [ranges]:
                items.append([sum(r[i] for r in piece) for i in (2, 3, 1)])
                members.append([((key[0], r[0]), r[1]) for r in piece])
                whole.append(key if key not in split and whole_rows > 1 and len(ranges) > 1 else None)
        for cell, n, b, t in rest:
            items.append([b, t, n])
            members.append([((cell, -1), n)])
            whole.append(None)
        to, over = pack(np.array(items, float).reshape(-1, 3), shards)
        late = [i for i, key in enumerate(whole) if key and over[i] > SLACK]
        if not late:
            break
        split.add(whole[max(late, key=lambda i: (items[i][0], -i))])
    used, units, offsets = [0] * shards, [], []
    for s, own_units in zip(to.tolist(), members):
        for u, n in own_units:
            units.append((u, s))
            offsets.append(used[s])
            used[s] += n
    return units, offsets


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """The shards as folders of Parquet files, rows in slot order."""
    out = assign_shards(docs, **options)
    out.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
