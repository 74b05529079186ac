"""Line dedup by a sharded minimal perfect hash.

The distinct hashes of line keys are dealt over shards. Each shard holds a minimal perfect hash whose slots index three
compact arrays: a fingerprint, the number of documents, the smallest document id. Documents do not join lines: each Arrow
batch of documents asks a shard once for each distinct hash it holds, the shard probes its arrays, and the answers come
back to the batch. A line that a third of all documents hold is so one request a batch, whatever its frequency.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinate.llm import common as C

MIN_CODE_POINTS = 10


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class PerfectHash:
    """Minimal perfect hash over distinct pairs of 64-bit words: on each level the keys that no other key meets take a bit;
    a key's index is the rank of its bit. Keys that collide to the end (none, in practice) go to a sorted rest."""

    GAMMA, LEVELS = 1.5, 48

    def __init__(self, keys: np.ndarray):
        """keys: (n, 2) uint64, distinct rows."""
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        base = 0
        for seed in range(self.LEVELS):
            if not len(keys):
                break
            m = max(8, int(self.GAMMA * len(keys)))
            at = (self._word(keys, seed) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            self.levels.append((alone, np.cumsum(alone) - 1 + base, m))
            base += int(alone.sum())
            keys = keys[~alone[at]]
        self.rest = {tuple(k): base + i for i, k in enumerate(keys.tolist())}

    @staticmethod
    def _word(keys: np.ndarray, seed: int) -> np.ndarray:
        return _mix(keys[:, 0], 2 * seed + 1) ^ _mix(keys[:, 1], 2 * seed + 2)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; any slot or -1 for keys not in the set (the fingerprint tells)."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for seed, (alone, rank, m) in enumerate(self.levels):
            if not len(left):
                break
            at = (self._word(keys[left], seed) % np.uint64(m)).astype(np.int64)
            hit = alone[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        for i in left if self.rest else ():
            out[i] = self.rest.get(tuple(keys[i].tolist()), -1)
        return out


class Shard:
    """The arrays of one shard: what its requests say of each distinct line hash, merged."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, first: np.ndarray):
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        k, c, f = keys[order], counts[order], first[order]
        start = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)]) if len(k) else np.zeros(0, np.int64)
        distinct = k[start]
        self.mph = PerfectHash(distinct)
        slot = self.mph.index(distinct)
        self.fingerprint = np.zeros(len(distinct), np.uint64)
        self.count = np.zeros(len(distinct), np.int64)
        self.first = np.zeros(len(distinct), np.int64)
        if len(start):
            self.fingerprint[slot] = distinct[:, 1]
            self.count[slot] = np.add.reduceat(c, start)
            self.first[slot] = np.minimum.reduceat(f, start)

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, smallest id) of each key; 0 documents where the fingerprint differs."""
        if not len(self.count):
            return np.zeros(len(keys), np.int64), np.full(len(keys), C.NULL_ID)
        slot = self.mph.index(keys)
        known = (slot >= 0) & (self.fingerprint[slot] == keys[:, 1])
        return np.where(known, self.count[slot], 0), self.first[slot]


def line_keys(text: bytes, least: int = MIN_CODE_POINTS) -> list[bytes | None]:
    """The key of each line, None where it is shorter than `least` code points."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip().lower()
        n = len(key)
        if n < least or n < 4 * least and len(key.decode("utf-8", "replace")) < least:
            out.append(None)
        else:
            out.append(key)
    return out


def _requests(shards: int, least: int):
    schema = pa.schema([("shard", pa.int32()), ("batch", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("first", pa.binary())])

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for batch in C.pieces(batches):
            ids, hashes = (np.asarray(batch.column(i)) for i in (0, 1))
            lines, digests = [], []
            for text in C.binary_texts(batch.column(2)):
                keys = line_keys(text, least)
                lines.append(len(keys))
                digests += [b"" if k is None else xxhash.xxh3_128_digest(k) for k in keys]
            owner = np.repeat(np.arange(len(ids)), lines)
            long = np.fromiter(map(len, digests), np.int64, len(digests)) > 0
            words = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
            number = (part << 32) | seq
            seq += 1
            shard = (words[:, 0] % np.uint64(shards)).astype(np.int64)
            order = np.lexsort((words[:, 1], words[:, 0], shard))
            sw, ss, who = words[order], shard[order], owner[long][order]
            new = np.r_[True, (sw[1:] != sw[:-1]).any(axis=1)] if len(sw) else np.zeros(0, bool)
            start = np.flatnonzero(new)
            slot = np.full(len(digests), -1, np.int32)
            where = np.flatnonzero(long)
            slot[where[order]] = np.cumsum(new) - 1
            rows = [(-1, number, C.packed(slot), C.packed(np.asarray(lines, np.int32)), C.packed(np.stack([ids, hashes])))]
            if len(start):
                at = ids[who]
                first = np.minimum.reduceat(at, start)
                # documents of a hash in this batch: distinct ids among its lines
                pair = np.lexsort((at, np.cumsum(new)))
                g, a = np.cumsum(new)[pair], at[pair]
                fresh = np.r_[True, (g[1:] != g[:-1]) | (a[1:] != a[:-1])]
                counts = np.bincount(g[fresh] - 1, minlength=len(start)).astype(np.int64)
                us = ss[start]
                cuts = np.flatnonzero(np.r_[True, us[1:] != us[:-1]])
                for lo, hi in zip(cuts, np.r_[cuts[1:], len(us)]):
                    rows.append((int(us[lo]), number, C.packed(sw[start[lo:hi]]), C.packed(counts[lo:hi]), C.packed(first[lo:hi])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def _answer(shard_rows: pa.Table) -> pa.Table:
    """Build a shard's arrays and probe them with each batch's request."""
    keys = [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in shard_rows["keys"].to_pylist()]
    counts = [np.frombuffer(x, np.int64) for x in shard_rows["counts"].to_pylist()]
    first = [np.frombuffer(x, np.int64) for x in shard_rows["first"].to_pylist()]
    shard = Shard(np.concatenate(keys), np.concatenate(counts), np.concatenate(first))
    answers = []
    for k in keys:
        n, smallest = shard.probe(k)
        # one document alone keeps its lines: NULL_ID + 1 is never an id that asks
        answers.append(C.packed(np.stack([n, smallest])))
    return pa.table({"shard": shard_rows["shard"], "batch": shard_rows["batch"], "answer": pa.array(answers, pa.binary()), "lines": pa.nulls(len(answers), pa.binary()), "ids": pa.nulls(len(answers), pa.binary())})


def _masks(rows: pa.Table) -> pa.Table:
    """Of one batch: its own row (shard -1) says which distinct hash each line has; the answers follow in shard order."""
    rows = rows.sort_by("shard").to_pylist()
    slot, lines = np.frombuffer(rows[0]["answer"], np.int32), np.frombuffer(rows[0]["lines"], np.int32)
    ids, hashes = np.frombuffer(rows[0]["ids"], np.int64).reshape(2, -1)
    answers = [np.frombuffer(r["answer"], np.int64).reshape(2, -1) for r in rows[1:]]
    n, smallest = np.concatenate(answers, axis=1) if answers else np.zeros((2, 0), np.int64)
    owner = np.repeat(ids, lines)
    drop = np.zeros(len(slot), bool)
    known = slot >= 0
    drop[known] = (n[slot[known]] >= 2) & (smallest[slot[known]] != owner[known])
    ends = np.cumsum(lines)
    k0, k1, masks = [], [], []
    for i, (hi, m) in enumerate(zip(ends, lines)):
        part = drop[hi - m : hi]
        if part.any():
            k0.append(ids[i])
            k1.append(hashes[i])
            masks.append(part.tobytes())
    return pa.table({"k0": pa.array(k0, pa.int64()), "k1": pa.array(k1, pa.int64()), "mask": pa.array(masks, pa.binary())})


def dedup_lines(docs: DataFrame, min_code_points: int = MIN_CODE_POINTS, shards: int | None = None) -> DataFrame:
    """docs (doc_id, text, any other columns) with text as kept, n_lines (before) and n_dropped.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of min_code_points or more that two
    or more distinct doc_ids hold stay only in the smallest of them (there every one of their lines stays); a null doc_id
    counts as one document below all others. Null or empty text is one empty line, kept, so its text becomes "". Rows that
    repeat a doc_id are one document. A document whose lines all go has text "". Input columns named n_lines or n_dropped
    are replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    shards = shards or C.shards_for(spark)
    keys = {"__k0": C.id_key(F.col("doc_id")), "__k1": F.xxhash64("text")}
    asked = C.stored(docs.select(keys["__k0"].alias("__k0"), keys["__k1"].alias("__k1"), "text").mapInArrow(_requests(shards, min_code_points), "shard int, batch long, keys binary, counts binary, first binary"))
    answered = asked.filter("shard >= 0").groupBy("shard").applyInArrow(_answer, "shard int, batch long, answer binary, lines binary, ids binary")
    own = asked.filter("shard < 0").selectExpr("shard", "batch", "keys AS answer", "counts AS lines", "first AS ids")
    masks = answered.unionByName(own).groupBy("batch").applyInArrow(_masks, "k0 long, k1 long, mask binary").toDF("__m0", "__m1", "__mask").dropDuplicates(["__m0", "__m1"])
    joined = docs.withColumns(keys).join(masks, (F.col("__k0") == F.col("__m0")) & (F.col("__k1") == F.col("__m1")), "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: F.substring(F.col("__mask"), i + 1, F.lit(1)) == F.lit(b"\x00")), "\n")
    return joined.withColumns({
        "n_lines": F.length(text).cast("long") - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1,
        "n_dropped": F.coalesce(F.length(F.replace(F.hex("__mask"), F.lit("00"), F.lit(""))) / 2, F.lit(0)).cast("long"),
        "text": F.when(F.col("__mask").isNull(), text).otherwise(kept),
    }).drop("__k0", "__k1", "__m0", "__m1", "__mask")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, u.i AS i, u.line AS line,
         translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'i': i, 'line': x})) AS u FROM documents)),
k AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT l.*, k.first IS NOT NULL AND k.first <> l.doc_id AS gone FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
