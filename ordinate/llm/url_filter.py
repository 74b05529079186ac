"""URL filters: a blocked Bloom filter of the listed canonical URLs passes possible hits to an exact hash join.

A canonical URL is the host (A-Z lower-cased) and the path, without scheme, query and fragment. Listed are rules, each of which
fits its host with all subdomains and every path that starts with its own, and single URLs, which fit only themselves. A URL's
keys are its hosts' endings by labels times its path's beginnings, no deeper than the list itself goes, and its canonical form.
Each key looks into one block of 512 bits, where one bit of each of its eight words must be set. What passes is joined with the
list by the whole key, which removes false positives; URLs with no possible key take no part in that join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinate.llm import common as C

#: Bits a key that the filter is laid out for, and its most blocks of 64 bytes (16 MB): a longer list has more false
#: positives, which the join removes, and no missed keys.
BITS_A_KEY, MOST_BLOCKS = 16, 1 << 18
#: A list of at most so many rows and bytes is broadcast to the exact join; a longer one is shuffled, but for its hottest keys.
FEW, FEW_BYTES, HOT_SHARE = 50_000, 8 << 20, 1000
#: One odd multiplier for each of a block's eight words.
ODD = [pow(2654435761, j + 1, 2**32) for j in range(8)]
#: The rules of the query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty if null or without ://."""
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _list(rules: DataFrame, listed: DataFrame | None) -> DataFrame:
    """(key, rule, verdict, host, path): a rule's key begins with r, a single URL's with u. Of equal rules block wins."""
    host = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = rules.select(host.alias("host"), "path", "verdict").filter("host <> '' AND path IS NOT NULL AND verdict IS NOT NULL")
    out = own.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(F.concat(F.lit("r"), "host", "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict", "host", "path")
    if listed is not None:
        url = listed.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).filter("host <> ''").distinct()
        out = out.unionByName(url.select(F.concat(F.lit("u"), "host", "path").alias("key"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"), "host", "path"))
    return out


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def _keys(depth: int, folders: int, lengths: list[int], single: bool) -> Column:
    """The keys of (host, path): at most `depth` labels, `folders` beginnings that end in /, those of `lengths` code points."""
    labels = F.split("host", "\\.")
    ends = F.transform(F.filter(F.sequence(F.lit(1), F.lit(max(1, depth))), lambda j: j <= F.size(labels)), lambda j: F.array_join(F.slice(labels, F.size(labels) - j + 1, j), "."))
    begins = F.array().cast("array<string>")
    if folders:
        begins = F.transform(F.filter(F.sequence(F.lit(1), F.lit(folders)), lambda j: j <= _slashes(F.col("path"))), lambda j: F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), j), F.lit("/")))
    if lengths:
        whole = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))
        begins = F.concat(begins, F.transform(whole, lambda n: F.left(F.col("path"), n)))
    keys = F.flatten(F.transform(ends, lambda e: F.transform(begins, lambda b: F.concat(F.lit("r"), e, b)))) if depth else F.array().cast("array<string>")
    return F.concat(keys, F.array(F.concat(F.lit("u"), "host", "path"))) if single else keys


class BlockedBloom:
    """(blocks, 8) words; of a key's hash the upper half chooses the block, 31 bits of the lower a bit in each word."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def build(cls, hashes: DataFrame, keys: int, most_blocks: int = MOST_BLOCKS) -> BlockedBloom:
        """From (h long), one row a key: the words are or-ed on the cluster; at most most_blocks rows of 64 bytes come here."""
        blocks = min(most_blocks, 1 << max(0, (keys * BITS_A_KEY // 512)).bit_length())
        low = F.col("h").bitwiseAND(F.lit(0x7FFFFFFF))  # times an odd number under 2^32 it stays a long
        bits = [F.expr(f"shiftleft(1L, cast(shiftright((low * {m}L) & 4294967295L, 26) AS int))") for m in ODD]
        placed = hashes.select(F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(blocks - 1)).alias("block"), low.alias("low"))
        rows = placed.groupBy("block").agg(*(F.bit_or(b).alias(f"w{j}") for j, b in enumerate(bits))).toArrow()
        words = np.zeros((blocks, 8), np.uint64)
        words[np.asarray(rows["block"])] = np.stack([np.asarray(rows[f"w{j}"]).view(np.uint64) for j in range(8)], axis=1)
        return cls(words)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.view(np.uint64)
        own = self.words[(h >> np.uint64(32)) & np.uint64(len(self.words) - 1)]
        bit = ((h & np.uint64(0x7FFFFFFF))[:, None] * np.array(ODD, np.uint64) & np.uint64(0xFFFFFFFF)) >> np.uint64(26)
        return ((own >> bit) & np.uint64(1)).all(axis=1)


def _probed(rows: DataFrame, bloom: BlockedBloom) -> DataFrame:
    """rows with `possible`: the places, among the row's hashes, of those that the filter lets pass."""
    shared = rows.sparkSession.sparkContext.broadcast(bloom.words)
    names = [c for c in rows.columns if c != "hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BlockedBloom(shared.value)
        for b in batches:
            h = b.column("hashes")
            size = np.asarray(h.value_lengths(), np.int64)
            row = np.repeat(np.arange(b.num_rows), size)
            passed = np.flatnonzero(own.may_hold(np.asarray(h.flatten(), np.int64)))
            first = np.r_[0, np.cumsum(size)][:-1]
            at = (passed - first[row[passed]]).astype(np.int32)
            offsets = np.r_[0, np.cumsum(np.bincount(row[passed], minlength=b.num_rows))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.ListArray.from_arrays(pa.array(offsets), pa.array(at))], names=[*names, "possible"])

    kinds = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.mapInArrow(run, f"{kinds}, possible array<int>")


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, most_blocks: int = MOST_BLOCKS, few: int = FEW, hot: int | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict) of every row of pages (page_id, url).

    rules (host, path, verdict: allow or block): of those that fit a URL the one with most code points decides, of equally long
    ones that of the longer host, and of equal rules block. listed (url): where no rule fits, a URL of the same host and path as
    a listed one is blocked, and any other allowed. Null urls and urls without :// have an empty host and path, which no rule
    fits. Rules with a null or empty part other than an empty path, and listed urls without a host, are left out. Repeated rows
    are judged alike and each returned; columns beyond page_id and url are not kept, whatever their names; empty tables and
    lists are as good as any. The longest URL costs no more keys than the list's own labels times its own folders.
    """
    spark = pages.sparkSession
    known = C.stored(_list(rules, listed))
    of_rule = F.col("key").startswith("r")
    folder = of_rule & F.col("path").endswith("/")
    n, size, depth, folders, lengths, single = known.agg(
        F.count("*"), F.sum(F.octet_length("key")), F.max(F.when(of_rule, F.size(F.split("host", "\\.")))), F.max(F.when(folder, _slashes(F.col("path")))),
        F.collect_set(F.when(of_rule & ~folder, F.length("path"))), F.coalesce(F.bool_or(~of_rule), F.lit(False)),
    ).first()
    keys = _keys(depth or 0, folders or 0, sorted(lengths), single)
    bloom = BlockedBloom.build(known.select(F.xxhash64("key").alias("h")), n, most_blocks)
    urls = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    probed = _probed(urls.withColumn("hashes", F.transform(keys, lambda k: F.xxhash64(k))), bloom)
    made = ["page_id", "url", "host", "path"]
    clean = probed.filter("size(possible) = 0").select(*made, F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    # rows that agree in all columns are one group of a partition, and as many again at the end
    hits = probed.filter("size(possible) > 0").select(*made, F.spark_partition_id().alias("part"), F.transform("possible", lambda i: keys[i]).alias("keys"))
    hits = hits.select(*made, "part", F.size("keys").alias("m"), F.explode("keys").alias("key"))
    best = F.max(F.when(F.col("l.key").isNotNull(), F.struct(F.col("l.rule").isNotNull().alias("is_rule"), F.length("l.rule").alias("chars"), F.length("l.host").alias("host_chars"), F.col("l.rule").alias("rule"), F.col("l.verdict").alias("verdict"))))
    found = _joined(hits, known, n <= few and (size or 0) <= FEW_BYTES, hot)
    judged = found.groupBy(*(F.col(f"h.{c}").alias(c) for c in (*made, "part", "m"))).agg(best.alias("best"), F.count("*").alias("rows"))
    judged = judged.select(*made, F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"), F.explode(F.expr("sequence(1L, rows div m)")).alias("copy"))
    return clean.unionByName(judged.drop("copy"))


def _joined(hits: DataFrame, known: DataFrame, small: bool, hot: int | None) -> DataFrame:
    """hits (h) left-joined with the list (l) by the whole key. A small list is broadcast. Of a large one, the keys that over
    1 / HOT_SHARE of the hits have (so at most HOT_SHARE of them) are broadcast and the others shuffled."""
    on = F.col("h.key") == F.col("l.key")
    if small:
        return hits.alias("h").join(F.broadcast(known).alias("l"), on, "left")
    hits = C.stored(hits)
    most = hot or max(10_000, hits.count() // HOT_SHARE)
    crowded = C.stored(hits.groupBy("key").count().filter(F.col("count") > most).select("key"))
    own = known.join(F.broadcast(crowded), "key", "left_semi")
    some = hits.join(F.broadcast(crowded), "key", "left_semi").alias("h").join(F.broadcast(own).alias("l"), on, "left")
    return some.union(hits.join(F.broadcast(crowded), "key", "left_anti").alias("h").join(known.alias("l"), on, "left")) if crowded.count() else hits.alias("h").join(known.alias("l"), on, "left")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(C.table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


SQL = f"""
WITH r(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
u AS (SELECT row_number() OVER () AS i, page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT i, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m USING (i)
"""
