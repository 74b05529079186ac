"""Recall, means of logs, merges of logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall(found: DataFrame, truth: DataFrame, on: Sequence[str]) -> DataFrame:
    """(truth, hits, recall, size_ratio): hits over truth, 1 where the truth is empty; and the ratio of the sizes."""
    hits = truth.join(found.select(*on).distinct(), list(on), "left_semi").agg(F.count("*").alias("hits"))
    sizes = truth.agg(F.count("*").alias("truth")).crossJoin(found.agg(F.count("*").alias("found")))  # one row each
    ratio = lambda c: F.when(F.col("truth") == 0, 1.0).otherwise(F.col(c) / F.col("truth"))
    return sizes.crossJoin(hits).select("truth", "hits", ratio("hits").alias("recall"), ratio("found").alias("size_ratio"))


def recall_at_k(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, recall): (qid, id, rank) of each; the share of a query's k true ids that are among its found ones."""
    t = truth.filter(F.col("rank") <= k)
    hit = t.join(found.select("qid", "id").withColumn("hit", F.lit(1)).distinct(), ["qid", "id"], "left")
    return hit.groupBy("qid").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))


def group_mean(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*(F.avg(c).alias(c) for c in columns))


def merge(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Equi join; columns that both have, beside the keys, get the suffixes."""
    both = (set(left.columns) & set(right.columns)) - set(on)
    for c in both:
        left, right = left.withColumnRenamed(c, c + suffixes[0]), right.withColumnRenamed(c, c + suffixes[1])
    return left.join(right, list(on), how)


def concat(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def split_balance(df: DataFrame, left: Column) -> DataFrame:
    """(n_left, n_right, balance): |L - R| / n; infinite where a side is empty."""
    both = df.agg(F.count_if(left).alias("n_left"), F.count_if(~left).alias("n_right"))
    gap = F.abs(F.col("n_left") - F.col("n_right")) / (F.col("n_left") + F.col("n_right"))
    return both.withColumn("balance", F.when((F.col("n_left") == 0) | (F.col("n_right") == 0), F.lit(float("inf"))).otherwise(gap))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
