"""Fagin's algorithm and the threshold algorithm over stored sorted lists.

A list a coordinate: (id, value, ord) in the order of what the coordinate adds to a score, in folders of so many ranks each, so that
the first ranks of a list are read without the rest. Values of a row by its id come from a table in the order of the ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinate.functions import vectors as V
from ordinate.operators import keep, rank

#: Ranks in a folder of a list; ids that are looked up by name, so that row groups without them are skipped.
RANKS, NAMED = 65_536, 1000


@dataclass
class SortedLists:
    """lists: by column, best value first for a positive weight; rows (id, columns). signs: of the weights that they serve."""

    lists: list[DataFrame]
    rows: DataFrame
    columns: list[str]
    signs: list[int]
    n: int
    ranks: int
    read: int = 0

    @classmethod
    def build(cls, df: DataFrame, columns: Sequence[str], w: Sequence[float], id_column: str = "id", path: str | None = None, ranks: int = RANKS) -> SortedLists:
        """For weights of the signs of w; rows with a null coordinate are left out. Ties stand by id. Ranks are numbered range by
        range on the cluster."""
        path = path or f"{keep.shared_dir(df.sparkSession)}/lists-{uuid.uuid4().hex}"
        own = df.select(F.col(id_column).alias("id"), *(F.col(c).cast("double").alias(c) for c in columns)).dropna()
        n = own.count()
        signs = [(x > 0) - (x < 0) for x in w]
        lists = []
        for c, sign in zip(columns, signs):
            order = own.select("id", F.col(c).alias("value"), (F.col(c) * F.lit(-float(sign))).alias("key"))
            placed = rank.numbered(order, ["key", "id"], -(-n // keep.FILE_ROWS)).select("id", "value", (F.col("ord") + 1).alias("ord"))
            part = F.expr(f"cast((ord - 1) div {ranks} AS int)").alias("part")
            placed.select("id", "value", "ord", part).sortWithinPartitions("part", "ord").write.mode("overwrite").partitionBy("part").parquet(f"{path}/{c}")
            lists.append(df.sparkSession.read.schema(f"id {own.schema['id'].dataType.simpleString()}, value double, ord long, part int").parquet(f"{path}/{c}"))
        rows = keep.written(own.repartitionByRange(max(1, -(-n // keep.FILE_ROWS)), "id").sortWithinPartitions("id"), f"{path}/rows")
        return cls(lists, rows, list(columns), signs, n, ranks)

    def _tops(self, w: Sequence[float], depth: int) -> DataFrame:
        """(id, list, ord, part) of the first `depth` ranks of every list."""
        if [(x > 0) - (x < 0) for x in w] != self.signs:
            raise ValueError("the lists were built for weights of other signs")
        tops = [t.filter((F.col("part") <= (depth - 1) // self.ranks) & (F.col("ord") <= depth)).select("id", F.lit(j).alias("list"), "ord", (F.col("value") * float(x)).alias("adds")) for j, (t, x) in enumerate(zip(self.lists, w))]
        self.read = len(tops) * min(self.n, depth)
        return reduce(DataFrame.unionByName, tops)

    def _guess(self, k: int) -> int:
        """The depth at which k ids stand in all of so many lists whose orders have nothing to do with each other."""
        m = len(self.lists)
        return max(1, min(self.n, max(k, round(self.n ** ((m - 1) / m) * k ** (1 / m)))))

    def _scored(self, seen: DataFrame, w: Sequence[float]) -> DataFrame:
        """seen (id, first) with its scores, by a look-up of the ids: few of them are named, more are joined."""
        few = [r["id"] for r in seen.select("id").limit(NAMED + 1).collect()]
        rows = self.rows.filter(F.col("id").isin(few)) if len(few) <= NAMED else self.rows
        return seen.join(rows, "id").select("id", "first", V.dot([F.col(c) for c in self.columns], w).alias("score"))

    def _result(self, scored: DataFrame, stop: int, k: int) -> DataFrame:
        best = scored.filter(F.col("first") <= stop).orderBy(F.desc("score"), "id").offset(k - 1).limit(1)
        return best.select("id", "score", F.lit(stop).cast("int").alias("depth"))

    def fagin(self, w: Sequence[float], k: int) -> DataFrame:
        """(id, score, depth): lists are read until k ids stand in all of them; all ids seen are scored. k beyond the rows gives the
        last row. Reading starts with the depth that independent lists have and is doubled where that is too little."""
        k = min(k, self.n)
        depth = self._guess(k)
        while True:
            tops = self._tops(w, depth)
            seen = tops.groupBy("id").agg(F.count("*").alias("lists"), F.max("ord").alias("last"), F.min("ord").alias("first"))
            kth = seen.filter(F.col("lists") == len(self.lists)).orderBy("last").offset(k - 1).limit(1).collect()
            if kth or depth >= self.n:
                break
            depth = min(self.n, 2 * depth)
        stop = kth[0]["last"]
        return self._result(self._scored(keep.stored(seen.filter(F.col("first") <= stop).select("id", "first")), w), stop, k)

    def threshold(self, w: Sequence[float], k: int) -> DataFrame:
        """(id, score, depth): reading stops at the first rank at which k of the ids seen score at least what the lists' values
        there add up to. An id counts from the later of two ranks on: where it is first seen, and where the threshold falls to
        its score, which is one more than the number of thresholds above it; the k-th least of these is where reading stops."""
        k = min(k, self.n)
        depth = max(k, self._guess(k) // 2)
        while True:
            tops = self._tops(w, depth)
            seen = keep.stored(self._scored(keep.stored(tops.groupBy("id").agg(F.min("ord").alias("first"))), w))
            steps = tops.groupBy("ord").agg(F.sum("adds").alias("v"))
            values = steps.select("v", F.lit(1).alias("one")).unionByName(seen.select(F.col("score").alias("v"), F.lit(0).alias("one")))
            placed = rank.ranked(keep.stored(values.groupBy("v").agg(F.sum("one").alias("one"))), "v", "one")
            above = placed.select(F.col("v").alias("score"), (F.lit(depth + 1) - F.col("before") - F.col("one")).alias("from"))
            kth = seen.join(above, "score").select(F.greatest("first", "from").alias("at")).orderBy("at").offset(k - 1).limit(1).collect()
            if kth and kth[0]["at"] <= depth or depth >= self.n:
                break
            depth = min(self.n, 2 * depth)
        return self._result(seen, min(int(kth[0]["at"]), self.n), k)
