"""Cell tables: recursive median cells with exact boxes; a slab or box query reads only the cells that it meets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinate.functions import vectors as V
from ordinate.operators import ranges, sampling

TRAIN_ROWS = 16_384


def median_cells(columns: Sequence[str], x: np.ndarray, depth: int) -> Column:
    """The cell number as an expression: at each level the widest column (in ranks of the sample) is cut at its median."""

    def cut(rows: np.ndarray, level: int, number: int) -> Column:
        if level == depth or len(rows) < 2:
            return F.lit(number << (depth - level))
        spread = np.ptp(rows, axis=0) / np.maximum(np.ptp(x, axis=0), 1e-300)
        j = int(np.argmax(spread))
        at = float(np.median(rows[:, j]))
        left = rows[:, j] <= at
        if left.all():
            return F.lit(number << (depth - level))
        return F.when(F.col(columns[j]) <= at, cut(rows[left], level + 1, 2 * number)).otherwise(cut(rows[~left], level + 1, 2 * number + 1))

    return cut(x, 0, 0)


def best_split(df: DataFrame, columns: Sequence[str], tries: int = 5, seed: int = 42) -> tuple[list[float], float, float]:
    """(normal, threshold, balance) of the most even of `tries` random linear splits at the sample's middle score; balance is
    | left - right | / n over all rows. All tries are counted in one scan."""
    rows = sampling.sample(df.withColumn("__id", F.xxhash64(*columns)), TRAIN_ROWS, "__id").select(*columns).collect()
    x = np.array([list(r) for r in rows], float).reshape(-1, len(columns))
    normals = [V.random_unit(len(columns), seed + i) for i in range(tries)]
    cuts = [float(np.median(x @ np.array(w))) if len(x) else 0.0 for w in normals]
    n, *left = df.agg(F.count("*"), *(F.count_if(V.dot([F.col(c) for c in columns], w) <= t) for w, t in zip(normals, cuts))).first()
    balance = [abs(2 * k - n) / max(1, n) for k in left]
    best = int(np.argmin(balance))
    return normals[best], cuts[best], balance[best]


@dataclass
class CellIndex:
    """members (the points with cell_id) and cells (cell_id, lo_c, hi_c, n). Appended points keep it exact once their
    cells' boxes are worked out again."""

    members: DataFrame
    cells: DataFrame
    columns: list[str]
    cell_of: Column

    @classmethod
    def build(cls, df: DataFrame, columns: Sequence[str], id_column: str, depth: int = 6, path: str | None = None) -> CellIndex:
        rows = sampling.sample(df, TRAIN_ROWS, id_column).select(*columns).collect()
        x = np.array([list(r) for r in rows], float).reshape(-1, len(columns))
        cell_of = median_cells(columns, x, depth)
        members = df.withColumn("cell_id", cell_of)
        if path:
            members.write.mode("overwrite").partitionBy("cell_id").parquet(path)
            members = df.sparkSession.read.parquet(path)
        return cls(members, ranges.box_of(members, columns, ["cell_id"]), list(columns), cell_of)

    def _in(self, cells: Column, residual: Column) -> DataFrame:
        active = self.cells.filter(cells).select("cell_id")  # at most 2^depth ids
        return self.members.join(F.broadcast(active), "cell_id", "left_semi").filter(residual)

    def stripe(self, w: Sequence[float], lo: float, hi: float) -> DataFrame:
        low, high = [F.col(f"lo_{c}") for c in self.columns], [F.col(f"hi_{c}") for c in self.columns]
        return self._in(ranges.box_overlap(low, high, w, lo - 1e-9, hi + 1e-9) > 0, ranges.stripe([F.col(c) for c in self.columns], w, lo, hi))

    def box(self, lo: Sequence[float], hi: Sequence[float]) -> DataFrame:
        low, high = [F.col(f"lo_{c}") for c in self.columns], [F.col(f"hi_{c}") for c in self.columns]
        meets = ranges.boxes_meet(low, high, [F.lit(float(x)) for x in lo], [F.lit(float(x)) for x in hi])
        return self._in(meets, ranges.box([F.col(c) for c in self.columns], lo, hi))

    def append(self, df: DataFrame) -> CellIndex:
        """With new points, dealt to cells by the same cuts; the boxes grow to hold them."""
        members = self.members.unionByName(df.withColumn("cell_id", self.cell_of))
        return CellIndex(members, ranges.box_of(members, self.columns, ["cell_id"]), self.columns, self.cell_of)

    def check(self) -> bool:
        """Every point is inside its cell's box, and the cells count all points."""
        joined = self.members.join(self.cells, "cell_id")
        inside = reduce(lambda a, b: a & b, (F.col(c).between(F.col(f"lo_{c}"), F.col(f"hi_{c}")) for c in self.columns))
        return joined.filter(~inside).isEmpty() and self.cells.agg(F.sum("n")).first()[0] == self.members.count()


def score_of(columns: Sequence[str], w: Sequence[float]) -> Column:
    return V.dot([F.col(c) for c in columns], w)
