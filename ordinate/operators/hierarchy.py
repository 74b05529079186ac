"""A ball table of several levels: the lowest balls hold the points, each level above holds the balls of the one below, and a
query goes down from the top, leaves out what it cannot meet, and takes what lies wholly inside without a further test."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinate.functions import vectors as V
from ordinate.operators import balls, ranges, rank


@dataclass
class Hierarchy:
    """nodes (level, node, parent, center, radius, n): level 0 are the index's balls, at most balls.MOST_BALLS of them, so the
    table has under twice as many rows for any number of points."""

    index: balls.BallIndex
    nodes: DataFrame
    depth: int

    @classmethod
    def build(cls, points: DataFrame, branching: int = 4, levels: int = 10, **options) -> Hierarchy:
        """Bottom up: each level is the k-means of the centres below, a `branching`-th as many, until one is left or `levels`
        are there. Radii reach round the children's balls, so nothing is lost."""
        index = balls.BallIndex.build(points, **options)
        low = sorted(index.balls.collect(), key=lambda r: r["ball_id"])
        rows: list[list] = []
        number = [r["ball_id"] for r in low]
        c, reach, n = np.array([r["center"] for r in low]), np.array([r["radius"] for r in low]), np.array([r["n"] for r in low])
        level = 0
        while len(number):
            top = len(number) == 1 or level + 1 >= levels
            up = np.zeros((1, c.shape[1])) if top else balls.lloyd(c, max(1, len(c) // branching))
            near = balls.nearest(c, up)
            rows += [[level, int(i), None if top else int(p), v.tolist(), float(r), int(k)] for i, p, v, r, k in zip(number, near, c, reach, n)]
            if top:
                break
            own = [np.flatnonzero(near == p) for p in range(len(up))]
            number = [p for p, x in enumerate(own) if len(x)]
            own = [x for x in own if len(x)]
            up = up[number]
            reach = np.array([max(float(np.linalg.norm(c[i] - u)) + reach[i] for i in x) for u, x in zip(up, own)])
            n = np.array([n[x].sum() for x in own])
            c, level = up, level + 1
        nodes = points.sparkSession.createDataFrame(rows, "level int, node int, parent int, center array<double>, radius double, n long")
        return cls(index, nodes, level + 1)

    def coverage(self) -> DataFrame:
        """(level, node, ball_id): the lowest balls under every node, itself included at level 0."""
        out = self.nodes.filter("level = 0").select("level", "node", F.col("node").alias("ball_id"))
        last = out
        for level in range(1, self.depth):
            parent = self.nodes.filter(F.col("level") == level - 1).select("node", "parent")
            last = last.join(F.broadcast(parent), "node").select(F.lit(level).alias("level"), F.col("parent").alias("node"), "ball_id")
            out = out.unionByName(last)
        return out

    def descend(self, w: Sequence[float], lo: float, hi: float) -> DataFrame:
        """(ball_id, whole): the lowest balls that the slab meets, found from the top; whole: the slab holds all of the ball, or
        of one above it."""
        size = math.sqrt(sum(x * x for x in w))
        s, reach = V.dot(F.col("center"), w), F.col("radius") * size + F.lit(1e-9) * (1 + F.col("radius") * size)
        known = self.nodes.withColumns({"meets": ranges.ball_meets(F.col("center"), F.col("radius"), w, lo, hi), "inside": (s - reach >= lo) & (s + reach <= hi)})
        known = known.select("level", "node", "parent", "meets", "inside")
        active = known.filter((F.col("level") == self.depth - 1) & F.col("meets")).select("node", F.col("inside").alias("whole"))
        for level in range(self.depth - 2, -1, -1):
            children = known.filter(F.col("level") == level)
            below = children.join(F.broadcast(active.select(F.col("node").alias("parent"), "whole")), "parent")  # of bounded size, as all of nodes
            active = below.filter(F.col("whole") | F.col("meets")).select("node", (F.col("whole") | F.col("inside")).alias("whole"))
        return active.select(F.col("node").alias("ball_id"), "whole")

    def stripe(self, w: Sequence[float], lo: float, hi: float) -> DataFrame:
        """(id, score) of the points in the slab. Points of whole balls need no test. The slab's balls are few and known, so they
        prune the stored files."""
        found = self.descend(w, lo, hi).collect()  # at most MOST_BALLS rows
        members, score = self.index.members, V.dot(F.col("vec"), w).alias("score")
        whole, part = ([r["ball_id"] for r in found if r["whole"] == side] for side in (True, False))
        tested = members.filter(F.col("ball_id").isin(part)).select("id", score).filter(F.col("score").between(lo, hi))
        return tested.unionByName(members.filter(F.col("ball_id").isin(whole)).select("id", score)) if whole else tested

    def candidates(self, w: Sequence[float], k: int) -> DataFrame:
        """The stripe in which rank k (from 1, descending) should lie, in the order of ids."""
        lo, hi = rank.find_stripe(self.index.sample, V.dot(F.col("vec"), w), k, self.index.n, self.index.eps)
        return self.stripe(w, lo, hi).select("id").orderBy("id")

    def check(self) -> bool:
        """Every ball is inside its parent's, counts add up at every level, and every point is inside its ball."""
        up = self.nodes.select((F.col("level") - 1).alias("level"), F.col("node").alias("parent"), F.col("center").alias("c"), F.col("radius").alias("r"))
        loose = self.nodes.join(up, ["level", "parent"]).filter(V.l2_distance(F.col("center"), F.col("c")) + F.col("radius") > F.col("r") + 1e-6)
        sums = [r["n"] for r in self.nodes.groupBy("level").agg(F.sum("n").alias("n")).collect()]
        inside = self.index.members.join(F.broadcast(self.index.balls.drop("n")), "ball_id").filter(V.l2_distance(F.col("vec"), F.col("center")) > F.col("radius") + 1e-6)
        return loose.isEmpty() and all(n == self.index.n for n in sums) and inside.isEmpty()
