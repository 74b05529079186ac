"""The row at rank k by a linear score or a distance, without the rows before it where that pays."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordinate.functions import vectors as V
from ordinate.operators import keep, sampling

#: Up to this k a top-k merge is cheaper than two passes.
DIRECT_K = 50_000


def kth_exhaustive(df: DataFrame, score: Column, k: int, id_column: str = "id") -> DataFrame:
    """(id, score) of the k-th largest, k from 1, ties by id; k beyond the rows raises IndexError."""
    if k < 1:
        raise IndexError("k starts at 1")
    out = df.select(F.col(id_column), score.alias("score")).orderBy(F.desc("score"), id_column).offset(k - 1).limit(1)
    if out.isEmpty():
        raise IndexError(f"k = {k} is beyond the rows")
    return out


def kth_certified(df: DataFrame, score: Column, k: int, eps: float = 0.01, id_column: str = "id", direct: int = DIRECT_K) -> DataFrame:
    """The same row by score intervals that are known to hold rank k: bounds from quantiles, counts above and inside to certify
    them, narrowed until at most 4 * direct rows are inside, of which a top-k is taken. Rows tied at the k-th score, if they
    are more, are narrowed by their ids (numeric) in the same way. A k near an end goes by a top-k from that end."""
    s = df.select(F.col(id_column), score.alias("score"))
    n = s.count()
    if not 1 <= k <= n:
        raise IndexError(f"k = {k} of {n} rows")
    if k <= direct:
        return s.orderBy(F.desc("score"), id_column).offset(k - 1).limit(1)
    if n - k < direct:
        return s.orderBy("score", F.desc(id_column)).offset(n - k).limit(1)
    lo, hi, below, held = _narrowed(s, "score", n - k + 1, n, eps, 4 * direct)
    inside, above = s.filter(F.col("score").between(lo, hi)), n - below - held
    if held > 4 * direct:  # lo = hi: ids decide
        lo, hi, before, held = _narrowed(inside, id_column, k - above, held, eps, 4 * direct)
        return inside.filter(F.col(id_column).between(lo, hi)).orderBy(id_column).offset(k - above - before - 1).limit(1)
    return inside.orderBy(F.desc("score"), id_column).offset(k - above - 1).limit(1)


def _narrowed(s: DataFrame, column: str, k: int, n: int, eps: float, most: int) -> tuple:
    """(lo, hi, rows below, rows inside) of a closed interval that holds the k-th smallest, with at most `most` rows or one value."""
    c = F.col(column)
    lo, hi = s.agg(F.min(c), F.max(c)).first()
    below, held, width = 0, n, eps
    while held > most and lo != hi:
        p = (k - below) / held
        inside = s.filter(c.between(lo, hi))
        a, mid, z = inside.agg(F.percentile_approx(c, [max(0.0, p - width), min(1.0, p), min(1.0, p + width)], 10_000)).first()[0]
        under, within, less, same, next_down, next_up = inside.agg(F.count_if(c < a), F.count_if(c.between(a, z)), F.count_if(c < mid), F.count_if(c == mid), F.max(F.when(c < mid, c)), F.min(F.when(c > mid, c))).first()
        if below + under < k <= below + under + within and within <= held / 2:
            lo, hi, below, held = a, z, below + under, within
        elif k <= below + less:  # the middle value parts them in any case
            hi, held = next_down, less
        elif k <= below + less + same:
            lo, hi, below, held = mid, mid, below + less, same
        else:
            lo, below, held = next_up, below + less + same, held - less - same
    return lo, hi, below, held


#: Weights that one scan serves.
WEIGHTS = 64


def kth_many(df: DataFrame, columns: Sequence[str], weights: Sequence[tuple[int, Sequence[float], int]], id_column: str = "id", most: int = 4 * DIRECT_K, accuracy: int = 10_000) -> DataFrame:
    """(wid, id, score): for every (wid, weights, k) the k-th largest by its linear score, ties by id (numeric). WEIGHTS of them share
    each scan: one for the sketches of all their scores, mergeable and good to n / accuracy ranks, and one to count what
    lies below and inside the intervals that the sketches give, which certifies them; both again within the intervals until each
    has at most `most` rows or one score. As a round leaves some 4 / accuracy of the rows, two do for any table. Then one scan takes
    what is inside. Rows with a null coordinate are left out; a k beyond the rows raises IndexError."""
    out = []
    for at in range(0, len(weights), WEIGHTS):
        out.append(_kth_block(df.dropna(subset=list(columns)), columns, weights[at : at + WEIGHTS], id_column, most, accuracy))
    return reduce(DataFrame.unionByName, out)


def _kth_block(df: DataFrame, columns: Sequence[str], weights: Sequence[tuple[int, Sequence[float], int]], id_column: str, most: int, accuracy: int) -> DataFrame:
    cols = [F.col(c) for c in columns]
    score = [V.dot(cols, w) for _, w, _ in weights]
    first = df.agg(F.count("*").alias("n"), *(f(s).alias(f"{name}{j}") for j, s in enumerate(score) for name, f in (("lo", F.min), ("hi", F.max)))).first()
    n = first["n"]
    if any(not 1 <= k <= n for _, _, k in weights):
        raise IndexError(f"a k is beyond the {n} rows")
    # [lo, hi, rows below, rows inside, k-th smallest] of each weight
    state = [[first[f"lo{j}"], first[f"hi{j}"], 0, n, n - k + 1] for j, (_, _, k) in enumerate(weights)]
    while todo := [j for j, (lo, hi, _, held, _) in enumerate(state) if held > most and lo != hi]:
        inside = {j: score[j].between(*state[j][:2]) for j in todo}
        width = {j: max(2 / accuracy, 2 / state[j][3]) for j in todo}
        share = {j: (state[j][4] - state[j][2]) / state[j][3] for j in todo}
        ends = df.agg(*(F.percentile_approx(F.when(inside[j], score[j]), [max(0.0, share[j] - width[j]), min(1.0, share[j]), min(1.0, share[j] + width[j])], accuracy) for j in todo)).first()
        asked = []
        for j, (a, mid, z) in zip(todo, ends):
            s = F.when(inside[j], score[j])
            asked += [F.count_if(s < a), F.count_if(s.between(a, z)), F.count_if(s < mid), F.count_if(s == mid), F.max(F.when(s < mid, s)), F.min(F.when(s > mid, s))]
        counts = df.agg(*(x.alias(f"c{i}") for i, x in enumerate(asked))).first()
        for i, (j, (a, mid, z)) in enumerate(zip(todo, ends)):
            under, within, less, same, down, up = counts[6 * i : 6 * i + 6]
            _, _, below, held, kth = state[j]
            if below + under < kth <= below + under + within and within <= held / 2:
                state[j][:4] = [a, z, below + under, within]
            elif kth <= below + less:
                state[j][1], state[j][3] = down, less
            elif kth <= below + less + same:
                state[j][:4] = [mid, mid, below + less, same]
            else:
                state[j][0], state[j][2], state[j][3] = up, below + less + same, held - less - same
    rows = F.array(*(F.when(score[j].between(lo, hi), F.struct(F.lit(weights[j][0]).cast("long").alias("wid"), score[j].alias("score"), F.lit(n - below - held).alias("above"))) for j, (lo, hi, below, held, _) in enumerate(state) if held <= most))
    few = df.select(F.col(id_column), F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("r.wid", id_column, "r.score", "r.above") if any(s[3] <= most for s in state) else None
    out = []
    if few is not None:
        ks = F.create_map(*(F.lit(x) for wid, _, k in weights for x in (wid, k)))
        place = F.row_number().over(Window.partitionBy("wid").orderBy(F.desc("score"), id_column))  # at most `most` rows each
        out.append(few.withColumn("place", place + F.col("above")).filter(F.col("place") == ks[F.col("wid").cast("int")]).select("wid", id_column, "score"))
    for (wid, _, k), s, (lo, hi, below, held, _) in zip(weights, score, state):
        if held > most:  # one score: ids decide
            tied = df.filter(s == lo).select(F.col(id_column))
            a, z, before, _ = _narrowed(tied, id_column, k - (n - below - held), held, 0.01, most)
            near = tied.filter(F.col(id_column).between(a, z)).orderBy(id_column).offset(k - (n - below - held) - before - 1).limit(1)
            out.append(near.select(F.lit(wid).cast("long").alias("wid"), id_column, F.lit(lo).alias("score")))
    return reduce(DataFrame.unionByName, out)


def _lists(df: DataFrame, parts: Sequence[Column], depth: int, id_column: str) -> DataFrame:
    """(id, list, rank, part) of the `depth` best rows of each part; ranks are over those only."""
    out = []
    for j, p in enumerate(parts):
        top = df.select(F.col(id_column), p.alias("part")).orderBy(F.desc("part"), id_column).limit(depth)
        rank = F.row_number().over(Window.orderBy(F.desc("part"), id_column))  # over `depth` rows
        out.append(top.select(id_column, F.lit(j).alias("list"), rank.alias("rank"), "part"))
    return reduce(DataFrame.unionByName, out)


def kth_fagin(df: DataFrame, columns: Sequence[str], w: Sequence[float], k: int, id_column: str = "id") -> DataFrame:
    """(id, score, depth): sorted lists are read until k ids stand in all of them; all ids seen are scored. k beyond the
    rows gives the last row. The depth is found by doubling, so a list is never ranked further than twice its need."""
    parts = [F.col(c).cast("double") * float(x) for c, x in zip(columns, w, strict=True)]
    n, depth = df.count(), max(k, 16)
    k = min(k, n)
    while True:
        lists = _lists(df, parts, depth, id_column)
        seen = lists.groupBy(id_column).agg(F.count("*").alias("lists"), F.max("rank").alias("last"), F.min("rank").alias("first"))
        full = seen.filter(F.col("lists") == len(parts)).orderBy("last").select("last").limit(k).collect()
        if len(full) >= k or depth >= n:
            break
        depth *= 2
    stop = full[k - 1]["last"]
    near = seen.filter(F.col("first") <= stop).select(id_column)
    return df.join(near, id_column, "left_semi").select(id_column, V.dot([F.col(c) for c in columns], w).alias("score"), F.lit(stop).alias("depth")).orderBy(F.desc("score"), id_column).offset(k - 1).limit(1)


def kth_threshold(df: DataFrame, columns: Sequence[str], w: Sequence[float], k: int, id_column: str = "id") -> DataFrame:
    """(id, score, depth): as above, but reading stops once k ids seen score at least the sum of the lists' frontier."""
    cols = [F.col(c).cast("double") for c in columns]
    parts = [c * float(x) for c, x in zip(cols, w, strict=True)]
    n, depth = df.count(), max(k, 16)
    k = min(k, n)
    while True:
        lists = _lists(df, parts, min(depth, n), id_column)
        frontier = lists.groupBy("rank").agg(F.sum("part").alias("threshold"))
        seen = df.select(id_column, V.dot(cols, w).alias("score")).join(lists.groupBy(id_column).agg(F.min("rank").alias("first")), id_column)
        # rank x stops if k ids with first <= x score its threshold; both tables have at most depth * lists rows, and stream
        # through the driver in rank order
        rows = seen.select("first", "score").orderBy("first").toLocalIterator()
        hit = _first_stop(rows, frontier.orderBy("rank").toLocalIterator(), k)
        if hit is not None or depth >= n:
            break
        depth *= 2
    hit = hit if hit is not None else n
    return seen.filter(F.col("first") <= hit).select(id_column, "score", F.lit(hit).alias("depth")).orderBy(F.desc("score"), id_column).offset(k - 1).limit(1)


def _first_stop(rows: Iterable, steps: Iterable, k: int) -> int | None:
    """Both in rank order, streamed; k scores are held."""
    best: list[float] = []
    rows = iter(rows)
    row = next(rows, None)
    for step in steps:
        while row is not None and row["first"] <= step["rank"]:
            heapq.heappush(best, row["score"]) if len(best) < k else heapq.heappushpop(best, row["score"])
            row = next(rows, None)
        if len(best) == k and best[0] >= step["threshold"]:
            return step["rank"]
    return None


def find_stripe(sample: DataFrame, score: Column, k: int, n: int, eps: float, one_sided: bool = True) -> tuple[float, float]:
    """Bounds of the score that ranks (k/n - eps, k/n + eps) have in a sample (rows bounded by the sample's size).
    one_sided: a rank beyond the sample's ends opens the interval there; else it is clamped to the end."""
    s = [r[0] for r in sample.select(score.alias("s")).orderBy(F.desc("s")).collect()]
    m = len(s)
    first, last = math.floor((k / n - eps) * m), math.ceil((k / n + eps) * m)
    hi = math.inf if one_sided and first <= 0 else s[max(0, min(first, m - 1))]
    lo = -math.inf if one_sided and last >= m - 1 else s[max(0, min(last, m - 1))]
    return lo, hi


def kth_candidates(df: DataFrame, score: Column, k: int, eps: float, d: int, id_column: str = "id") -> DataFrame:
    """(id, score) of the rows in the stripe of rank k, by an eps-sample: they should hold the k-th row."""
    n = df.count()
    lo, hi = find_stripe(sampling.sample(df, min(n, sampling.sample_size(d, eps)), id_column), score, k, n, eps)
    return df.select(id_column, score.alias("score")).filter(F.col("score").between(lo, hi))


def quickselect(df: DataFrame, distance: Column, k: int, id_column: str = "id") -> DataFrame:
    """(id, score) at 0-based rank k, ascending; of equal scores the smallest id, whichever of them the rank falls on."""
    s = df.select(id_column, distance.alias("score"))
    if k < 0 or k >= s.count():
        raise ValueError("k is out of range")
    kth = s.orderBy("score", id_column).offset(k).limit(1).first()["score"]
    return s.filter(F.col("score") == kth).groupBy("score").agg(F.min(id_column).alias(id_column)).select(id_column, "score")


def sample_stripe(df: DataFrame, score: Column, share: float) -> DataFrame:
    """(lo, hi, n): the window of int(share * n) neighbouring scores whose closed interval holds a share nearest to `share`;
    the first of equals. Ranks come from counts of each score, so ties cost one row; they are summed range by range."""
    s = df.groupBy(score.alias("s")).count()
    n = df.count()
    w = max(1, int(share * n))
    ordered = ranked(s, "s", "count")  # running counts without one task for all
    ends = ordered.select("s", "count", (F.col("before") + 1).alias("first"), (F.col("before") + F.col("count")).alias("last"))
    # windows start at each row; all starts within one score are alike but for where their end falls
    starts = ends.select(F.col("s").alias("lo"), F.col("first").alias("lo_first"), F.explode(F.sequence("first", "last")).alias("i")).filter(F.col("i") + w - 1 <= n)
    to = starts.withColumn("j", F.col("i") + w - 1)
    hi = ends.select(F.col("s").alias("hi"), F.col("last").alias("hi_last"), F.explode(F.sequence("first", "last")).alias("j"))
    held = to.join(hi, "j").withColumn("n", F.col("hi_last") - F.col("lo_first") + 1)
    return held.orderBy(F.abs(F.col("n") / n - share), "i").limit(1).select("lo", "hi", "n")


def ranked(df: DataFrame, by: str, weight: str, parts: int = 64) -> DataFrame:
    """df with `before`, the sum of `weight` over the rows with a smaller value of `by` (distinct values, no nulls). Values are
    parted at fixed ones from a bounded sample by hash, summed there, and shifted by the parts' totals (both on the driver)."""
    drawn = sorted(r[0] for r in df.select(by).orderBy(F.xxhash64(by), by).limit(16 * parts).collect())
    cuts = sorted({drawn[i * len(drawn) // parts] for i in range(1, parts)}) if drawn else []
    if not cuts:
        part = F.lit(0)
    else:
        kind = df.schema[by].dataType
        ends = F.array(*(F.lit(v).cast(kind) for v in cuts))
        part = F.size(F.filter(ends, lambda v: v <= F.col(by)))
    placed = df.withColumn("__p", part)
    totals = {r["__p"]: r["t"] for r in placed.groupBy("__p").agg(F.sum(weight).alias("t")).collect()}
    shift, run = [], 0
    for p in sorted(totals):
        shift += [F.lit(p), F.lit(run)]
        run += totals[p]
    inner = F.sum(weight).over(Window.partitionBy("__p").orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
    offset = F.create_map(*shift)[F.col("__p")] if shift else F.lit(0)
    return placed.withColumn("before", F.coalesce(inner, F.lit(0)) + offset).drop("__p")


def numbered(df: DataFrame, by: Sequence[str], parts: int, path: str | None = None) -> DataFrame:
    """df with `ord`, its rows' places from 0 in the order of `by` (which tells rows apart). Ranges of rows are numbered each in
    its task and stored; what a range starts with is the number of rows in those before it."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(n, n + b.num_rows))], names=[*b.schema.names, "range", "own"])
            n += b.num_rows

    ranged = df.repartitionByRange(max(1, parts), *by).sortWithinPartitions(*by)
    table = keep.written(ranged.mapInArrow(run, f"{kinds}, range int, own long"), path)
    before = F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = table.groupBy("range").count().select("range", before.alias("before"))  # a row a range
    return table.join(F.broadcast(starts), "range").withColumn("ord", F.col("before") + F.col("own")).drop("range", "own", "before")
