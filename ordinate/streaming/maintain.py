"""Statistics of balls or cells kept over a stream: counts, radii and boxes are running aggregates in Spark's state store, keyed by the
node, so a restart goes on from the checkpoint and a batch costs what its own nodes cost."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinate.operators import balls, join


def placed(points: DataFrame, centers: np.ndarray) -> DataFrame:
    """(node, far, vec): points (id, vec), of a stream or a table, with the nearest centre and its distance."""
    shared = points.sparkSession.sparkContext.broadcast(centers)

    def run(batches):
        c = shared.value
        for b in batches:
            x = join.vectors(b.column(0))
            at = balls.nearest(x, c) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.sqrt(((x - c[at]) ** 2).sum(axis=1)) if len(x) else np.zeros(0)), b.column(0)], names=["node", "far", "vec"])

    return points.filter("vec IS NOT NULL").select("vec").mapInArrow(run, "node int, far double, vec array<double>")


def statistics(rows: DataFrame, d: int) -> DataFrame:
    """(node, n, radius, lo, hi) of placed rows."""
    ends: list[Column] = [F.array(*(f(F.col("vec")[i]) for i in range(d))).alias(name) for name, f in (("lo", F.min), ("hi", F.max))]
    return rows.groupBy("node").agg(F.count("*").alias("n"), F.max("far").alias("radius"), *ends)


def maintain(stream: DataFrame, centers: np.ndarray, path: str, checkpoint: str, available_now: bool = True):
    """Keep the statistics of a stream of points (id, vec). Every micro-batch writes the nodes that it changed, with their totals so
    far, to its own folder; a batch that is run again replaces it. State and progress are in the checkpoint."""

    def write(batch: DataFrame, number: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")

    kept = statistics(placed(stream, centers), centers.shape[1])
    out = kept.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def latest(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """(node, n, radius, lo, hi) as the last batch, or batch `upto`, left it: the newest row of each node."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    rows = rows if upto is None else rows.filter(F.col("batch") <= upto)
    return rows.groupBy("node").agg(F.max_by(F.struct("n", "radius", "lo", "hi"), "batch").alias("x")).select("node", "x.*")
