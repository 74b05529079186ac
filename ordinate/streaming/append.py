"""Appending streams of points to a ball table: each micro-batch is assigned to the balls and their radii grow to hold it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinate.functions import vectors as V
from ordinate.operators import balls


def append_points(stream: DataFrame, centers: np.ndarray, members_path: str, balls_path: str, checkpoint: str, available_now: bool = True):
    """Write (id, vec) micro-batches to members_path by ball, and (ball_id, radius, n) of each batch to balls_path. The
    batch number is part of both paths, so a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        members = balls.assign(batch, centers)
        members.write.mode("overwrite").partitionBy("ball_id").parquet(f"{members_path}/batch={number}")
        where = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "ball_id int, center array<double>")
        stored = spark.read.parquet(f"{members_path}/batch={number}")
        table = stored.join(F.broadcast(where), "ball_id").groupBy("ball_id").agg(F.max(V.l2_distance(F.col("vec"), F.col("center"))).alias("radius"), F.count("*").alias("n"))
        table.write.mode("overwrite").parquet(f"{balls_path}/batch={number}")

    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def ball_table(spark, balls_path: str) -> DataFrame:
    """(ball_id, radius, n) over all batches so far."""
    return spark.read.parquet(balls_path).groupBy("ball_id").agg(F.max("radius").alias("radius"), F.sum("n").alias("n"))
