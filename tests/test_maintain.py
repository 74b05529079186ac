"""A stream's statistics against those of a table, after each batch and after a restart."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ordinate.streaming import maintain


def test_stream_equals_batch_build_across_restarts(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 3)) + 5 * rng.integers(0, 3, (240, 1))
    centers = np.array([[0.0] * 3, [5.0] * 3, [10.0] * 3, [99.0] * 3])
    schema = "id long, vec array<double>"
    frame = lambda a, z: spark.createDataFrame([(i, x[i].tolist()) for i in range(a, z)] + [(999, None)], schema)
    plain = lambda df: sorted((r["node"], r["n"], round(r["radius"], 9), r["lo"], r["hi"]) for r in df.collect())
    where = {k: str(tmp_path / k) for k in ("in", "out", "check")}
    batches = 0
    for run, cuts in enumerate([(0, 60, 100), (100, 101, 240)]):  # the second run goes on from the first one's checkpoint
        for a, z in zip(cuts, cuts[1:]):
            frame(a, z).coalesce(1).write.mode("append").parquet(where["in"])
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(where["in"])
        query = maintain.maintain(stream, centers, where["out"], where["check"])
        query.awaitTermination(180)
        assert query.exception() is None
        got = plain(maintain.latest(spark, where["out"]))
        assert got == plain(maintain.statistics(maintain.placed(frame(0, cuts[-1]), centers), 3))
        batches += 2
    assert len(got) == 3 and sum(r[1] for r in got) == 240
    numbers = sorted(r["batch"] for r in spark.read.parquet(where["out"]).select("batch").distinct().collect())
    assert len(numbers) == batches
    for number, z in zip(numbers, (60, 100, 101, 240)):  # and after every batch
        assert plain(maintain.latest(spark, where["out"], number)) == plain(maintain.statistics(maintain.placed(frame(0, z), centers), 3))
    assert spark.read.parquet(where["out"]).filter(F.col("batch") == numbers[2]).count() == 1  # a batch of one point writes one node
