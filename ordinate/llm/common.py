"""Shared helpers: sources, row keys, Arrow batch plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id wherever ids are ordered or joined.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 2000, mb: int = 16) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows` rows and about `mb` MB (a longer row stands alone), so that a worker's arrays
    do not follow the session's batch size, which stays as the caller has set it."""
    for batch in batches:
        n = batch.num_rows
        if n:
            step = max(1, min(rows, n * (mb << 20) // max(1, batch.nbytes)))
            for lo in range(0, n, step):
                yield batch.slice(lo, step)


def shards_for(spark: SparkSession, per_partition: int = 4) -> int:
    """Shards follow the shuffle partitions that the cluster sets in proportion to its input."""
    return per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; only a local master, whose tasks share one disk, may go without it."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or f"{tempfile.gettempdir()}/checkpoints")


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder, so lost executors lose no intermediate."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_anew(df: DataFrame) -> DataFrame:
    """`stored`, without what the plan said of its size. A checkpoint keeps its plan's estimate, and that of a join is the product
    of its sides': a table that is joined to itself round after round has one of twice the digits each time, until the driver has
    neither the time nor the memory to reckon it."""
    spark, kept = df.sparkSession, stored(df)
    rows = kept._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False), spark)


def unbounded(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is shuffled and merged. Estimates do not know that an Arrow function makes many
    rows of one, nor how far a file unpacks, and would have the driver build and broadcast such a table."""
    return df.hint("merge")


def id_key(column: Column) -> Column:
    return F.coalesce(column.cast("long"), F.lit(NULL_ID))


def binary_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def joined_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column as one array, and its n + 1 offsets, without a copy per row; null is empty."""
    col = column.cast(pa.large_binary())
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches):
        for batch in pieces(batches):
            out = fn(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)


def packed(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def replaced(df: DataFrame, **columns: Column) -> DataFrame:
    """df with these columns set; a column of that name that came with the input gives way."""
    return df.withColumns(columns)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, read again, and the table's path."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that `written` made and nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sampled(df: DataFrame, rows: int) -> DataFrame:
    """At most `rows` rows, those of the least hashes. A hash limit goes first, so that tasks together send about twice as
    many to the driver, however many tasks there are."""
    n = df.count()
    share = min(1.0, 2 * rows / max(1, n))
    h = F.xxhash64(*df.columns)
    near = df if share == 1.0 else df.filter(h < F.lit(int(-(2**63) + share * 2**64)))
    return near.withColumn("__h", h).orderBy("__h").limit(rows).drop("__h")
