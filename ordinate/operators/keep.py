"""Tables kept between steps: in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a written file, about.
FILE_ROWS = 262_144


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only a local master, whose tasks share one disk, may go without it."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or f"{tempfile.gettempdir()}/checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """df by a checkpoint, so that lost executors lose no intermediate."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a Parquet table at path, or at a new place in the shared folder, read again."""
    path = path or f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def clustered(df: DataFrame, by: str, then: str, rows: int, path: str | None = None) -> DataFrame:
    """`written`, in the order of `by`: its files and row groups have few values of it each, so that a filter on it skips the
    others; a value of many rows fills several files."""
    parts = max(1, -(-rows // FILE_ROWS))
    return written(df.repartitionByRange(parts, by, then).sortWithinPartitions(by, then), path)


def parted(df: DataFrame, by: list[str], rows: int, file_rows: int = FILE_ROWS, path: str | None = None) -> DataFrame:
    """df with `part`, its range in the order of `by`, of some file_rows rows each, stored in a folder a part: a list of parts is
    then all that is read."""
    if not rows:
        return written(df.withColumn("part", F.lit(0)), path)
    path = path or f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    ranged = df.repartitionByRange(max(1, -(-rows // file_rows)), *by).sortWithinPartitions(*by)
    ranged.withColumn("part", F.spark_partition_id()).write.mode("overwrite").partitionBy("part").parquet(path)
    return df.sparkSession.read.parquet(path)


def file_bytes(df: DataFrame) -> int:
    """Bytes of the files that the rows of a stored table, or of a choice of its folders, come from."""
    spark, total = df.sparkSession, 0
    for row in df.select(F.input_file_name().alias("name")).distinct().collect():
        at = spark._jvm.org.apache.hadoop.fs.Path(row["name"])
        total += at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getLen()
    return total
