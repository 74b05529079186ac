"""Points from files and generators, and sinks for results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinate.functions import vectors as V
from ordinate.operators import sampling


def read_vectors(spark: SparkSession, path: str, id_column: str, vec_column: str) -> DataFrame:
    """(id, vec array<double>) from Parquet."""
    return spark.read.parquet(path).select(F.col(id_column).alias("id"), F.col(vec_column).cast("array<double>").alias("vec"))


def read_columns(spark: SparkSession, path: str, id_column: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).select(F.col(id_column).alias("id"), V.as_vec(*columns).alias("vec"))


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def dataset_info(df: DataFrame) -> DataFrame:
    """(n, dims, unit): rows, length of the vectors, whether all have norm one."""
    return df.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dims"), F.bool_and(F.abs(V.norm(F.col("vec")) - 1) < 1e-3).alias("unit"))


def load(df: DataFrame, n: int | None = None, normalize: bool = False, drop_zero: bool = False, seed: int = 42) -> DataFrame:
    """A prepared set of points: a seeded sample of n, zero vectors dropped, unit length."""
    if drop_zero:
        df = df.filter(V.norm(F.col("vec")) > 1e-12)
    if n is not None:
        df = sampling.sample(df, n, seed=seed)
    return df.withColumn("vec", V.normalize(F.col("vec"), "one")) if normalize else df


def data_dir(spark: SparkSession) -> str:
    """Where prepared sets live: the session's ordinate.data.dir, else a folder in the warehouse."""
    return spark.conf.get("ordinate.data.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/points"


#: Public sets of the nearest-neighbour benchmarks, with their metric; a set of this name has these tables.
CATALOGUE = {name: name.rsplit("-", 1)[1] for name in ("glove-100-angular", "glove-25-angular", "nytimes-256-angular", "fashion-mnist-784-euclidean", "gist-960-euclidean", "sift-128-euclidean")}


def load_dataset(spark: SparkSession, name: str, n: int | None = None, normalize: bool = False, folder: str | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, queries, neighbours) of a set stored as Parquet: {folder}/{name}/train and test (id, vec), neighbors (qid, ids).
    Points and queries are prepared alike; sampled points get the ids 0 .. n-1 in the order of their old ones, and neighbours
    those ids, without the points that are gone. normalize holds for angular sets only."""
    at = f"{folder or data_dir(spark)}/{name}"
    unit = normalize and CATALOGUE.get(name, name.rsplit("-", 1)[-1]) == "angular"
    points = load(spark.read.parquet(f"{at}/train"), n, unit, drop_zero=unit, seed=seed)
    queries = load(spark.read.parquet(f"{at}/test"), None, unit, drop_zero=unit)
    neighbours = spark.read.parquet(f"{at}/neighbors")
    if n is None:
        return points, queries, neighbours
    ids = points.sparkSession.createDataFrame([(r["id"], i) for i, r in enumerate(points.select("id").orderBy("id").collect())], "old long, new long")  # n rows
    return points.join(ids, points["id"] == ids["old"]).select(F.col("new").alias("id"), "vec"), queries, remap_neighbours(neighbours, ids)


def import_hdf5(spark: SparkSession, path: str, name: str, folder: str | None = None, rows: int = 10_000) -> None:
    """Write a set's HDF5 file (train, test, neighbors) as the Parquet tables of load_dataset, by blocks. Needs h5py."""
    import h5py

    at = f"{folder or data_dir(spark)}/{name}"
    with h5py.File(path) as file:
        for table, key, value, kind in (("train", "id", "vec", "array<double>"), ("test", "id", "vec", "array<double>"), ("neighbors", "qid", "ids", "array<long>")):
            for lo in range(0, len(file[table]), rows):
                block = [(lo + i, x.tolist()) for i, x in enumerate(file[table][lo : lo + rows])]
                spark.createDataFrame(block, f"{key} long, {value} {kind}").write.mode("append" if lo else "overwrite").parquet(f"{at}/{table}")


def stored_bytes(spark: SparkSession, path: str) -> int:
    """What a stored table or index takes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def remap_neighbours(neighbours: DataFrame, ids: DataFrame) -> DataFrame:
    """neighbours (qid, ids) with old ids replaced by those of `ids` (old, new); ids that are gone are left out, order stays."""
    flat = neighbours.select("qid", F.posexplode("ids").alias("pos", "old"))
    back = flat.join(ids, "old").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("pos", "new"))).alias("x"))
    return neighbours.select("qid").join(back, "qid", "left").select("qid", F.coalesce(F.transform("x", lambda r: r["new"]), F.array().cast("array<long>")).alias("ids"))


def zipf(spark: SparkSession, n: int, d: int, a: float = 1.5, seed: int = 42) -> DataFrame:
    """n points with d coordinates of a discrete power law: heavy ties, far outliers. By id and seed alone."""

    def coordinate(j: int):
        u = (sampling.hashed(F.col("id"), seed + j) + 0.5) / F.lit(4294967296.0)
        return F.floor(F.pow(u, F.lit(-1 / (a - 1)))).cast("double")

    return spark.range(n).select("id", F.array(*map(coordinate, range(d))).alias("vec"))
