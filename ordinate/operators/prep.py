"""From tables to points: fills, casts, scales, encodings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordinate.functions import vectors as V
from ordinate.operators import rank


def split_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, categorical) by the schema."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    return numeric, [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def fill_zero(df: DataFrame) -> DataFrame:
    """Every null is 0; in text columns "0"."""
    numeric, texts = split_columns(df)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in numeric} | {c: F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in texts})


def fill_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    means = df.agg(*(F.avg(c).alias(c) for c in columns)).first()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(means[c])) for c in columns})


def scale(df: DataFrame, columns: Sequence[str], low: float = -1.0, high: float = 1.0) -> DataFrame:
    """Min-max to [low, high]; a constant column becomes low. The extremes (one row) go back as literals."""
    ends = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max)))).first()

    def one(c: str) -> Column:
        lo, hi = ends[f"lo_{c}"], ends[f"hi_{c}"]
        if lo is None or lo == hi:
            return F.when(F.col(c).isNotNull(), F.lit(float(low)))
        return F.lit(float(low)) + (F.col(c).cast("double") - F.lit(float(lo))) * ((high - low) / (float(hi) - float(lo)))

    return df.withColumns({c: one(c) for c in columns})


def encode_ordinal(df: DataFrame, columns: Sequence[str], fitted: DataFrame | None = None) -> DataFrame:
    """Each category as its place in the sorted categories of `fitted` (df itself by default), -1 where it is unknown.
    Distinct values only are ranked, part by part, so a column of many needs no single task."""
    for c in columns:
        known = (fitted if fitted is not None else df).select(F.col(c).alias("__v")).filter("__v IS NOT NULL").distinct()
        codes = rank.ranked(known.withColumn("__one", F.lit(1)), "__v", "__one").select("__v", F.col("before").cast("int").alias("__code"))
        df = df.join(codes, F.col(c) == F.col("__v"), "left").withColumn(c, F.coalesce("__code", F.lit(-1))).drop("__v", "__code")
    return df


def feature_names(df: DataFrame, id_column: str, drop: Sequence[str] = ()) -> list[str]:
    """The columns behind the coordinates of to_points: numeric first, then categorical."""
    numeric, texts = split_columns(df.drop(*drop, id_column))
    return [*numeric, *texts]


def to_points(df: DataFrame, id_column: str, drop: Sequence[str] = ()) -> DataFrame:
    """(id, vec): nulls filled, numeric columns scaled and first, categories encoded after them."""
    data = fill_zero(df.drop(*drop))
    numeric, texts = split_columns(data.drop(id_column))
    out = encode_ordinal(scale(data, numeric), texts)
    return out.select(F.col(id_column).alias("id"), V.as_vec(*numeric, *texts).alias("vec"))


def drop_zero_norm(df: DataFrame, vec: str = "vec", least: float = 1e-12) -> DataFrame:
    return df.filter(V.norm(F.col(vec)) > least)
