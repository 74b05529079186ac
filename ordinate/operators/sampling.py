"""Deterministic samples: a portable integer hash of the id orders rows, so a sample is the same on every run and engine."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KTH_CONSTANT, NEIGHBOUR_CONSTANT = 1 / 1024, 1 / 128


def sample_size(d: int, eps: float, delta: float = 0.1, constant: float = KTH_CONSTANT) -> int:
    """Points that an eps-sample of half-spaces in d dimensions takes."""
    return math.ceil(constant / eps**2 * ((d + 1) * math.log(1 / eps) + math.log(1 / delta)))


def hashed(id_column: Column, seed: int = 42) -> Column:
    x = F.pmod(F.pmod(id_column.cast("long"), F.lit(2147483648)) * 2654435761 + F.lit(seed * 40503), F.lit(4294967296))
    return F.pmod(x.bitwiseXOR(F.shiftright(x, 15)) * 1103515245, F.lit(4294967296))


def hashed_sql(id_column: str, seed: int = 42) -> str:
    x = f"((({id_column} % 2147483648) * 2654435761 + {seed * 40503}) % 4294967296)"
    return f"((xor({x}, {x} >> 15) * 1103515245) % 4294967296)"


def sample(df: DataFrame, size: int, id_column: str = "id", seed: int = 42) -> DataFrame:
    """Exactly min(size, n) rows, without replacement: those of the least hashes. A limit on the hash goes first, so that tasks
    together send about twice the sample to the merge, however many they are."""
    h, n = hashed(F.col(id_column), seed), df.count()
    if n > 4 * size:
        near = df.filter(h < F.lit(int(2 * size / n * 4294967296)))
        if near.count() >= size:  # ids whose hashes are uneven take the plain way
            df = near
    return df.orderBy(h, id_column).limit(size)


def layers(df: DataFrame, decay: int, depth: int, id_column: str = "id", seed: int = 42) -> DataFrame:
    """df with `layer`, the highest layer that a row reaches; a layer holds about 1/decay of the one below, and is a part
    of it."""
    share = hashed(F.col(id_column), seed) / F.lit(4294967296.0)
    steps = sum((F.when(share < decay**-k, 1).otherwise(0) for k in range(1, depth + 1)), F.lit(0))
    return df.withColumn("layer", steps)
