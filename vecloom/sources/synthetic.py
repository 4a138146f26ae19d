"""Seeded random vectors, one per row of an id table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.functions.vectors import l2_normalize, to_float32


def uniform_vector(id_col: Column, dim: int, seed: int) -> Column:
    """``dim`` values in [0, 1), a function of (seed, id, position) alone.

    Hashing the position keeps rows independent of partitioning, where successive seeds
    of a sequential generator can give shifted copies of one another.
    """
    scale = F.lit(float(16**8))
    prefix = F.concat(F.lit(f"{seed}:"), id_col.cast("string"), F.lit(":"))
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.conv(
            F.substring(F.md5(F.concat(prefix, i.cast("string"))), 1, 8), 16, 10
        ).cast("double")
        / scale,
    )


def synthetic_vectors(ids: DataFrame, dim: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """L2-normalised uniform vectors for the given ids (``spark.range(n)`` for a new table)."""
    raw = uniform_vector(F.col(id_col), dim, seed)
    return ids.select(F.col(id_col).alias("id"), to_float32(l2_normalize(raw)).alias("vector"))
