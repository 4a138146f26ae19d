"""Bounded block joins of vectors that share a bucket.

Both the exact joins (buckets are metric cells) and the hashed join (buckets are hash
codes) bring rows of one bucket together. A bucket may hold any share of the table, so
it is cut into blocks of a fixed number of rows and every pair of blocks becomes its own
group: no task ever holds more than two blocks, and a hot bucket spreads over as many
tasks as it has block pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
# The groups a row belongs to.
GROUPS = "array<struct<a:int,b:int,side:int>>"


def block_of(key: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks).cast("int")


def triangle_groups(own: Column, blocks: Column) -> Column:
    """Groups of one row in a self-join of its bucket: its block meets every block once.

    Each entry is (a, b, side) with a <= b; ``side`` is 0 for rows of block a.
    """
    return F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda t: F.struct(
            F.least(own, t).alias("a"),
            F.greatest(own, t).alias("b"),
            F.when(own <= t, 0).otherwise(1).alias("side"),
        ),
    )


def left_groups(own: Column, other_blocks: Column, shift: Column | int = 0) -> Column:
    """Groups of a left row that meets every block of the right side."""
    return F.when(
        other_blocks > 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(other_blocks, F.lit(1)) - 1),
            lambda t: F.struct(
                (own + shift).cast("int").alias("a"), t.alias("b"), F.lit(0).alias("side")
            ),
        ),
    )


def right_groups(own: Column, other_blocks: Column, shift: Column | int = 0) -> Column:
    """Groups of a right row that is met by every block of the left side."""
    return F.when(
        other_blocks > 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(other_blocks, F.lit(1)) - 1),
            lambda t: F.struct(
                (t + shift).cast("int").alias("a"), own.alias("b"), F.lit(1).alias("side")
            ),
        ),
    )


def blocks_needed(rows: Column, block_rows: int) -> Column:
    return F.ceil(rows / F.lit(block_rows)).cast("int")


def spread(df: DataFrame, groups: Column) -> DataFrame:
    """One row per group entry, with the entry's fields as columns."""
    return df.withColumn("g", F.explode(groups)).select(
        *[c for c in df.columns], "g.a", "g.b", "g.side"
    )
