"""Exact copies, taken out before a join and put back after it.

A group of equal vectors may hold any share of a table. Compared row by row it would cost
the square of its size, so joins run on one representative per group and the members come
back through ordinary equi-joins whose keys are cut into blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.operators.blocks import BLOCK_ROWS, blocks_needed
from vecloom.session import materialise

PRINT = ["print_a", "print_b"]


@dataclass
class Copies:
    """``reps`` are the distinct vectors as (id, key, vector). ``members`` lists every row
    of a group of two or more, its representative included, as (rep_id, rep_key, n,
    self_distance, id, key); it is None where all vectors differ."""

    reps: DataFrame
    members: DataFrame | None


def fingerprint(vector: Column) -> list[Column]:
    """128 bits that stand for a vector when looking for equal ones."""
    return [
        F.xxhash64(F.lit(7), vector).alias(PRINT[0]),
        F.xxhash64(F.lit(11), vector).alias(PRINT[1]),
    ]


def collapse(rows: DataFrame, label: str = "copies") -> Copies:
    """Split (id, key, vector) rows into representatives and members.

    The groups are counted with a map-side combine on narrow rows. Vectors move only if
    the table of repeated groups is too large to broadcast, and then a hot group is a
    skewed key of the large side of an outer join, which adaptive execution splits.
    """
    printed = rows.select("id", "key", "vector", *fingerprint(F.col("vector")))
    groups = materialise(
        printed.groupBy(*PRINT)
        .agg(F.count("*").alias("n"), F.min(F.struct("id", "key")).alias("rep"))
        .where("n > 1"),
        f"{label}-groups",
    )
    if groups.isEmpty():
        return Copies(rows, None)
    joined = printed.join(groups, PRINT, "left")
    chosen = F.col("n").isNull() | (F.struct("id", "key") == F.col("rep"))
    points = F.exists("vector", lambda x: x != 0)
    members = joined.where("n IS NOT NULL").select(
        F.col("rep.id").alias("rep_id"),
        F.col("rep.key").alias("rep_key"),
        "n",
        F.when(points, F.lit(0.0)).otherwise(F.lit(1.0)).alias("self_distance"),
        "id",
        "key",
    )
    # Joins read the representatives several times, and the join above may be a shuffle.
    reps = materialise(joined.where(chosen).select("id", "key", "vector"), f"{label}-reps")
    return Copies(reps, materialise(members, f"{label}-members"))


# Parts that a group of copies is cut into before its first members are ranked.
PARTS = 64


def first_members(members: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` lowest members of every group: those of each part of it first, so no
    task ranks a whole group."""
    group = ["rep_id", "rep_key"]
    cut = members.withColumn("part", F.pmod(F.xxhash64("id", "key"), F.lit(PARTS)))
    for keys in ([*group, "part"], group):
        order = Window.partitionBy(*keys).orderBy("id", "key")
        cut = cut.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    return cut.drop("place", "part").withColumn("n", F.least("n", F.lit(limit)))


def blocked(members: DataFrame, block_rows: int) -> DataFrame:
    blocks = F.greatest(blocks_needed(F.col("n"), block_rows), F.lit(1))
    return members.withColumn("blocks", blocks).withColumn(
        "own", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int")
    )


def pairs_within(members: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """All pairs inside the groups, one bounded block pair at a time."""
    cut = blocked(members.where(F.col("self_distance") < threshold), block_rows)
    group = ["rep_id", "rep_key"]
    left = cut.select(
        *group, "self_distance", F.col("id").alias("id_a"), F.col("key").alias("key_a"),
        F.col("own").alias("a"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("b"),
    )
    right = cut.select(
        *group, F.col("id").alias("id_b"), F.col("key").alias("key_b"),
        F.explode(F.sequence(F.lit(0), "own")).alias("a"), F.col("own").alias("b"),
    )
    once = (F.col("a") < F.col("b")) | (F.struct("id_a", "key_a") < F.struct("id_b", "key_b"))
    return left.join(right, [*group, "a", "b"]).where(once).select(
        "id_a", "key_a", "id_b", "key_b", F.col("self_distance").alias("distance")
    )


def stars(members: DataFrame, threshold: float) -> DataFrame:
    """Every further member of a group, paired with the representative alone."""
    further = F.struct("id", "key") != F.struct("rep_id", "rep_key")
    return members.where(further & (F.col("self_distance") < threshold)).select(
        F.col("rep_id").alias("id_a"), F.col("rep_key").alias("key_a"),
        F.col("id").alias("id_b"), F.col("key").alias("key_b"),
        F.col("self_distance").alias("distance"),
    )


def put_back(pairs: DataFrame, members: DataFrame, side: str, block_rows: int) -> DataFrame:
    """Replace the representative on one side of the pairs by each member of its group.

    A group of many members is cut into blocks and the pair sent to each of them, so no
    join key holds more than a block.
    """
    cut = blocked(members, block_rows)
    sizes = cut.select("rep_id", "rep_key", "blocks").distinct()
    rep = {f"id_{side}": "rep_id", f"key_{side}": "rep_key"}
    keyed = pairs.withColumnsRenamed(rep).join(sizes, ["rep_id", "rep_key"], "left")
    sent = keyed.withColumn(
        "own", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    )
    others = [c for c in pairs.columns if c not in rep]
    return sent.join(
        cut.select("rep_id", "rep_key", "own", "id", "key"), ["rep_id", "rep_key", "own"], "left"
    ).where("blocks IS NULL OR id IS NOT NULL").select(
        F.coalesce("id", "rep_id").alias(f"id_{side}"),
        F.coalesce("key", "rep_key").alias(f"key_{side}"),
        *others,
    )


def expand_pairs(
    pairs: DataFrame,
    members: DataFrame,
    threshold: float,
    limit: int | None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Pairs of representatives to pairs of rows, with those inside the groups.

    Where only the first pairs are wanted, a group needs no more than that many members:
    any further member makes a later pair than each of them.
    """
    if limit is not None:
        members = first_members(members, limit + 1)
    across = put_back(put_back(pairs, members, "a", block_rows), members, "b", block_rows)
    return across.unionByName(pairs_within(members, threshold, block_rows))
