"""Mixing sources to target weights by capped water-filling.

The mix has a size in words. It is dealt to the sources by weight; a source whose share
exceeds what its largest number of epochs gives is clamped there, and the excess is dealt
again to the others by weight, until no share is above its cap. Then every document is
taken as many whole times as fit into its source's epochs, and the remainder is filled by a
seeded order of the documents, so that a source's words meet its target exactly; the last
document of the order is taken in part.

Nothing here depends on a source fitting in one task: the seeded order is cut into slices
by hash, running sums are made of the slices' totals first, and then within slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vecloom.llm.texts import ROW_KEY, with_row_key, word_count
from vecloom.session import materialise

# Weights by place in the order of sources, repeated.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
# Documents in a slice of the seeded order, on average.
SLICE_ROWS = 5_000


def weighed(sources: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Adds ``weight`` by the place of each source by code point, null last.

    Places are counted within range partitions and shifted by the sizes of those before,
    so many sources need no single task either.
    """
    order = F.col("source").asc_nulls_last()
    parts = F.spark_partition_id()
    ranged = materialise(
        sources.repartitionByRange(order).withColumn("part", parts), "sources"
    )
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    numbered = ranged.withColumn("place", place).join(shifts, "part")
    index = ((F.col("place") + F.col("shift")) % len(weights)).cast("int")
    weight = F.array(*[F.lit(w) for w in weights])[index]
    return numbered.withColumn("weight", weight).drop("part", "place", "shift")


def water_fill(sources: DataFrame, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Adds ``target``: each source's words in the mix, from (source_size, weight).

    One aggregation a round; a round clamps every source whose share is above its cap, and
    the last clamps none. The sums are of integers, so rounds agree on reruns.
    """
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first()["t"]
    cap = F.col("source_size") * epochs
    level, weight_left, clamped = share * total, None, 0
    while True:
        # Shares are compared as share * weight > cap * weights, with the weights' sum.
        inside = F.lit(False) if weight_left is None else (
            F.lit(float(level)) * F.col("weight") > cap * F.lit(weight_left)
        )
        now = sources.agg(
            F.coalesce(F.sum(F.when(inside, 0).otherwise(F.col("weight"))), F.lit(0)).alias("w"),
            F.coalesce(F.sum(F.when(inside, cap).otherwise(0)), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(inside, 1).otherwise(0)), F.lit(0)).alias("n"),
        ).first()
        if weight_left is not None and now["n"] == clamped:
            break
        level, weight_left, clamped = share * total - now["full"], now["w"], now["n"]
        if not weight_left:
            return sources.withColumn("target", cap.cast("double"))
    dealt = F.lit(float(level)) * F.col("weight") / F.lit(weight_left)
    return sources.withColumn("target", F.least(dealt, cap.cast("double")))


def order_hash(id_col: str, seed: int) -> Column:
    """Seeded hash of an id, in hexadecimal; rows without an id are told apart by ``unnamed``.

    Rows of no words move no other row, so where they are placed is of no account and they
    are spread evenly."""
    named = F.coalesce(F.col(id_col).cast("string"), F.col("unnamed"), F.lit(""))
    spread = F.when(F.col("size") > 0, named).otherwise(
        F.monotonically_increasing_id().cast("string")
    )
    return F.md5(F.concat(F.lit(f"{seed}:"), spread))


def text_name(text: Column) -> Column:
    """What stands for the id of a document without one: a hash of its text."""
    return F.when(F.col("doc_id").isNull(), F.md5(F.coalesce(text, F.lit(""))))


def mix(
    sized: DataFrame,
    share: float = SHARE,
    epochs: int = EPOCHS,
    weights=WEIGHTS,
    seed: int = 42,
    whole_only: bool = False,
) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``taken`` to rows (doc_id, source, size, unnamed, ...).

    ``taken`` is the number of words the mix takes of a document, repeats counted: at most
    ``epochs`` times its size if ``share`` can be met. With ``whole_only`` the last document
    of each source is taken whole or not at all, whichever is nearer to the target.

    A null source is a source of its own; a source without words has target 0; documents
    without words are taken 0 words. Rows that repeat an id are placed by size and are
    taken as documents of their own. An empty table gives none.
    """
    sized = materialise(sized.withColumn("__hash", order_hash("doc_id", seed)), "sized")
    sources = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("docs")
    )
    plan = materialise(water_fill(weighed(sources, weights), share, epochs), "targets")
    plan = plan.select(
        F.col("source").alias("__source"), "source_size", "target",
        F.ceil(F.col("docs") / SLICE_ROWS).alias("__slices"),
    )
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("__source")))
    high = F.conv(F.substring("__hash", 1, 7), 16, 10).cast("long")
    slice_ = F.floor(high * F.col("__slices") / (1 << 28))
    rows = rows.withColumn("__slice", slice_).drop("__source", "__slices")
    totals = rows.groupBy("source", "__slice").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("__slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = totals.select(
        F.col("source").alias("__source"), F.col("__slice").alias("__at"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__start"),
    )
    rows = rows.join(
        starts,
        F.col("source").eqNullSafe(F.col("__source")) & (F.col("__slice") == F.col("__at")),
    ).drop("__source", "__at")
    inside = Window.partitionBy("source", "__slice").orderBy(
        "__hash", F.col("doc_id").asc_nulls_first(), "size"
    ).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(
        "__before", F.col("__start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    )
    goal = F.round("target").cast("long")
    wholes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0)
    rest = goal - wholes * F.col("source_size") - F.col("__before")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest))
    if whole_only:
        part = F.when(part * 2 >= F.col("size"), F.col("size")).otherwise(0)
    taken = (wholes * F.col("size") + part).cast("long")
    return rows.withColumn("taken", taken).drop(
        "__hash", "__slice", "__start", "__before", "unnamed"
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs``."""
    text = F.col("text")
    sized = docs.select(
        "doc_id", "source", word_count(text).alias("size"), text_name(text).alias("unnamed")
    )
    return mix(sized, **options).select("doc_id", "size", "source_size", "target", "taken")


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``docs``; each row as often as the mix takes it, whole documents only.

    Documents without words are in no mix.
    """
    marked = with_row_key(docs)
    text = F.col("text")
    sized = marked.select(
        "doc_id", "source", *ROW_KEY, word_count(text).alias("size"), text_name(text).alias("unnamed")
    )
    taken = mix(sized, whole_only=True, **options).filter("size > 0 and taken > 0")
    # Full repeats share a row key; their copies are summed and one of them is repeated.
    copies = taken.groupBy(*ROW_KEY).agg(F.sum(F.expr("taken div size")).alias("__copies"))
    joined = marked.join(copies, ROW_KEY).dropDuplicates(ROW_KEY)
    repeats = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))
    return joined.withColumn("__copy", repeats).select(*docs.columns)
