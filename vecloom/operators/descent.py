"""Neighbour graphs by descent: a neighbour of a neighbour is likely a neighbour.

Every row keeps a list of the nearest rows met so far. Lists start from blocks of rows that
lie on the same sides of random planes. In a round each row brings a bounded sample of its
neighbours, and of the rows that have it as a neighbour, together; the pairs among them in
which one is new to the list are compared, and better ones enter the lists of both. The
rounds end when few entries change. No table of centres is fitted, no group holds more than
four samples, and a round's work grows with the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.vectors import as_matrix, cosine_distances, unit_rows
from vecloom.operators.clusters import mean_vector
from vecloom.session import materialise

# Rows of a block at the start, within so many bytes, and sets of planes of which each deals all
# rows to blocks. A block costs little, since its vectors are sent once: large ones save rounds.
START_ROWS, START_BYTES, SETS = 8192, 16 * 1024 * 1024, 2
# Rows of a block that are compared with it at a time.
STRIP_ROWS = 256
# Entries of a list at least, of which so many new ones, and old ones, are brought together.
LIST, SAMPLE = 20, 10
# The share of entries that may still be new when the rounds end, and the most rounds.
LEAST_CHANGE, MOST_ROUNDS = 0.005, 16
FAR = 3.0


def best_entries(found: DataFrame, size: int) -> DataFrame:
    order = Window.partitionBy("u").orderBy("near", "v")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def prepared(found: DataFrame, size: int, turn: int) -> DataFrame:
    """The lists (u, v, near, rank, fresh) of found(u, v, near, fresh), for the round ``turn``:
    with ``place`` as in ``sampled``, and ``worst``, the distance below which a row enters the
    list. All of it by ``u``, by which rows are dealt once."""
    best = best_entries(found, size)
    own = Window.partitionBy("u")
    full = F.count("*").over(own) >= size
    return sampled(best, "u", "v", turn).withColumn(
        "worst", F.when(full, F.max("near").over(own)).otherwise(F.lit(FAR))
    )


def dealt(
    rows: DataFrame, n: int, start_rows: int, turn: int, seed: int, part_rows: int
) -> DataFrame:
    """(u, vector) in the order of a random code of sides, in partitions of ``part_rows`` rows,
    whatever the size of the blocks that a task makes of them."""
    bits = max(0, int(np.ceil(np.log2(max(1, n / start_rows)))))
    if not bits:
        return rows.select(F.col("key").alias("u"), "vector").coalesce(1).sortWithinPartitions("u")
    middle = np.array(rows.agg(mean_vector("vector").alias("m")).first()["m"])
    planes = np.random.default_rng([seed, turn]).standard_normal((bits, len(middle)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = (as_matrix(batch.column(1)).astype(np.float64) - middle) @ planes.T > 0
            code = (sides @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], ["u", "vector", "code"])

    kind = rows.schema["vector"].dataType.simpleString()
    coded = rows.select(F.col("key").alias("u"), "vector").mapInArrow(
        run, f"u long, vector {kind}, code long"
    )
    # Rows of one code are dealt by a hash, so a code of very many rows has many blocks.
    coded = coded.withColumn("h", F.xxhash64("u", F.lit(turn)))
    parts = max(1, n // max(start_rows, part_rows))
    return coded.repartitionByRange(parts, "code", "h").sortWithinPartitions("code", "h", "u")


def start_kernel(start_rows: int, size: int):
    """Task function: the nearest rows within each block of rows that come one after
    another; the last block of a partition takes the remainder."""

    def block(keys: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        keep = min(size, len(keys) - 1)
        single, v = x.astype(np.float32), np.zeros((len(keys), keep), np.int64)
        for lo in range(0, len(keys) if keep else 0, STRIP_ROWS):
            far = single[lo : lo + STRIP_ROWS] @ -single.T
            every = np.arange(len(far))
            far[every, lo + every] = np.inf
            v[lo : lo + STRIP_ROWS] = np.argpartition(far, keep - 1, axis=1)[:, :keep]
        u, v = np.repeat(np.arange(len(keys)), keep), v.reshape(-1)
        distance = cosine_distances(x, u, x, v)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys[u]), pa.array(keys[v]), pa.array(distance)], ["u", "v", "near"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, x = np.zeros(0, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = unit_rows(as_matrix(batch.column(1)))
            x = own if x is None else np.concatenate([x, own])
            keys = np.append(keys, batch.column(0).to_numpy())
            while len(keys) >= 2 * start_rows:
                yield block(keys[:start_rows], x[:start_rows])
                keys, x = keys[start_rows:], x[start_rows:]
        if len(keys):
            yield block(keys, x)

    return run


def sampled(lists: DataFrame, node: str, other: str, turn: int) -> DataFrame:
    """Entries with ``place``: 1, 2, ... in a random order among the new, or old, ones of a node."""
    order = Window.partitionBy(node, "fresh").orderBy(F.xxhash64("u", "v", F.lit(turn)), other)
    return lists.withColumn("place", F.row_number().over(order))


def join_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function over (u, v, fresh, worst, vector) in the order of u: (u, v, near) of the
    pairs that come together at each u and could enter a list."""
    left = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if left is None else pa.concat_tables([left, table])
        node = table.column("u").to_numpy()
        # The last node's rows may go on in the next batch.
        cut = int(np.searchsorted(node, node[-1])) if len(node) else 0
        left = table.slice(cut)
        if cut:
            yield met(table.slice(0, cut))
    if left is not None and left.num_rows:
        yield met(left)


def met(table: pa.Table) -> pa.RecordBatch:
    table = table.combine_chunks()
    node, keys, worst = (table.column(c).to_numpy() for c in ("u", "v", "worst"))
    fresh = table.column("fresh").to_numpy(zero_copy_only=False)
    x = unit_rows(as_matrix(table.column("vector")))
    edges = np.flatnonzero(np.r_[True, node[1:] != node[:-1], True])
    pairs = []
    for lo, hi in zip(edges[:-1], edges[1:]):
        near = 1.0 - x[lo:hi] @ x[lo:hi].T
        own = worst[lo:hi]
        useful = (near < np.maximum(own[:, None], own[None, :])) & (
            fresh[lo:hi, None] | fresh[None, lo:hi]
        )
        i, j = np.nonzero(np.triu(useful, 1))
        pairs.append((i + lo, j + lo))
    i, j = (np.concatenate(p) for p in zip(*pairs))
    near = cosine_distances(x, i, x, j)
    u, v = np.append(i, j), np.append(j, i)
    near = np.append(near, near)
    enters = near < worst[u]
    u, v, near = keys[u[enters]], keys[v[enters]], near[enters]
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(near)], ["u", "v", "near"])


def graph_by_descent(
    rows: DataFrame,
    n: int,
    k: int,
    start_rows: int | None = None,
    sets: int = SETS,
    sample: int = SAMPLE,
    most_rounds: int = MOST_ROUNDS,
    seed: int = 42,
) -> DataFrame:
    """(qid, id, distance, rank): k near rows of each of the ``n`` rows(key long, vector), most of
    them its nearest. Keys are unique. Each round is written."""
    size = max(k, LIST)
    head = rows.select(F.size("vector")).first()
    part_rows = max(2, min(START_ROWS, START_BYTES // (4 * max(1, head[0] if head else 1))))
    if start_rows is None:
        start_rows = part_rows
    starts = [
        dealt(rows, n, start_rows, turn, seed, part_rows).mapInArrow(
            start_kernel(start_rows, size), "u long, v long, near double"
        )
        for turn in range(sets if n > 2 * start_rows else 1)
    ]
    found = starts[0]
    for more in starts[1:]:
        found = found.unionByName(more)
    found = found.repartition("u").distinct().withColumn("fresh", F.lit(True))
    lists = materialise(prepared(found, size, 0), "descent")
    # One block that holds all rows has compared all pairs.
    for turn in range(most_rounds if n > 2 * start_rows else 0):
        lists = materialise(descended(lists, rows, size, sample, turn), "descent")
        if lists.where("fresh").count() <= LEAST_CHANGE * n * size:
            break
    return lists.where(F.col("rank") <= k).select(
        F.col("u").alias("qid"), F.col("v").alias("id"), F.col("near").alias("distance"), "rank"
    )


def descended(
    lists: DataFrame, rows: DataFrame, size: int, sample: int, turn: int
) -> DataFrame:
    """The lists after one round, prepared for the next."""
    taken = F.col("place") <= sample
    forward = lists.where(taken).select("u", "v", "fresh")
    # A row that very many others have as a neighbour brings a sample of them.
    back = sampled(lists.select("u", "v", "fresh"), "v", "u", turn).where(taken).select(
        F.col("v").alias("u"), F.col("u").alias("v"), "fresh"
    )
    members = forward.unionByName(back).groupBy("u", "v").agg(F.max("fresh").alias("fresh"))
    worst = lists.where("rank = 1").select("u", "worst")
    stock = rows.select(F.col("key").alias("v"), "vector").join(
        worst.withColumnRenamed("u", "v"), "v", "left"
    )
    stock = stock.select("v", "vector", F.coalesce("worst", F.lit(FAR)).alias("worst"))
    together = members.join(stock, "v").select("u", "v", "fresh", "worst", "vector")
    together = together.repartition("u").sortWithinPartitions("u", "v")
    pairs = together.mapInArrow(join_kernel, "u long, v long, near double")
    # An entry of which the other side knows nothing yet is told to it as well.
    told = lists.where("fresh").select(F.col("v").alias("u"), F.col("u").alias("v"), "near")
    new = pairs.unionByName(told).withColumn("fresh", F.lit(True))
    kept = lists.select("u", "v", "near", (F.col("fresh") & ~taken).alias("fresh"))
    merged = kept.withColumn("known", F.lit(True)).unionByName(
        new.withColumn("known", F.lit(False))
    )
    # An entry that was in the list stays as new or old as it was.
    entries = merged.repartition("u").groupBy("u", "v").agg(
        F.min("near").alias("near"),
        F.coalesce(F.max(F.when(F.col("known"), F.col("fresh"))), F.lit(True)).alias("fresh"),
    )
    return prepared(entries, size, turn + 1)
