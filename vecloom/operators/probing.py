"""Approximate search for many queries at once: a join of probes with the index by cell.

Every query is copied to the cells it probes, and meets only their rows. Cells and their
queries are cut into blocks, each pair of blocks is a group of its own, and a group
scores all its rows for all its queries with one product of matrices. Cells that no
query probes are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions.vectors import as_matrix, cosine_distances, fixed_width, unit_rows
from vecloom.operators import blocks
from vecloom.operators.ann import Index, decoded, open_index
from vecloom.operators.neighbours import numbered
from vecloom.operators.search import filtered, keep_nearest
from vecloom.session import materialise

# Queries scored at a time in a group, to bound the product matrix.
STRIP_ROWS = 256
FOUND = ["key", "batch", "row", "id", "near"]


def probes(asking: DataFrame, index: Index, first: int, last: int) -> DataFrame:
    """(key, vector, cell): each query once for its ``first``th to ``last``th nearest cell."""
    shipped = asking.sparkSession.sparkContext.broadcast(index.model)
    rows = asking.select("key", "vector")
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, STRIP_ROWS):
                part = batch.slice(lo, STRIP_ROWS)
                cells = shipped.value.cells_of(unit_rows(as_matrix(part.column(1))), last)[:, first:]
                taken = part.take(pa.array(np.repeat(np.arange(len(cells)), cells.shape[1])))
                cells = pa.array(cells.reshape(-1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*taken.columns, cells], schema.names)

    return rows.mapInArrow(run, schema)


def nearest_of(near: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) places that hold the ``size`` least of each line, with all that tie."""
    if near.shape[1] > size:
        worst = np.partition(near, size - 1, axis=1)[:, size - 1]
        return np.nonzero(near <= worst[:, None])
    return tuple(x.reshape(-1) for x in np.indices(near.shape))


def probe_kernel(shipped, size: int, exact: bool):
    """Task function: the ``size`` rows of a group that look nearest to each of its queries,
    by their codes, or by their vectors with exact distances."""

    def run(table):
        table = table.combine_chunks()
        side = table.column("side").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        rows = table.take(pa.array(right))
        asked = table.take(pa.array(left))
        queries = unit_rows(as_matrix(asked.column("vector")))
        model = shipped.value
        if exact:
            stock = unit_rows(as_matrix(rows.column("vector")))
        else:
            codes = fixed_width(rows.column("codes").combine_chunks(), len(model.books))
            centre = model.centroids[table.column("cell")[0].as_py()]
            stock = decoded(model.books, codes) @ model.turn.T + centre
        parts = []
        for lo in range(0, len(queries), STRIP_ROWS):
            strip = queries[lo : lo + STRIP_ROWS]
            near = 1.0 - strip @ stock.T
            if exact:
                # A little more than asked for, since only the next step is exact.
                q, r = nearest_of(np.round(near, 9), size)
                distance = cosine_distances(strip, q, stock, r)
            else:
                q, r = nearest_of(near, size)
                distance = near[q, r]
            found = {"q": pa.array(q + lo), "distance": distance, "place": pa.array(r)}
            found["id"] = rows.column("id").take(pa.array(r))
            parts.append(keep_nearest(pa.table(found), size))
        best = pa.concat_tables(parts)
        place = best.column("place")
        return pa.table(
            {
                "key": asked.column("key").take(best.column("q")),
                "batch": rows.column("batch").take(place),
                "row": rows.column("row").take(place),
                "id": best.column("id"),
                "near": best.column("distance"),
            }
        )

    return run


def probe_join(
    probed: DataFrame, rows: DataFrame, index: Index, size: int, exact: bool, block_rows: int
) -> DataFrame:
    """The ``size`` best (key, batch, row, id, near) of ``rows`` in the cells of ``probed``."""
    counts = (
        probed.select("cell", F.lit(1).alias("q"), F.lit(0).alias("c"))
        .unionAll(rows.select("cell", F.lit(0), F.lit(1)))
        .groupBy("cell")
        .agg(
            blocks.blocks_needed(F.sum("q"), block_rows).alias("q_blocks"),
            blocks.blocks_needed(F.sum("c"), block_rows).alias("c_blocks"),
        )
        .where("q_blocks > 0 AND c_blocks > 0")
    )
    # One row for each cell, of which the centroids' size is checked.
    sizes = F.broadcast(counts)
    none = {c: F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns}
    q = probed.join(sizes, "cell").select(
        "cell", "key", F.col("vector").cast("array<float>").alias("vector"),
        *[c for name, c in none.items() if name not in ("cell", "vector")], "q_blocks", "c_blocks",
    )
    c = rows.join(sizes, "cell").withColumn("key", F.lit(None).cast("long"))
    if not exact:
        c = c.withColumn("vector", F.lit(None).cast("array<float>"))
    c = c.select(*q.columns)
    own_q = blocks.block_of("key", F.col("q_blocks"))
    own_c = F.pmod(F.xxhash64("batch", "row"), F.col("c_blocks")).cast("int")
    left = blocks.spread(q, blocks.left_groups(own_q, F.col("c_blocks")))
    right = blocks.spread(c, blocks.right_groups(own_c, F.col("q_blocks")))
    kinds = [T.LongType(), *(rows.schema[n].dataType for n in ("batch", "row", "id")), T.DoubleType()]
    schema = T.StructType([T.StructField(n, kind) for n, kind in zip(FOUND, kinds)])
    shipped = probed.sparkSession.sparkContext.broadcast(index.model)
    found = (
        left.unionByName(right)
        .drop("q_blocks", "c_blocks")
        .groupBy("cell", "a", "b")
        .applyInArrow(probe_kernel(shipped, size, exact), schema)
    )
    return best_of(found, "near", size).drop("rank")


def best_of(found: DataFrame, by: str, size: int) -> DataFrame:
    order = Window.partitionBy("key").orderBy(by, "id", "batch", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def exact_distances(pairs: DataFrame) -> DataFrame:
    """(key, batch, row, id, near) of pairs(key, batch, row, id, asked, vector)."""
    names = ["key", "batch", "row", "id", "asked", "vector"]
    kept = pairs.select(*names)
    schema = T.StructType([*kept.schema.fields[:4], T.StructField("near", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (unit_rows(as_matrix(batch.column(i))) for i in (4, 5))
            every = np.arange(batch.num_rows)
            near = cosine_distances(a, every, b, every) if len(every) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(near)], schema.names)

    return kept.mapInArrow(run, schema)


def search_index_batch(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    k: int = 5,
    nprobe: int = 20,
    where: str | None = None,
    refine: int | None = 10,
    qid_col: str = "qid",
    qvec_col: str = "qv",
    id_col: str = "id",
    vector_col: str = "vector",
    block_rows: int = blocks.BLOCK_ROWS,
) -> DataFrame:
    """Approximate top-k of an index for each query: (qid, id, distance, rank).

    A query probes its ``nprobe`` nearest cells. Where fewer than k of their rows pass
    ``where``, it probes on, four times as many cells at a step, until k do or all cells are
    probed: a query gets k rows whenever k match. Codes pick ``refine * k`` rows, which are
    compared exactly; with ``refine=None`` every probed row is. Queries that repeat an id are
    queries of their own; a null vector asks nothing.
    """
    index = open_index(spark, path)
    given = queries.select(F.col(qid_col).alias("id"), F.col(qvec_col).alias("vector"))
    asking = numbered(given, "asking").withColumnRenamed("row", "key")
    exact = refine is None
    size = k if exact else refine * k
    data = F.col(vector_col).alias("vector") if exact else F.col("codes")
    cells = len(index.model.centroids)
    stock = filtered(index.rows, where).select(
        "cell", "batch", "row", F.col(id_col).alias("id"), data
    )
    waiting, first, last, found = asking, 0, min(nprobe, cells), None
    while True:
        probed = materialise(probes(waiting, index, first, last), "probes")
        # At most a number for each cell; the scan reads the folders of these cells only.
        wanted = [r["cell"] for r in probed.select("cell").distinct().collect()]
        rows = stock.where(F.col("cell").isin(wanted))
        part = materialise(probe_join(probed, rows, index, size, exact, block_rows), "probed")
        found = part if found is None else found.unionByName(part)
        if last == cells:
            break
        reached = found.groupBy("key").agg(F.count("*").alias("n"))
        short = waiting.join(reached, "key", "left").where(F.coalesce("n", F.lit(0)) < k)
        waiting = materialise(short.drop("n"), "waiting")
        if waiting.isEmpty():
            break
        first, last = last, min(4 * last, cells)
    if not exact:
        chosen = materialise(best_of(found, "near", size).drop("rank", "near", "id"), "chosen")
        asked = asking.select("key", F.col("vector").alias("asked"))
        vectors = index.rows.select("batch", "row", F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
        found = exact_distances(chosen.join(vectors, ["batch", "row"]).join(asked, "key"))
    names = asking.select("key", F.col("id").alias("qid"))
    best = best_of(found, "near", k).join(names, "key")
    return best.select("qid", "id", F.col("near").alias("distance"), "rank")
