"""Exact top-k search, single and batched, with an optional metadata predicate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions.vectors import (
    as_matrix,
    cosine_distances,
    screen_margin,
    unit_rows,
    with_vectors,
)
from vecloom.session import BROADCAST_BYTES, require_columns, take_bounded

# A query set up to this size is shipped to every task; beyond it the block join runs.
MAX_BROADCAST_QUERIES = 4096
# Queries compared at a time inside a task, to bound the product matrix.
QUERY_SLICE = 256


def filtered(df: DataFrame, where: str | None, needs: list[str] | None = None) -> DataFrame:
    """Apply a SQL predicate ahead of any distance, so that it reaches the scan."""
    if needs:
        require_columns(df, needs)
    return df.where(where) if where else df


def keep_nearest(table: pa.Table, k: int) -> pa.Table:
    """Best k rows per query of a (q, distance, id) table, ties by id."""
    order = pc.sort_indices(
        table, [("q", "ascending"), ("distance", "ascending"), ("id", "ascending")]
    )
    table = table.take(order)
    q = table.column("q").to_numpy()
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, int)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return table.filter(pa.array(rank < k))


def nearest_in_batch(ids, rows: np.ndarray, queries: np.ndarray, k: int, bound: np.ndarray):
    """Candidate (q, distance, id) rows of one batch: a superset of its best k per query.

    ``bound`` holds the k-th similarity known so far per query; rows below it by more
    than the float32 error cannot enter the result.
    """
    rows64 = unit_rows(rows)
    rows32 = rows64.astype(np.float32)
    slack = 2 * screen_margin(rows.shape[1])
    parts = []
    for lo in range(0, len(queries), QUERY_SLICE):
        chunk = queries[lo : lo + QUERY_SLICE]
        sims = rows32 @ chunk.astype(np.float32).T
        near = sims >= bound[lo : lo + QUERY_SLICE] - slack
        if len(rows) > k and np.count_nonzero(near) > 4 * k * len(chunk):
            kth = np.partition(sims, len(rows) - k, axis=0)[len(rows) - k]
            near &= sims >= kth - slack
        r, q = np.nonzero(near)
        distance = cosine_distances(rows64, r, chunk, q)
        parts.append(
            pa.table({"q": pa.array(q + lo), "distance": distance, "id": ids.take(pa.array(r))})
        )
    return pa.concat_tables(parts)


def topk_kernel(queries, k: int):
    """Task function: stream vector batches, keep the running best k per query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = queries.value
        best = None
        bound = np.full(len(matrix), -np.inf)
        for batch in batches:
            batch = with_vectors(batch, 1)
            if batch.num_rows == 0:
                continue
            ids = batch.column(0)
            found = nearest_in_batch(ids, as_matrix(batch.column(1)), matrix, k, bound)
            best = keep_nearest(found if best is None else pa.concat_tables([best, found]), k)
            q = best.column("q").to_numpy()
            counts = np.bincount(q, minlength=len(matrix))
            ends = np.cumsum(counts) - 1
            full = counts >= k
            distance = best.column("distance").to_numpy()
            bound[full] = 1.0 - distance[ends[full]]
        if best is not None:
            yield from best.combine_chunks().to_batches()

    return run


def nearest_rows(df: DataFrame, queries: np.ndarray, k: int, id_col: str, vector_col: str):
    """(q, distance, id): at most k rows per query and per input partition."""
    shipped = df.sparkSession.sparkContext.broadcast(unit_rows(np.asarray(queries)))
    source = df.select(id_col, vector_col)
    schema = T.StructType(
        [
            T.StructField("q", T.LongType()),
            T.StructField("distance", T.DoubleType()),
            T.StructField("id", source.schema[id_col].dataType),
        ]
    )
    return source.mapInArrow(topk_kernel(shipped, k), schema)


def search_topk(
    df: DataFrame,
    query,
    k: int = 5,
    where: str | None = None,
    id_col: str = "id",
    vector_col: str = "vector",
) -> DataFrame:
    """The k rows nearest to one query vector: (id, distance, rank), smaller is closer."""
    query = np.asarray(query, dtype=np.float32)
    best = (
        nearest_rows(filtered(df, where), query[None, :], k, id_col, vector_col)
        .select("id", "distance")
        .orderBy("distance", "id")
        .limit(k)
    )
    # At most k rows are left, so a window over one partition is bounded.
    return best.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id")))


def search_batch(
    df: DataFrame,
    queries: DataFrame,
    k: int = 5,
    where: str | None = None,
    qid_col: str = "qid",
    qvec_col: str = "qv",
    id_col: str = "id",
    vector_col: str = "vector",
    max_broadcast_queries: int = MAX_BROADCAST_QUERIES,
) -> DataFrame:
    """Top-k per query row: (qid, id, distance, rank).

    A query set within the size bound goes to every task and the corpus is read once;
    a larger one is joined block by block.
    """
    corpus = filtered(df, where)
    source = queries.select(qid_col, qvec_col)
    table = take_bounded(source, max_broadcast_queries)
    if table is None or 2 * table.nbytes > BROADCAST_BYTES:  # sent in double precision
        from vecloom.operators.neighbours import nearest_join

        return nearest_join(
            source.select(F.col(qid_col).alias("qid"), F.col(qvec_col).alias("qv")),
            corpus.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")),
            k,
        )
    table = table.filter(table.column(1).is_valid())
    if table.num_rows == 0:
        schema = T.StructType(
            [
                T.StructField("qid", source.schema[qid_col].dataType),
                T.StructField("id", corpus.schema[id_col].dataType),
                T.StructField("distance", T.DoubleType()),
                T.StructField("rank", T.IntegerType()),
            ]
        )
        return df.sparkSession.createDataFrame([], schema)
    best = nearest_rows(corpus, as_matrix(table.column(1)), k, id_col, vector_col)
    names = df.sparkSession.createDataFrame(
        pa.table({"q": pa.array(range(table.num_rows)), "qid": table.column(0)})
    )
    ranked = best.withColumn(
        "rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))
    ).where(F.col("rank") <= k)
    # One row per query, at most max_broadcast_queries of them.
    return ranked.join(F.broadcast(names), "q").select("qid", "id", "distance", "rank")


def distinct_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    return df.select(id_col).distinct()


def preview_sample(df: DataFrame, n: int = 8, seed: int = 0) -> DataFrame:
    """n random rows out of the first 8n: a look at the table without a full scan.

    Taking rows to the driver stops at the first partitions that have enough of them; a
    limit inside the plan would start a task for every partition.
    """
    head = df.sparkSession.createDataFrame(df.take(8 * n), df.schema)
    return head.orderBy(F.rand(seed)).limit(n)
