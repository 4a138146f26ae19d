"""Nearest-neighbour joins: many queries against a table, and the table with itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions.vectors import as_matrix, unit_rows
from vecloom.operators import blocks
from vecloom.operators.cells import assign_cells, choose_anchors, visited
from vecloom.operators.copies import Copies, collapse, first_members
from vecloom.operators.descent import graph_by_descent
from vecloom.operators.graph_blocks import block_graph
from vecloom.operators.search import keep_nearest, nearest_in_batch
from vecloom.session import materialise

STRIP_ROWS = 1024
# Greatest Euclidean distance of two unit vectors, with room for rounding.
FARTHEST = 2.001
# The share of the cells that rows of a graph may visit on average. Beyond it blocks cost less.
MOST_VISITED = 0.125


def nearest_kernel(k: int, skip_self: bool):
    """Task function: best k rows of the right block for each row of the left block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        if table.num_rows == 0:
            return
        side = table.column("side").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return
        vectors = as_matrix(table.column("vector"))
        queries = unit_rows(vectors[left])
        # No row farther than what the query has already found can enter its list.
        known = 1.0 - table.column("r").to_numpy()[left] ** 2 / 2.0
        places = pa.array(right)
        keep = k + 1 if skip_self else k
        ids, key = table.column("id"), table.column("key")
        for lo in range(0, len(left), STRIP_ROWS):
            strip = queries[lo : lo + STRIP_ROWS]
            bound = known[lo : lo + STRIP_ROWS]
            found = nearest_in_batch(places, vectors[right], strip, keep, bound)
            q = left[found.column("q").to_numpy() + lo]
            other = found.column("id").to_numpy()
            distance = found.column("distance").to_numpy()
            if skip_self:
                differs = np.asarray(key.take(pa.array(q))) != np.asarray(key.take(pa.array(other)))
                q, other, distance = q[differs], other[differs], distance[differs]
            out = pa.table(
                {"q": pa.array(q), "distance": distance, "id": ids.take(pa.array(other))}
            )
            best = keep_nearest(out, k)
            result = pa.table(
                {
                    "qid": key.take(best.column("q")),
                    "id": best.column("id"),
                    "distance": best.column("distance"),
                }
            )
            yield from result.combine_chunks().to_batches()

    return run


def block_nearest(queries: DataFrame, corpus: DataFrame, k: int, skip_self: bool, block_rows: int):
    """Best k per query and block, for rows placed in cells.

    ``queries`` and ``corpus`` are (cell, key, id, vector, r); rows meet within a cell, and
    a query looks no farther than its reach ``r``.
    """
    counts = (
        queries.select("cell", F.lit(1).alias("q"), F.lit(0).alias("c"))
        .unionAll(corpus.select("cell", F.lit(0), F.lit(1)))
        .groupBy("cell")
        .agg(
            blocks.blocks_needed(F.sum("q"), block_rows).alias("q_blocks"),
            blocks.blocks_needed(F.sum("c"), block_rows).alias("c_blocks"),
        )
        .where("q_blocks > 0 AND c_blocks > 0")
    )
    # One row per cell, and cells are bounded by the anchors.
    sizes = F.broadcast(counts)
    shape = ["cell", "key", "id", "vector", "r", "q_blocks", "c_blocks"]
    q = queries.join(sizes, "cell").select(*shape)
    c = corpus.join(sizes, "cell").select(*shape)
    q_own = blocks.block_of("key", F.col("q_blocks"))
    c_own = blocks.block_of("id", F.col("c_blocks"))
    left = blocks.spread(q, blocks.left_groups(q_own, F.col("c_blocks")))
    right = blocks.spread(c, blocks.right_groups(c_own, F.col("q_blocks")))
    columns = ["cell", "a", "b", "side", "key", "id", "vector", "r"]
    schema = T.StructType(
        [
            T.StructField("qid", queries.schema["key"].dataType),
            T.StructField("id", corpus.schema["id"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    return (
        left.select(*columns)
        .unionByName(right.select(*columns))
        .groupBy("cell", "a", "b")
        .applyInArrow(nearest_kernel(k, skip_self), schema)
    )


def best_k(found: DataFrame, k: int) -> DataFrame:
    ranking = Window.partitionBy("qid").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= k)


def cell_nearest(
    q: DataFrame, c: DataFrame, n: int, k: int, skip_self: bool, block_rows: int
) -> DataFrame:
    """Best k of the ``n`` rows c(key, id, vector) for each q(key, id, vector), exactly. Where
    a table is joined with itself, ids are its keys.

    Two passes over metric cells. The first searches each query's own cell; its k-th
    distance bounds how far the query must look, and the second pass copies it only into
    the cells within that reach. Rows of one table that reach many of the cells meet in pairs
    of blocks instead (see graph_blocks.py). Returns (qid, id, distance, rank).
    """
    anchors = choose_anchors(c, n, block_rows)
    shape = ["cell", "key", "id", "vector", F.lit(FARTHEST).alias("r")]
    if len(anchors) <= 1:
        homes, stock = (assign_cells(t, anchors).select(*shape) for t in (q, c))
        return best_k(block_nearest(homes, stock, k, skip_self, block_rows), k)
    # Both passes use one assignment, so it is written.
    stock = materialise(assign_cells(c, anchors).select(*shape), "cells")
    homes = stock if q is c else materialise(assign_cells(q, anchors).select(*shape), "cells")
    near = materialise(
        best_k(block_nearest(homes, stock, k, skip_self, block_rows), k), "nearest-home"
    )
    reach = near.groupBy("qid").agg(
        F.when(F.count("*") >= k, F.sqrt(2.0 * F.max("distance")))
        .otherwise(F.lit(FARTHEST))
        .alias("r")
    )
    looking = homes.drop("r").join(reach, homes["key"] == reach["qid"], "left").select(
        "key", "id", "vector", F.col("cell").alias("from_cell"),
        F.coalesce("r", F.lit(FARTHEST)).alias("r"),
    )
    if q is c and skip_self:
        reaching = looking.select("vector", F.col("from_cell").alias("cell"), "r")
        if visited(reaching, anchors) > MOST_VISITED * n * len(anchors):
            return best_k(block_graph(looking, n, anchors.shape[1], k), k)
    visiting = assign_cells(looking, anchors, radius_col="r", home_col="from_cell")
    visiting = visiting.where(~F.col("home"))
    far = block_nearest(visiting, stock, k, skip_self, block_rows)
    return best_k(near.select("qid", "id", "distance").unionByName(far), k)


def heads(copies: Copies, limit: int) -> DataFrame | None:
    """The lowest ``limit`` members of each group of copies: no answer needs more."""
    if copies.members is None:
        return None
    return first_members(copies.members, limit).select("rep_id", "self_distance", "id")


def with_copies(found: DataFrame, lowest: DataFrame | None) -> DataFrame:
    """Replace each neighbour that stands for a group by the group's lowest members."""
    if lowest is None:
        return found.select("qid", "id", "distance")
    members = lowest.select(F.col("rep_id").alias("id"), F.col("id").alias("member"))
    return found.join(members, "id", "left").select(
        "qid", F.coalesce("member", "id").alias("id"), "distance"
    )


def to_all(found: DataFrame, copies: Copies, k: int, skip_self: bool) -> DataFrame:
    """Give every row the neighbours of its representative, itself left out."""
    everyone = copies.reps.select(F.col("key").alias("rep"), F.col("key").alias("qid"))
    if copies.members is not None:
        rest = copies.members.where(F.col("key") != F.col("rep_key"))
        everyone = everyone.unionByName(
            rest.select(F.col("rep_key").alias("rep"), F.col("key").alias("qid"))
        )
    # At most k + 1 entries per representative.
    lists = found.groupBy(F.col("qid").alias("rep")).agg(
        F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("near")
    )
    joined = everyone.join(lists, "rep")
    others = F.filter("near", lambda x: x["id"] != F.col("qid")) if skip_self else F.col("near")
    return joined.select("qid", F.posexplode(F.slice(others, 1, k)).alias("pos", "x")).select(
        "qid", "x.id", "x.distance", (F.col("pos") + 1).alias("rank")
    )


def numbered(df: DataFrame, label: str) -> DataFrame:
    """``df(id, vector)`` without null vectors, with ``row``: a number of its own for each
    row that rises with the id, so rows of equal ids stay apart and ties keep their order.
    Written, since numbers would change on another run."""
    known = df.where(F.col("vector").isNotNull()).repartitionByRange("id")
    rows = known.sortWithinPartitions("id").withColumn("row", F.monotonically_increasing_id())
    return materialise(rows, label)


def nearest_join(
    queries: DataFrame, corpus: DataFrame, k: int, block_rows: int = blocks.BLOCK_ROWS
) -> DataFrame:
    """Exact top-k of ``corpus(id, vector)`` for each row of ``queries(qid, qv)``:
    (qid, id, distance, rank). Equal vectors on either side are compared once; rows that
    repeat an id, on either side, are rows of their own."""
    asking = numbered(queries.select(F.col("qid").alias("id"), F.col("qv").alias("vector")), "asking")
    given = numbered(corpus.select("id", "vector"), "given")
    keyed = [F.col("row").alias("id"), F.col("row").alias("key"), "vector"]
    asked = collapse(asking.select(*keyed), "queries")
    stored = collapse(given.select(*keyed))
    none = F.lit(None).cast("long")
    q = asked.reps.select("key", none.alias("id"), "vector")
    c = stored.reps.select(none.alias("key"), "id", "vector")
    found = cell_nearest(q, c, given.count(), k, False, block_rows)
    found = best_k(with_copies(found, heads(stored, k)), k)
    if asked.members is not None:
        found = to_all(found, asked, k, False)
    qids = asking.select(F.col("row").alias("qid"), F.col("id").alias("asked_id"))
    return with_ids(found.join(qids, "qid").drop("qid").withColumnRenamed("asked_id", "qid"), given)


def with_ids(found: DataFrame, given: DataFrame) -> DataFrame:
    """Row numbers in ``found.id`` replaced by the ids of ``given``."""
    ids = given.select("row", F.col("id").alias("given_id"))
    joined = found.join(ids, found["id"] == ids["row"])
    return joined.select("qid", F.col("given_id").alias("id"), "distance", "rank")


def neighbour_graph(
    df: DataFrame,
    k: int = 15,
    id_col: str = "id",
    vector_col: str = "vector",
    block_rows: int = blocks.BLOCK_ROWS,
    exact: bool = True,
    **descent,
) -> DataFrame:
    """k nearest rows of every row, itself left out: (qid, id, distance, rank).

    The exact graph looks into every cell in reach, which in many dimensions is nearly all
    of them. With ``exact=False`` neighbours are found by descent (see descent.py, whose
    parameters may be given): the work then grows with n, and some neighbours may be missed.

    Rows that repeat an id are rows of their own. Copies are searched once per group: all of
    a group share its list, in which the group's own lowest rows stand at its self-distance.
    """
    given = numbered(df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), "given")
    copies = collapse(given.select(F.col("row").alias("id"), F.col("row").alias("key"), "vector"))
    reps = copies.reps
    written = reps if copies.members is not None else given.withColumnRenamed("row", "key")
    n = written.count()
    if exact:
        found = cell_nearest(reps, reps, n, k, True, block_rows)
    else:
        found = graph_by_descent(written, n, k, **descent)
    if copies.members is not None:
        lowest = heads(copies, k + 1)
        own = lowest.select(
            F.col("rep_id").alias("qid"), "id", F.col("self_distance").alias("distance")
        )
        candidates = best_k(with_copies(found, lowest).unionByName(own), k + 1)
        found = to_all(candidates, copies, k, True)
    qids = given.select(F.col("row").alias("qid"), F.col("id").alias("asked_id"))
    found = found.join(qids, "qid").drop("qid").withColumnRenamed("asked_id", "qid")
    return with_ids(found, given)
