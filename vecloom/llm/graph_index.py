"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

The table is cut into shards of a bounded number of rows by a hash of the id, and a task
builds the graph of its shard. Rows are put in the order of their level, highest first, so
every layer is over a prefix of the rows and its graph is one flat array with a fixed number
of neighbours a row. Rows enter the lowest layer in batches: each batch is searched in the
graph so far, all of its rows in step, and linked both ways under the diversity rule.

The measure is the inner product. One more component makes all vectors of a shard equally
long, so that the neighbours by product are those by distance and the graph is a metric one.

Equal vectors enter the graph once. Each group of copies keeps its k + 1 smallest ids beside
it, which is all that a result of k can show.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vecloom.session import materialise

SHARD_ROWS = 8192
# Queries that one task searches in one shard.
QUERY_ROWS = 4096
# Links of a row in the upper layers, and twice as many in the lowest.
LINKS = 16
EF_BUILD = 96
EF_SEARCH = 128
# Rows that enter a graph, or are searched, in step.
STEP = 256
# Beam entries expanded at once.
WIDTH = 4

INDEX = (
    "dim int, shard int, size int, ids binary, vectors binary, layers array<binary>, "
    "tops array<int>"
)


# -- One shard, in NumPy -------------------------------------------------------------------


def equal_lengths(vectors: np.ndarray) -> np.ndarray:
    """Vectors with one more component that makes them equally long."""
    v = vectors.astype(np.float64)
    squares = np.einsum("ij,ij->i", v, v)
    scale = np.sqrt(squares.max()) or 1.0
    more = np.sqrt(np.maximum(squares.max() - squares, 0.0))
    return np.concatenate((v, more[:, None]), axis=1).astype(np.float32) / np.float32(scale)


def beam(points, links, asked, entry, ef):
    """(ids, products) of the ``ef`` best rows found from ``entry``, best first.

    All rows of ``asked`` walk in step; -1 fills the places of rows that found fewer.
    """
    count = len(asked)
    ids = np.full((count, ef), -1, np.int32)
    near = np.full((count, ef), -np.inf, np.float32)
    fresh = np.zeros((count, ef), bool)
    seen = np.zeros((count, len(links)), bool)
    rows = np.arange(count)
    found = entry
    while len(rows):
        found = np.sort(found, axis=1)
        valid = found >= 0
        valid[:, 1:] &= found[:, 1:] != found[:, :-1]
        valid &= ~seen[rows[:, None], np.maximum(found, 0)]
        r, c = np.nonzero(valid)
        seen[rows[r], found[r, c]] = True
        product = np.einsum("rkd,rd->rk", points[found], asked[rows])
        product[~valid] = -np.inf
        all_near = np.concatenate((near[rows], product), axis=1)
        order = np.argsort(-all_near, axis=1, kind="stable")[:, :ef]
        near[rows] = np.take_along_axis(all_near, order, axis=1)
        ids[rows] = np.take_along_axis(np.concatenate((ids[rows], found), axis=1), order, axis=1)
        fresh[rows] = np.take_along_axis(
            np.concatenate((fresh[rows], valid), axis=1), order, axis=1
        )
        fresh &= near > -np.inf
        rows = rows[fresh[rows].any(axis=1)]
        if not len(rows):
            break
        best = np.argsort(~fresh[rows], axis=1, kind="stable")[:, :WIDTH]
        chosen = np.take_along_axis(fresh[rows], best, axis=1)
        base = np.where(chosen, ids[rows[:, None], best], -1)
        fresh[rows[:, None], best] = False
        found = links[base].reshape(len(rows), -1).copy()
        found[np.repeat(base < 0, links.shape[1], axis=1)] = -1
    ids[near == -np.inf] = -1
    return ids, near


def diverse(points, near, ids, limit):
    """Of candidates (best first) those nearer to their row than to one chosen before; the
    nearest of the others fill what is left of ``limit`` places."""
    out = np.full((len(ids), limit), -1, np.int32)
    for lo in range(0, len(ids), STEP):
        own, product = ids[lo : lo + STEP], near[lo : lo + STEP]
        vectors = points[own]
        between = vectors @ vectors.transpose(0, 2, 1)
        kept = np.zeros(own.shape, bool)
        for j in range(own.shape[1]):
            blocked = (kept & (between[:, j] > product[:, j, None])).any(axis=1)
            kept[:, j] = (own[:, j] >= 0) & ~blocked & (kept.sum(axis=1) < limit)
        order = np.argsort(np.where(kept, 0, np.where(own >= 0, 1, 2)), axis=1, kind="stable")
        picked = np.take_along_axis(own, order, axis=1)[:, :limit]
        out[lo : lo + STEP, : picked.shape[1]] = picked
    return out


def best_of(points, asked, ids, limit):
    """Candidate ids sorted by product, without repeats, at most ``limit``."""
    ids = np.sort(ids, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    product = np.einsum("rkd,rd->rk", points[ids], asked)
    product[ids < 0] = -np.inf
    order = np.argsort(-product, axis=1, kind="stable")[:, :limit]
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(product, order, axis=1)


def link(points, links, new, ids, near):
    """Link rows ``new`` to candidates and back; full rows keep the best under the rule."""
    degree = links.shape[1]
    chosen = diverse(points, near, ids, degree // 2)
    links[new, : chosen.shape[1]] = chosen
    source, at = np.nonzero(chosen >= 0)
    target, source = chosen[source, at], new[source]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    changed, first, counts = np.unique(target, return_index=True, return_counts=True)
    for lo in range(0, len(changed), STEP):
        part = slice(lo, lo + STEP)
        rows, width = changed[part], int(counts[part].max())
        more = np.full((len(rows), width), -1, np.int32)
        inside = np.arange(width)[None, :] < counts[part][:, None]
        places = first[part][:, None] + np.arange(width)[None, :]
        more[inside] = source[places[inside]]
        own = np.concatenate((links[rows], more), axis=1)
        found, product = best_of(points, points[rows], own, own.shape[1])
        links[rows] = diverse(points, product, found, degree)


def layer_sizes(count: int) -> list[int]:
    """Rows of each layer, lowest first: one in LINKS goes a layer up."""
    sizes = [count]
    while sizes[-1] > LINKS:
        sizes.append(-(-sizes[-1] // LINKS))
    return sizes


def build_graph(points: np.ndarray) -> list[np.ndarray]:
    """Links of every layer, lowest first, over prefixes of ``points``."""
    layers: list[np.ndarray] = []
    for level, size in reversed(list(enumerate(layer_sizes(len(points))))):
        links = np.full((size, LINKS * (1 if level else 2)), -1, np.int32)
        done = 0
        while done < size:
            stop = min(size, done + max(1, min(STEP, done or STEP)))
            new = np.arange(done, stop)
            asked = points[done:stop]
            inside = asked @ asked.T
            np.fill_diagonal(inside, -np.inf)
            width = min(EF_BUILD, len(new))
            own = np.argsort(-inside, axis=1, kind="stable")[:, :width] + done
            own[own == new[:, None]] = -1
            found = own.astype(np.int32)
            if done:
                entry = descend(points, layers, asked)
                entry[entry >= done] = 0
                before, _ = beam(points, links[:done], asked, entry, min(EF_BUILD, done))
                found = np.concatenate((found, before), axis=1)
            ids, near = best_of(points, asked, found, EF_BUILD)
            link(points, links, new, ids, near)
            done = stop
        layers.insert(0, links)
    return layers


def descend(points, layers, asked, ef: int = 8) -> np.ndarray:
    """Entry rows for the layer below ``layers`` (lowest first)."""
    entry = np.zeros((len(asked), 1), np.int32)
    for links in reversed(layers):
        entry, _ = beam(points, links, asked, entry, min(ef, len(links)))
    return entry


def search_graph(points, layers, asked, ef: int) -> np.ndarray:
    """Row numbers of the ``ef`` best found for each of ``asked``, best first, -1 filled."""
    out = []
    for lo in range(0, len(asked), STEP):
        some = asked[lo : lo + STEP]
        entry = descend(points, layers[1:], some)
        out.append(beam(points, layers[0], some, entry, min(ef, len(points)))[0])
    return np.concatenate(out)


# -- The table, in Spark -------------------------------------------------------------------


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    bad = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = pa.chunked_array(column).combine_chunks() if isinstance(column, list) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def build_index(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row a shard (see INDEX) from (id long, vector), written to the shared folder.

    Vectors of different dimensions are indexed apart.
    """
    rows = rows.select("id", F.col("vector").cast("array<double>"), F.size("vector").alias("dim"))
    sizes = rows.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    spread = F.pmod(F.xxhash64("id"), F.col("shards")).cast("int")
    dealt = rows.join(F.broadcast(sizes), "dim").withColumn("shard", spread).drop("shards")

    def build(table: pa.Table) -> pa.Table:
        dim, shard = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
        ids = table.column("id").to_numpy()
        vectors = matrix(table.column("vector"), dim)
        # The order of ids mixed by a hash: levels are drawn from it, the same on reruns.
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        order = np.lexsort((ids, mixed ^ (mixed >> np.uint64(29))))
        ids, vectors = ids[order], vectors[order]
        layers = build_graph(equal_lengths(vectors))
        return pa.table(
            {
                "dim": pa.array([dim], pa.int32()),
                "shard": pa.array([shard], pa.int32()),
                "size": pa.array([len(ids)], pa.int32()),
                "ids": [ids.astype("<i8").tobytes()],
                "vectors": [vectors.astype("<f8").tobytes()],
                "layers": [[x.astype("<i4").tobytes() for x in layers]],
                "tops": pa.array([[len(x) for x in layers]], pa.list_(pa.int32())),
            }
        )

    return materialise(dealt.groupBy("dim", "shard").applyInArrow(build, INDEX), "graphs")


def search_index(
    index: DataFrame, queries: DataFrame, k: int, ef: int = EF_SEARCH
) -> DataFrame:
    """(query_id, id, score): the ``k`` best of each shard for (query_id, vector) rows.

    Queries are cut into chunks, and every chunk meets every shard of its dimension once.
    """
    asked = queries.select(
        "query_id", F.col("vector").cast("array<double>"), F.size("vector").alias("dim")
    )
    chunks = max(1, -(-asked.count() // QUERY_ROWS))
    spread = F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int")
    shards = F.broadcast(index.groupBy("dim").agg(F.collect_list("shard").alias("shards")))
    asked = asked.join(shards, "dim").withColumn("chunk", spread)
    asked = asked.withColumn("shard", F.explode("shards")).drop("shards")
    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    graphs = index.select("*", every)

    def search(graph: pa.Table, wanted: pa.Table) -> pa.Table:
        columns = {"query_id": [], "id": [], "score": []}
        if graph.num_rows and wanted.num_rows:
            row = graph.slice(0, 1).to_pylist()[0]
            dim = row["dim"]
            ids = np.frombuffer(row["ids"], "<i8")
            vectors = np.frombuffer(row["vectors"], "<f8").reshape(-1, dim)
            layers = [
                np.frombuffer(x, "<i4").reshape(n, -1) for x, n in zip(row["layers"], row["tops"])
            ]
            names = wanted.column("query_id").to_numpy()
            asked = matrix(wanted.column("vector"), dim)
            points = equal_lengths(vectors)
            longer = np.concatenate((asked, np.zeros((len(asked), 1))), axis=1)
            found = search_graph(points, layers, longer.astype(np.float32), max(ef, k))
            for lo in range(0, len(asked), STEP):
                own = found[lo : lo + STEP]
                exact = np.einsum("qkd,qd->qk", vectors[own], asked[lo : lo + STEP])
                exact[own < 0] = -np.inf
                order = np.lexsort((ids[own], -exact), axis=1)[:, :k]
                own = np.take_along_axis(own, order, axis=1)
                q, c = np.nonzero(own >= 0)
                columns["query_id"].append(names[lo + q])
                columns["id"].append(ids[own[q, c]])
                columns["score"].append(np.take_along_axis(exact, order, axis=1)[q, c])
        kinds = {"query_id": np.int64, "id": np.int64, "score": np.float64}
        return pa.table(
            {
                name: np.concatenate([*parts, np.zeros(0, kinds[name])])
                for name, parts in columns.items()
            }
        )

    return (
        graphs.groupBy("dim", "shard", "chunk")
        .cogroup(asked.groupBy("dim", "shard", "chunk"))
        .applyInArrow(search, "query_id long, id long, score double")
    )


def nearest(
    df: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    ef: int = EF_SEARCH,
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found of every query row.

    Rows with a null id, or a vector that is null, zero or holds null or non-finite
    components, take no part. Rows that repeat an id and a vector count once, and a query
    never meets its own id. Vectors of another dimension than the query's are no
    candidates. Ties go to the smaller id; an empty table gives no rows.
    """
    id_, vector = F.col(id_col), F.col(vector_col)
    rows = df.filter(id_.isNotNull() & usable(vector)).select(
        id_.cast("long").alias("id"), vector.alias("vector"), is_query.alias("asks")
    )
    rows = rows.groupBy("id", "vector").agg(F.max("asks").alias("asks"))
    # Copies: the k + 1 smallest ids of every vector, the first of which stands for it.
    order = Window.partitionBy("vector").orderBy("id")
    copies = rows.select("id", "vector").withColumn("r", F.row_number().over(order))
    copies = copies.filter(F.col("r") <= k + 1)
    first = F.min("id").over(Window.partitionBy("vector"))
    copies = materialise(copies.withColumn("stands", first), "vectors")
    index = build_index(copies.filter("r = 1").select("id", "vector"), shard_rows)
    asked = rows.filter("asks").select(F.col("id").alias("query_id"), "vector")
    found = search_index(index, materialise(asked, "queries"), k + 1, ef)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    found = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
    members = copies.select(F.col("stands").alias("s"), F.col("id").alias("member"))
    spread = found.join(members, F.col("id") == F.col("s")).filter("member <> query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("member"))
    ranked = spread.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("member").alias("id"), "score")
