"""K-Means grouping, nearest-centroid assignment and cluster reports."""

from __future__ import annotations

import math
from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions.vectors import as_lists, as_matrix, with_vectors
from vecloom.session import BROADCAST_BYTES, scratch_path

# Starts of which the best is kept.
STARTS = 3
PARALLEL_STARTS = 8
# Rows worth a partition of their own.
PARTITION_ROWS = 5000
PRODUCT_CELLS = 4_000_000
# Rows of a mini-batch and number of them; draws are made in so many lots.
BATCH_ROWS, BATCHES, LOTS = 4096, 24, 1 << 20


def mean_vector(vector_col: str) -> Column:
    """Aggregate: the mean of an array column, summed per task before any shuffle."""
    return vector_to_array(
        Summarizer.mean(array_to_vector(F.col(vector_col).cast("array<double>")))
    )


def assign_nearest(
    df: DataFrame, centroids: np.ndarray, vector_col: str = "vector", normalise: bool = False
) -> DataFrame:
    """Add (cluster, d2): the nearest centroid by squared Euclidean distance, ties to the
    lower number. The centroid table is bounded; its size is checked before shipping."""
    centroids = np.asarray(centroids, np.float64)
    if centroids.nbytes > BROADCAST_BYTES:
        raise ValueError("centroid table is larger than the broadcast bound")
    names = df.columns
    place = names.index(vector_col)
    shipped = df.sparkSession.sparkContext.broadcast(centroids)
    step = max(1, PRODUCT_CELLS // len(centroids))
    schema = T.StructType(
        df.schema.fields
        + [T.StructField("cluster", T.IntegerType()), T.StructField("d2", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = shipped.value
        lengths = np.einsum("ij,ij->i", points, points)
        for batch in batches:
            batch = with_vectors(batch, place)
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                x = as_matrix(part.column(place)).astype(np.float64)
                if normalise:
                    size = np.linalg.norm(x, axis=1, keepdims=True)
                    size[size == 0] = 1.0
                    x = x / size
                best = np.argmin(lengths[None, :] - 2.0 * (x @ points.T), axis=1)
                gap = x - points[best]
                d2 = np.einsum("ij,ij->i", gap, gap)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(best.astype(np.int32)), pa.array(d2)],
                    [*names, "cluster", "d2"],
                )

    return df.mapInArrow(run, schema)


def fit_centroids(
    df: DataFrame,
    k: int,
    seed: int = 42,
    starts: int = STARTS,
    max_iter: int = 20,
    vector_col: str = "vector",
) -> np.ndarray:
    """Centroids of the best of several K-Means starts, each fitted on all rows."""
    n = df.count()  # without the vectors, which a filter on them would read
    rows = df.where(F.col(vector_col).isNotNull()).select(
        array_to_vector(F.col(vector_col).cast("array<double>")).alias("features")
    )
    if not 1 <= k <= n:
        raise ValueError(f"n_clusters must be between 1 and the {n} rows, got {k}")
    if k == 1:
        # Spark's K-Means needs two clusters; a single one is the mean.
        return np.array([rows.agg(vector_to_array(Summarizer.mean(F.col("features")))).first()[0]])
    # A table in few files is spread over the cores, since every iteration reads it again;
    # a large one is left as its files are. What is kept here is only a cache: lost parts are
    # read again.
    cores = df.sparkSession.sparkContext.defaultParallelism
    if n < cores * PARTITION_ROWS:
        rows = rows.repartition(max(1, n // PARTITION_ROWS))
    rows = rows.persist()

    def fit(start: int):
        model = KMeans(k=k, seed=seed + start, maxIter=max_iter).fit(rows)
        return model.summary.trainingCost, start, np.stack(model.clusterCenters())

    try:
        # Starts are independent jobs; side by side they fill each other's gaps.
        with ThreadPool(min(starts, PARALLEL_STARTS)) as pool:
            runs = pool.map(inheritable_thread_target(df.sparkSession)(fit), range(starts))
            return min(runs, key=lambda run: run[:2])[2]
    finally:
        rows.unpersist()


def seeded_centres(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Rows drawn one after another with chances by squared distance to those drawn: of some
    draws the one that leaves the least distances."""
    draw = np.random.default_rng(seed)
    centres = [x[draw.integers(len(x))]]
    gap = ((x - centres[0]) ** 2).sum(axis=1)
    tries = 2 + int(math.log(k))
    for _ in range(1, k):
        total = gap.sum()
        # Where all rows lie on centres, any row will do.
        lots = draw.random(tries)
        at = np.searchsorted(np.cumsum(gap), lots * total) if total > 0 else lots * len(x)
        drawn = x[np.minimum(at.astype(int), len(x) - 1)]
        left = [np.minimum(gap, ((x - c) ** 2).sum(axis=1)) for c in drawn]
        best = int(np.argmin([g.sum() for g in left]))
        centres.append(drawn[best])
        gap = left[best]
    return np.stack(centres)


def fit_minibatch(
    df: DataFrame,
    k: int,
    seed: int = 42,
    starts: int = STARTS,
    batch_rows: int = BATCH_ROWS,
    batches: int = BATCHES,
    vector_col: str = "vector",
) -> np.ndarray:
    """Centroids of K-Means by mini-batches: the table is read once, not once a round.

    Rows are drawn by a hash into ``batches`` batches of about ``batch_rows`` rows, which are
    written in one pass; a small table serves again in further batches. The first batch seeds
    each of the ``starts``. Then every batch moves the centres by its means, each at a rate of
    its rows in the batch over its rows so far, so early batches move a centre far and later ones
    settle it. The start with the least cost over a last batch, which moved nothing, is kept.
    """
    known = df.where(F.col(vector_col).isNotNull()).select(
        F.col(vector_col).cast("array<double>").alias("vector")
    )
    n = known.count()
    if not 1 <= k <= n:
        raise ValueError(f"n_clusters must be between 1 and the {n} rows, got {k}")
    rows_of = max(batch_rows, 10 * k)
    chance = min(1.0, rows_of / n)
    # A lot for each row and batch: a small table is drawn into many of them.
    lots = F.transform(
        F.sequence(F.lit(0), F.lit(batches)),
        lambda b: F.when(F.pmod(F.xxhash64("lot", b), F.lit(LOTS)) < math.ceil(chance * LOTS), b),
    )
    drawn = known.withColumn("lot", F.rand(seed))
    numbers = F.filter(lots, lambda b: b.isNotNull())
    path = scratch_path(df.sparkSession, "batches")
    placed = drawn.select("vector", F.explode(numbers).alias("batch"))
    placed.write.partitionBy("batch").parquet(path)
    stored = df.sparkSession.read.parquet(path)

    def batch(number: int) -> DataFrame:
        return stored.where(F.col("batch") == number).select("vector")

    # A bounded number of rows: the seeds are drawn from them on the driver.
    first = as_matrix(batch(0).limit(2 * rows_of).toArrow().column("vector"))
    if len(first) < k:
        first = as_matrix(known.limit(max(k, 2 * rows_of)).toArrow().column("vector"))
    first = first[np.lexsort(first.T)]
    centres = np.stack([seeded_centres(first, k, seed + s) for s in range(starts)])
    seen = np.zeros((starts, k))
    for number in range(1, batches + 1):
        counts, means, cost = batch_means(batch(number), centres)
        if number == batches:
            return centres[int(np.argmin(cost))]
        seen += counts
        rate = np.where(counts > 0, counts / np.maximum(seen, 1), 0.0)
        centres = centres + rate[:, :, None] * (means - centres)


def batch_means(rows: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each start, rows and mean of every centre [start, k], and the cost [start]."""
    if centres.nbytes > BROADCAST_BYTES:
        raise ValueError("centroid table is larger than the broadcast bound")
    shipped = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = shipped.value
        counts, sums, cost = np.zeros(points.shape[:2]), np.zeros(points.shape), np.zeros(len(points))
        step = max(1, PRODUCT_CELLS // points.shape[1])
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                x = as_matrix(batch.slice(lo, step).column(0)).astype(np.float64)
                size = np.einsum("ij,ij->i", x, x)
                for s, own in enumerate(points):
                    gap = np.einsum("ij,ij->i", own, own)[None, :] - 2.0 * (x @ own.T)
                    near = gap.argmin(axis=1)
                    cost[s] += float((gap[np.arange(len(x)), near] + size).sum())
                    counts[s] += np.bincount(near, minlength=len(own))
                    np.add.at(sums[s], near, x)
        start, centre = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(start, np.arange(len(points))).astype(np.int32)),
                pa.array(np.append(centre, np.full(len(points), -1)).astype(np.int32)),
                pa.array(np.append(counts[start, centre], cost)),
                as_lists(np.concatenate([sums[start, centre], np.zeros((len(points), points.shape[2]))])),
            ],
            ["start", "centre", "n", "sum"],
        )

    parts = rows.mapInArrow(run, "start int, centre int, n double, sum array<double>")
    total = vector_to_array(Summarizer.sum(array_to_vector("sum"))).alias("sum")
    table = parts.groupBy("start", "centre").agg(F.sum("n").alias("n"), total).toArrow()
    start, centre = table.column("start").to_numpy(), table.column("centre").to_numpy()
    n = table.column("n").to_numpy()
    counts, means, cost = np.zeros(centres.shape[:2]), centres.copy(), np.zeros(len(centres))
    cost[start[centre < 0]] = n[centre < 0]
    own = centre >= 0
    counts[start[own], centre[own]] = n[own]
    sums = as_matrix(table.column("sum"))[own]
    means[start[own], centre[own]] = sums / n[own][:, None]
    return counts, means, cost


def lloyd_rounds(
    df: DataFrame, centroids: np.ndarray, rounds: int, vector_col: str = "vector"
) -> np.ndarray:
    """Given centroids after ``rounds`` of assigning every row and taking the means; a
    centroid without rows stays where it is. Only one mean per cluster reaches the driver."""
    centroids = np.array(centroids, np.float64)
    for _ in range(rounds):
        placed = assign_nearest(df.select(vector_col), centroids, vector_col)
        means = placed.groupBy("cluster").agg(mean_vector(vector_col).alias("mean")).toArrow()
        if means.num_rows:
            centroids[means.column("cluster").to_numpy()] = as_matrix(means.column("mean"))
    return centroids


def cluster_rows(
    df: DataFrame,
    n_clusters: int = 10,
    seed: int = 42,
    starts: int = STARTS,
    minibatch: bool = False,
    **fit,
) -> DataFrame:
    """K-Means on the stored vectors: the table plus (cluster, d2), one label per row. With
    ``minibatch`` the centroids are fitted by batches of rows."""
    fitted = fit_minibatch if minibatch else fit_centroids
    return assign_nearest(df, fitted(df, n_clusters, seed, starts, **fit))


def cluster_stats(assigned: DataFrame, n_clusters: int) -> DataFrame:
    """(n_clusters, n_images, inertia) of an assignment."""
    return assigned.agg(
        F.lit(n_clusters).alias("n_clusters"),
        F.count("*").alias("n_images"),
        F.coalesce(F.sum("d2"), F.lit(0.0)).alias("inertia"),
    )


def cluster_groups(
    assigned: DataFrame, part_rows: int = 10_000, id_col: str = "id", cluster_col: str = "cluster"
) -> DataFrame:
    """Members per cluster as sorted id lists: (cluster, part, n, ids).

    A cluster may hold any share of the table, so its list comes in parts of about
    ``part_rows`` ids, split by a hash of the id; ``n`` is the size of the whole cluster.
    """
    sizes = assigned.groupBy(cluster_col).agg(F.count("*").alias("n"))
    digest = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("long")
    return (
        assigned.join(sizes, cluster_col)
        .withColumn("part", (digest % F.ceil(F.col("n") / part_rows)).cast("int"))
        .groupBy(F.col(cluster_col).alias("cluster"), "part", "n")
        .agg(F.sort_array(F.collect_list(id_col)).alias("ids"))
    )


def cluster_preview(
    assigned: DataFrame, n: int = 3, id_col: str = "id", cluster_col: str = "cluster"
) -> DataFrame:
    """First n members per cluster, with the count of those not shown."""
    sizes = assigned.groupBy(cluster_col).agg(F.count("*").alias("size"))
    first = Window.partitionBy(cluster_col).orderBy(id_col)
    return (
        assigned.select(cluster_col, id_col)
        .withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= n)
        .join(sizes, cluster_col)
        .select(
            F.col(cluster_col).alias("cluster"),
            "rank",
            F.col(id_col).alias("id"),
            "size",
            F.greatest(F.col("size") - n, F.lit(0)).alias("more"),
        )
        .orderBy("cluster", "rank")
    )
