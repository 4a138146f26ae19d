"""IVF-PQ index: coarse cells, product-quantised codes of residuals, approximate search.

A row belongs to the cell of its nearest centroid. What is coded is the residual, its
difference from the centroid, after a rotation that is fitted together with the code books: each
sub-vector of the rotated residual becomes one byte.

An index is a folder of builds and a log of commits. A build holds centroids, rotation and code
books, and its rows in batches, each a Parquet table partitioned by cell, so probing a few cells is
plain partition pruning. A commit names a build and its batches: a rebuild is a new build that
takes over with one commit, and a search reads the build that it has looked up.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions.vectors import (
    as_binary,
    as_lists,
    as_matrix,
    fixed_width,
    l2_normalize,
    unit_rows,
    with_vectors,
)
from vecloom.operators.clusters import assign_nearest, fit_centroids
from vecloom.operators.search import filtered, search_topk
from vecloom.session import BROADCAST_BYTES, materialise
from vecloom.sources import commits

CODES = 256
# Most rounds of fitting code books, and the gain of a round below which the fit ends.
ROUNDS = 8
TURN_ROUNDS = 12
LEAST_GAIN = 0.005
# Rounds of fitting cells: a probe needs no more than roughly settled ones.
CELL_ROUNDS = 10
# Sub-vectors that agree on this grid are one start: copies that were scaled before they were
# made unit vectors differ by rounding.
START_GRID = 1e-5


def sub_vector_count(dim: int, wanted: int | None = None) -> int:
    """Sub-vectors per vector: the wanted number must divide the dimension; the default
    is the largest divisor not above 96."""
    if wanted is None:
        return max(m for m in range(1, min(96, dim) + 1) if dim % m == 0)
    if dim % wanted:
        raise ValueError(f"num_sub_vectors {wanted} does not divide the dimension {dim}")
    return wanted


def unit_column(vector_col: str):
    return l2_normalize(F.col(vector_col)).cast("array<float>")


def start_centres(unit: DataFrame, m: int, seed: int) -> pa.Table:
    """(sub, centre): for each sub-space the 256 different sub-vectors of least hash, or all
    of them if there are fewer. Copies count once, so they fill no more than one place.

    A task keeps 256 sub-vectors of each sub-space, and so does the whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, mix = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = as_matrix(batch.column(0)).astype(np.float64).reshape(batch.num_rows, m, -1)
            if kept is None:
                width = x.shape[2]
                draw = np.random.default_rng(seed)
                mix = draw.integers(0, 2**63, width, np.uint64) * np.uint64(2) + np.uint64(1)
                kept = [(np.empty(0, np.uint64), np.empty((0, width), np.int64)) for _ in range(m)]
            for s in range(m):
                part = x[np.isfinite(x[:, s]).all(axis=1), s]
                grid = np.rint(part / START_GRID).astype(np.int64)
                keys = np.full(len(grid), seed, np.uint64)
                for column, odd in zip(grid.T, mix):
                    keys = (keys ^ column.view(np.uint64)) * odd
                    keys ^= keys >> np.uint64(29)
                old, rows = kept[s]
                if len(old) == CODES:
                    low = keys < old[-1]
                    keys, grid = keys[low], grid[low]
                keys, place = np.unique(np.append(old, keys), return_index=True)
                kept[s] = keys[:CODES], np.concatenate([rows, grid])[place[:CODES]]
        for s, (keys, rows) in enumerate(kept or []):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(keys), s, np.int32)),
                    pa.array(keys.view(np.int64)),
                    as_lists(rows * START_GRID),
                ],
                ["sub", "key", "centre"],
            )

    # Keys are unsigned in tasks; flipping the top bit keeps their order.
    made = unit.mapInArrow(run, "sub int, key long, centre array<double>").select(
        "sub", F.col("key").bitwiseXOR(F.lit(-(2**63))).alias("key"), "centre"
    )
    place = F.row_number().over(Window.partitionBy("sub").orderBy("key", "centre"))
    starts = made.dropDuplicates(["sub", "key", "centre"]).select(
        "sub", "centre", place.alias("place")
    )
    return starts.filter(F.col("place") <= CODES).orderBy("sub", "place").toArrow()


@dataclass
class Codes:
    """Code books [sub, code, width], the rotation that rows are multiplied by first, and the
    mean squared error of the rows they were fitted on."""

    books: np.ndarray
    turn: np.ndarray
    error: float


def second_moments(rows: DataFrame) -> np.ndarray:
    """The mean product of every two elements of ``rows(v)``: dim x dim numbers a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = 0.0, 0
        for batch in batches:
            if batch.num_rows:
                x = as_matrix(batch.column(0)).astype(np.float64)
                total, count = total + x.T @ x, count + len(x)
        if count:
            lines = pa.array(range(len(total)), pa.int32())
            size = pa.array(np.full(len(total), float(count)))
            yield pa.RecordBatch.from_arrays([lines, size, as_lists(total / count)], ["line", "n", "mean"])

    parts = rows.mapInArrow(run, "line int, n double, mean array<double>")
    means = vector_to_array(Summarizer.mean(array_to_vector("mean"), F.col("n"))).alias("mean")
    return as_matrix(parts.groupBy("line").agg(means).orderBy("line").toArrow().column("mean"))


def balanced_turn(moments: np.ndarray, m: int) -> np.ndarray:
    """A rotation to principal axes, dealt to ``m`` sub-spaces of equal size so that the
    products of their variances come near each other: the widest axis left goes to the
    sub-space with room whose product is least."""
    spread, axes = np.linalg.eigh(moments)
    width = len(spread) // m
    # Logarithms are taken against the smallest spread that counts, so all are positive.
    floor = max(spread[-1] * 1e-6, 1e-300)
    own: list[list[int]] = [[] for _ in range(m)]
    product = np.zeros(m)
    for axis in np.argsort(-spread, kind="stable"):
        room = [s for s in range(m) if len(own[s]) < width]
        least = min(room, key=lambda s: (product[s], s))
        own[least].append(int(axis))
        product[least] += np.log1p(max(spread[axis], 0.0) / floor)
    return axes[:, [axis for sub in own for axis in sub]]


def turned_rows(rows: DataFrame, turn: np.ndarray) -> DataFrame:
    shipped = rows.sparkSession.sparkContext.broadcast(turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = as_matrix(batch.column(0)).astype(np.float64) @ shipped.value
                yield pa.RecordBatch.from_arrays([as_lists(x)], ["v"])

    return rows.mapInArrow(run, "v array<double>")


def fit_codes(
    rows: DataFrame, m: int, seed: int = 42, rounds: int = ROUNDS, rotate: bool = False
) -> Codes:
    """Code books of the vectors ``rows(v)``, fitted on all rows, and a rotation if wanted.

    Centres start at different sub-vectors of least hash. In every round each task adds up its
    rows per (sub, code), so what is shuffled is bounded by the code books, whatever the
    table's size. With ``rotate`` the space is first turned to principal axes that are dealt
    evenly to the sub-spaces, and every second round turns it on: the
    cross products of rows and their codes, dim x dim numbers a task, give the orthogonal
    matrix that brings the rows nearest to their codes. The fit ends when a round gains little.
    """
    turn = balanced_turn(second_moments(rows), m) if rotate else None
    starts = start_centres(rows if turn is None else turned_rows(rows, turn), m, seed)
    sub, place = starts.column("sub").to_numpy(), starts.column("place").to_numpy()
    centres = as_matrix(starts.column("centre"))
    books = np.full((m, CODES, centres.shape[1]), np.inf)
    books[sub, place - 1] = centres
    turn = np.eye(m * centres.shape[1]) if turn is None else turn
    best = Codes(books, turn, np.inf)
    context = rows.sparkSession.sparkContext
    last = np.inf
    for number in range(rounds):
        turning = rotate and number % 2 == 1
        shipped = context.broadcast((books, turn))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, turned = shipped.value
            sums, counts, error, total = np.zeros(now.shape), np.zeros(now.shape[:2]), 0.0, 0
            cross = np.zeros(turned.shape)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = as_matrix(batch.column(0)).astype(np.float64)
                y = (x @ turned).reshape(len(x), m, -1)
                coded = np.empty_like(y)
                for s in range(m):
                    near = nearest_codes(now[s], y[:, s])
                    coded[:, s] = now[s, near]
                    if not turning:
                        order = np.argsort(near, kind="stable")
                        codes, begin = np.unique(near[order], return_index=True)
                        sums[s, codes] += np.add.reduceat(y[order, s], begin)
                        counts[s] += np.bincount(near, minlength=CODES)
                error += float(((y - coded) ** 2).sum())
                total += len(x)
                if turning:
                    cross += x.T @ coded.reshape(len(x), -1)
            if not total:
                return
            # Kind 0 are means of codes, kind 1 lines of the cross products, kind 2 the error.
            sub, code = np.nonzero(counts)
            means = list(sums[sub, code] / counts[sub, code][:, None])
            lines = list(cross) if turning else []
            yield pa.RecordBatch.from_pydict(
                {
                    "kind": pa.array([0] * len(means) + [1] * len(lines) + [2], pa.int32()),
                    "sub": pa.array([*sub, *range(len(lines)), 0], pa.int32()),
                    "code": pa.array([*code, *[0] * len(lines), 0], pa.int32()),
                    "n": pa.array([*counts[sub, code], *[1.0] * len(lines), float(total)]),
                    "mean": pa.array([*means, *lines, [error / total]], pa.list_(pa.float64())),
                }
            )

        parts = rows.mapInArrow(run, "kind int, sub int, code int, n double, mean array<double>")
        means = parts.groupBy("kind", "sub", "code").agg(
            F.sum("n").alias("n"),
            vector_to_array(Summarizer.mean(array_to_vector("mean"), F.col("n"))).alias("mean"),
        )
        table = means.orderBy("kind", "sub", "code").toArrow()
        shipped.unpersist()
        kind = table.column("kind").to_numpy()
        if not len(kind):
            break
        error = table.column("mean")[len(kind) - 1].as_py()[0]
        if error < best.error:
            best = Codes(books, turn, error)
        if error >= last * (1 - LEAST_GAIN) and (turning or not rotate):
            break
        last = error if turning or not rotate else last
        own = table.filter(pa.array(kind == int(turning)))
        moved = as_matrix(own.column("mean"))
        if turning:
            left, _, right = np.linalg.svd(moved * own.column("n").to_numpy()[:, None])
            turn = left @ right
        else:
            books = books.copy()
            books[own.column("sub").to_numpy(), own.column("code").to_numpy()] = moved
    return best


def unit_vectors(df: DataFrame, vector_col: str) -> DataFrame:
    known = df.where(F.col(vector_col).isNotNull())
    return materialise(known.select(unit_column(vector_col).alias("v")), "unit")


def train_codebooks(
    df: DataFrame, m: int, vector_col: str = "vector", seed: int = 42, rounds: int = ROUNDS
) -> DataFrame:
    """(sub, code, centre): up to 256 centres per sub-space of whole unit vectors."""
    return book_table(df.sparkSession, fit_codes(unit_vectors(df, vector_col), m, seed, rounds).books)


def book_table(spark: SparkSession, books: np.ndarray) -> DataFrame:
    sub, code = np.nonzero(np.isfinite(books[:, :, 0]))
    return spark.createDataFrame(
        pa.table(
            {
                "sub": pa.array(sub.astype(np.int32)),
                "code": pa.array(code.astype(np.int32)),
                "centre": as_lists(books[sub, code].astype(np.float32)),
            }
        )
    )


def nearest_codes(centres: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The nearest of the finite ``centres``, which come first, for each row."""
    known = centres[np.isfinite(centres[:, 0])]
    return np.argmin((known**2).sum(axis=1) - 2.0 * (x @ known.T), axis=1)


def codebook_matrix(codebooks: DataFrame) -> np.ndarray:
    """Code books as [m, 256, dim / m]: at most 256 x dim values. Missing codes are never
    nearest, since they sit at infinity."""
    table = codebooks.toArrow()
    sub, code = table.column("sub").to_numpy(), table.column("code").to_numpy()
    centres = as_matrix(table.column("centre"))
    books = np.full((sub.max() + 1, CODES, centres.shape[1]), np.inf, np.float32)
    books[sub, code] = centres
    return books


def coded(books: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One byte for each sub-vector of each row."""
    m, _, width = books.shape
    parts = x.reshape(-1, m, width)
    codes = np.empty((len(parts), m), np.uint8)
    for s in range(m):
        codes[:, s] = nearest_codes(books[s], parts[:, s])
    return codes


def decoded(books: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return books[np.arange(books.shape[0]), codes].reshape(len(codes), -1)


def pq_encode(df: DataFrame, codebooks: np.ndarray, vector_col: str = "vector") -> DataFrame:
    """Add ``codes`` of the whole unit vectors: one byte per sub-vector."""
    names = df.columns
    place = names.index(vector_col)
    shipped = df.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = with_vectors(batch, place)
            unit = unit_rows(as_matrix(batch.column(place)), np.float32)
            codes = as_binary(coded(shipped.value, unit))
            yield pa.RecordBatch.from_arrays([*batch.columns, codes], [*names, "codes"])

    return df.mapInArrow(
        run, T.StructType(df.schema.fields + [T.StructField("codes", T.BinaryType())])
    )


def fit_cells(df: DataFrame, num_partitions: int, vector_col: str = "vector") -> np.ndarray:
    """Coarse centroids on unit vectors, fitted on all rows."""
    unit = df.where(F.col(vector_col).isNotNull()).select(unit_column(vector_col).alias("vector"))
    return fit_centroids(unit, num_partitions, starts=1, max_iter=CELL_ROUNDS)


def ivf_cells(df: DataFrame, centroids: np.ndarray, vector_col: str = "vector") -> DataFrame:
    """Add ``cell``, the nearest coarse centroid of each row."""
    placed = assign_nearest(df, centroids, vector_col, normalise=True)
    return placed.withColumnRenamed("cluster", "cell").drop("d2")


# -- The index -------------------------------------------------------------------------------


@dataclass
class Model:
    """What codes rows: centroids [cell, dim], rotation and code books."""

    centroids: np.ndarray
    turn: np.ndarray
    books: np.ndarray

    def cells_of(self, unit: np.ndarray, count: int = 1) -> np.ndarray:
        """The nearest cells of unit vectors, nearest first, ties to the lower number."""
        c = self.centroids
        gap = np.einsum("ij,ij->i", c, c)[None, :] - 2.0 * (unit @ c.T)
        return np.argsort(gap, axis=1, kind="stable")[:, :count]

    def bounded(self) -> Model:
        if self.centroids.nbytes + self.books.nbytes > BROADCAST_BYTES:
            raise ValueError("centroids and code books are larger than the broadcast bound")
        return self


@dataclass
class Index:
    """One version of an index, as a search reads it."""

    spark: SparkSession
    path: str
    number: int
    content: dict

    @property
    def build(self) -> str:
        return f"{self.path}/build={self.content['build']}"

    @property
    def rows(self) -> DataFrame:
        """The indexed rows with (batch, row), which tell them apart, cell and codes."""
        root = f"{self.build}/rows"
        batches = [f"{root}/batch={b['name']}" for b in self.content["batches"]]
        return self.spark.read.option("basePath", root).parquet(*batches)

    @cached_property
    def model(self) -> Model:
        centroids = self.spark.read.parquet(f"{self.build}/centroids").orderBy("cell").toArrow()
        turn = self.spark.read.parquet(f"{self.build}/rotation").orderBy("line").toArrow()
        return Model(
            as_matrix(centroids.column("centroid")),
            as_matrix(turn.column("values")),
            codebook_matrix(self.spark.read.parquet(f"{self.build}/codebooks")),
        ).bounded()


def open_index(spark: SparkSession, path: str) -> Index:
    found = commits.latest(spark, path)
    if found is None:
        raise FileNotFoundError(f"no index at {path}")
    return Index(spark, path, *found)


def index_exists(spark: SparkSession, path: str) -> bool:
    return commits.last_number(spark, path) is not None


def numbered_rows(values: np.ndarray, number: str, name: str) -> pa.Table:
    numbers = pa.array(range(len(values)), pa.int32())
    return pa.table({number: numbers, name: as_lists(values.astype(np.float64))})


def residuals(df: DataFrame, centroids: np.ndarray, vector_col: str) -> DataFrame:
    """(v): the difference of each unit vector from its cell's centroid."""
    shipped = df.sparkSession.sparkContext.broadcast(Model(centroids, None, np.zeros(0)).bounded())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = with_vectors(batch, 0)
            unit = unit_rows(as_matrix(batch.column(0)))
            if len(unit):
                cells = shipped.value.cells_of(unit)[:, 0]
                gap = (unit - shipped.value.centroids[cells]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([as_lists(gap)], ["v"])

    return materialise(df.select(vector_col).mapInArrow(run, "v array<float>"), "residuals")


def create_index(
    df: DataFrame,
    path: str,
    num_partitions: int = 256,
    num_sub_vectors: int | None = None,
    vector_col: str = "vector",
    rounds: int = TURN_ROUNDS,
) -> None:
    """Build the index of a table and make it the one that searches read. Until it is whole,
    and if the build is cut off, they read the build before."""
    spark = df.sparkSession
    rows = df.where(F.col(vector_col).isNotNull())
    head = rows.select(F.size(vector_col)).first()
    if head is None:
        raise ValueError("cannot index an empty table")
    m = sub_vector_count(head[0], num_sub_vectors)
    centroids = fit_cells(rows, min(num_partitions, rows.count()), vector_col)
    codes = fit_codes(residuals(rows, centroids, vector_col), m, rounds=rounds, rotate=True)
    content = {"build": uuid.uuid4().hex, "error": codes.error, "batches": []}
    index = Index(spark, path, -1, content)
    for name, table in (
        ("centroids", numbered_rows(centroids, "cell", "centroid")),
        ("rotation", numbered_rows(codes.turn, "line", "values")),
    ):
        spark.createDataFrame(table).write.parquet(f"{index.build}/{name}")
    book_table(spark, codes.books).write.parquet(f"{index.build}/codebooks")
    content["batches"].append(write_rows(index, rows, vector_col))
    while True:
        number = commits.last_number(spark, path)
        if commits.publish(spark, path, 0 if number is None else number + 1, content):
            return


def encode_rows(df: DataFrame, model: Model, vector_col: str = "vector") -> DataFrame:
    """Add (codes, code_error, cell) to the rows that have a vector; ``code_error`` is the squared
    distance of the unit vector from what its cell and codes stand for."""
    names = df.columns
    place = names.index(vector_col)
    shipped = df.sparkSession.sparkContext.broadcast(model)
    made = T.StructType.fromDDL("codes binary, code_error double, cell int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            batch = with_vectors(batch, place)
            unit = unit_rows(as_matrix(batch.column(place))).reshape(batch.num_rows, -1)
            if not len(unit):
                continue
            cells = own.cells_of(unit)[:, 0]
            turned = (unit - own.centroids[cells]) @ own.turn
            codes = coded(own.books, turned)
            error = ((turned - decoded(own.books, codes)) ** 2).sum(axis=1)
            more = [as_binary(codes), pa.array(error), pa.array(cells.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, *made.names])

    return df.mapInArrow(run, T.StructType(df.schema.fields + made.fields))


def write_rows(index: Index, rows: DataFrame, vector_col: str) -> dict:
    """Write rows with cells and codes as a batch of the index. The rebalance hint cuts a hot
    cell over several tasks and files."""
    name, seen = f"b{uuid.uuid4().hex}", Observation()
    placed = encode_rows(rows, index.model, vector_col)
    placed = placed.withColumn("row", F.monotonically_increasing_id()).observe(
        seen, F.count("*").alias("rows"), F.avg("code_error").alias("error")
    )
    target = f"{index.build}/rows/batch={name}"
    placed = placed.drop("code_error").hint("rebalance", "cell")
    placed.write.partitionBy("cell").parquet(target)
    return {"name": name, "rows": seen.get["rows"], "error": seen.get["error"]}


def update_index(
    df: DataFrame, path: str, key_col: str = "row_key", vector_col: str = "vector"
) -> None:
    """Add the rows of a table that its index lacks, by a key that is unique for each row.
    Cells and code books stay as they are, so only new rows are encoded; ``index_report`` tells
    when they no longer fit. If another writer is first, what it has added is left out."""
    spark = df.sparkSession
    while True:
        index = open_index(spark, path)
        known = index.rows.select(key_col)
        rows = df.where(F.col(vector_col).isNotNull()).join(known, key_col, "left_anti")
        rows = materialise(rows.select(*df.columns), "appended")
        if rows.isEmpty():
            return
        batch = write_rows(index, rows, vector_col)
        content = index.content | {"batches": [*index.content["batches"], batch]}
        if commits.publish(spark, path, index.number + 1, content):
            return


def index_report(spark: SparkSession, path: str) -> DataFrame:
    """(batch, rows, error, fitted_error) of the batches of an index: the mean squared error of
    their codes, and that of the rows the code books were fitted on. Once batches of many rows
    have a much larger error, the index is worth building anew."""
    content = open_index(spark, path).content
    rows = [(i, b["rows"], b["error"], content["error"]) for i, b in enumerate(content["batches"])]
    return spark.createDataFrame(rows, "batch int, rows long, error double, fitted_error double")


def nearest_cells(index: Index, query: np.ndarray, nprobe: int) -> list[int]:
    unit = unit_rows(np.asarray(query, np.float64)[None, :])
    return index.model.cells_of(unit, nprobe)[0].tolist()


def shortlist(
    rows: DataFrame, model: Model, query: np.ndarray, size: int, id_col: str
) -> DataFrame:
    """(batch, row) of the ``size`` rows that look nearest by cell and codes alone.

    Only ids, cells and codes are read; the inner product is a sum of table look-ups.
    """
    m, _, width = model.books.shape
    unit = unit_rows(np.asarray(query, np.float64)[None, :])[0]
    finite = np.where(np.isfinite(model.books), model.books, 0.0)
    lookup = np.einsum("scw,sw->sc", finite, (unit @ model.turn).reshape(m, width))
    shipped = rows.sparkSession.sparkContext.broadcast((lookup, model.centroids @ unit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, centres = shipped.value
        for batch in batches:
            codes = fixed_width(batch.column(4), m)
            known = scores[np.arange(m)[None, :], codes].sum(axis=1)
            near = 1.0 - known - centres[batch.column(3).to_numpy()]
            # More than ``size`` rows of one batch can never be needed.
            best = pa.array(np.argsort(near, kind="stable")[:size])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(best) for i in range(3)), pa.array(near).take(best)],
                ["batch", "row", "id", "near"],
            )

    kinds = {c: rows.schema[c].dataType for c in ("batch", "row")}
    kinds |= {"id": rows.schema[id_col].dataType, "near": T.DoubleType()}
    schema = T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])
    found = rows.select("batch", "row", id_col, "cell", "codes").mapInArrow(run, schema)
    return found.orderBy("near", "id").limit(size).select("batch", "row")


def search_index(
    spark: SparkSession,
    path: str,
    query,
    k: int = 5,
    nprobe: int = 20,
    where: str | None = None,
    refine: int | None = 10,
    id_col: str = "id",
    vector_col: str = "vector",
) -> DataFrame:
    """Approximate top-k: (id, distance, rank), distances exact for the rows given.

    Only the ``nprobe`` cells nearest the query are read, or as many more as it takes for k rows
    that pass ``where``, up to all. Codes pick ``refine * k`` rows, which are then compared
    exactly; with ``refine=None`` every probed row is, and probing all cells equals
    the exact search.
    """
    index = open_index(spark, path)
    cells = nearest_cells(index, query, len(index.model.centroids))
    passing = filtered(index.rows, where)
    # Each step reads the cells it adds, by their counts only, until k rows are in reach.
    taken = min(nprobe, len(cells))
    seen = passing.where(F.col("cell").isin(cells[:taken])).limit(k).count()
    while seen < k and taken < len(cells):
        more = cells[taken : 4 * taken]
        seen += passing.where(F.col("cell").isin(more)).limit(k - seen).count()
        taken = min(4 * taken, len(cells))
    probed = passing.where(F.col("cell").isin(cells[:taken]))
    if refine is not None:
        wanted = shortlist(probed, index.model, query, refine * k, id_col)
        # refine * k pairs of numbers.
        probed = probed.join(F.broadcast(wanted), ["batch", "row"], "left_semi")
    return search_topk(probed, query, k, id_col=id_col, vector_col=vector_col)
