"""Exact partitioning of unit vectors into metric cells.

Every row belongs to the cell of its nearest anchor. Two rows within Euclidean distance
r of one another whose homes differ lie within r of the plane halfway between the two
anchors, so copying a row into each cell whose plane is within r of it brings every
close pair together in some cell (the bisector bound of published metric-space
similarity joins). Anchors are a bounded sample of the table: they steer the balance of
the work and never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions.vectors import as_matrix, screen_margin, unit_rows
from vecloom.operators.blocks import BLOCK_ROWS
from vecloom.session import BROADCAST_BYTES

MAX_ANCHORS = 16_384
# Rows x anchors compared at a time inside a task, and bytes of vectors that it sends on at a time.
PRODUCT_CELLS = 4_000_000
SENT_BYTES = 8 * 1024 * 1024


def choose_anchors(
    df: DataFrame, n: int, block_rows: int = BLOCK_ROWS, vector_col: str = "vector", seed: int = 42
) -> np.ndarray:
    """About one anchor per block of rows, sampled from the table, bounded in bytes.

    Copies in the sample count once, so a hot group of equal rows cannot use up the
    anchors.
    """
    wanted = min(MAX_ANCHORS, -(-n // block_rows))
    if wanted <= 1:
        return np.empty((0, 0), np.float32)
    sample = df.select(vector_col)
    fraction = min(1.0, 1.5 * wanted / n + 10.0 / n)
    if fraction < 1.0:
        sample = sample.sample(fraction=fraction, seed=seed)
    table = sample.limit(2 * wanted + 20).toArrow()
    if table.num_rows == 0:
        return np.empty((0, 0), np.float32)
    anchors = np.unique(unit_rows(as_matrix(table.column(0)), np.float32), axis=0)
    np.random.default_rng(seed).shuffle(anchors)
    affordable = max(1, BROADCAST_BYTES // (4 * max(1, anchors.shape[1])))
    return anchors[: min(wanted, affordable)]


def cell_schema(df: DataFrame) -> T.StructType:
    return T.StructType(
        df.schema.fields
        + [T.StructField("cell", T.IntegerType()), T.StructField("home", T.BooleanType())]
    )


def assign_cells(
    df: DataFrame,
    anchors: np.ndarray,
    radius: float | None = None,
    radius_col: str | None = None,
    later_cells_only: bool = False,
    home_col: str | None = None,
    vector_col: str = "vector",
) -> DataFrame:
    """Add (cell, home): one row for the home cell and one per further cell in reach.

    The reach is a constant ``radius`` or a column; with neither, only homes are given.
    ``later_cells_only`` keeps copies only in cells numbered above the home, enough for
    a symmetric join. ``home_col`` gives homes found before: two anchors can be equally
    near up to rounding, so passes that must agree share one assignment.
    """
    if len(anchors) <= 1:
        return df.withColumn("cell", F.lit(0)).withColumn("home", F.lit(True))
    shipped = df.sparkSession.sparkContext.broadcast(anchors)
    names = df.columns
    place = names.index(vector_col)
    found = reach_kernel(
        place,
        radius,
        names.index(radius_col) if radius_col else None,
        later_cells_only,
        names.index(home_col) if home_col else None,
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = shipped.value
        # A row may go to every cell there is, so its copies leave a bounded number at a time.
        most = max(1, SENT_BYTES // (8 * points.shape[1]))
        for batch in batches:
            for part, home, inside in found(batch, points):
                rows, cells = np.nonzero(inside)
                for lo in range(0, len(rows), most):
                    row, cell = rows[lo : lo + most], cells[lo : lo + most]
                    taken = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [
                            *taken.columns,
                            pa.array(cell.astype(np.int32)),
                            pa.array(cell == home[row]),
                        ],
                        [*names, "cell", "home"],
                    )

    return df.mapInArrow(run, cell_schema(df))


def visited(df: DataFrame, anchors: np.ndarray) -> int:
    """How many rows ``assign_cells`` would give for df(vector, cell, r), whose homes and reach
    are known, without making them."""
    shipped = df.sparkSession.sparkContext.broadcast(anchors)
    found = reach_kernel(0, None, 2, False, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for _, _, inside in found(batch, shipped.value):
                total += np.count_nonzero(inside)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["n"])

    counts = df.select("vector", "cell", "r").mapInArrow(run, "n long")
    return counts.agg(F.sum("n")).first()[0] or 0


def reach_kernel(
    place: int,
    radius: float | None,
    reach: int | None,
    later_cells_only: bool,
    given: int | None,
):
    """Function from a batch to its parts as (part, home, inside[row, cell]), by the places of
    the vector, reach and home columns."""

    def found(batch: pa.RecordBatch, points: np.ndarray):
        step = max(1, PRODUCT_CELLS // len(points))
        lengths = np.einsum("ij,ij->i", points, points)
        slack = 8 * screen_margin(points.shape[1])
        numbers = np.arange(len(points))
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            x = unit_rows(as_matrix(part.column(place)), np.float32)
            # |x - c|^2 without its |x|^2 term, which cancels in every comparison.
            d2 = lengths[None, :] - 2.0 * (x @ points.T)
            home = (
                np.argmin(d2, axis=1)
                if given is None
                else part.column(given).to_numpy(zero_copy_only=False)
            )
            inside = numbers[None, :] == home[:, None]
            if radius is not None or reach is not None:
                r = (
                    part.column(reach).to_numpy(zero_copy_only=False)[:, None]
                    if reach is not None
                    else radius
                )
                own = points[home]
                gap2 = lengths[home][:, None] + lengths[None, :] - 2.0 * (own @ points.T)
                gap = np.sqrt(np.maximum(gap2, 0.0) + slack)
                near = d2 - d2[np.arange(len(x)), home][:, None] <= 2.0 * r * gap + slack
                if later_cells_only:
                    near &= numbers[None, :] > home[:, None]
                inside |= near
            yield part, home, inside

    return found
