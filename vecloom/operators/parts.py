"""Candidates of an exact near-duplicate join by parts of the vectors.

Unit vectors are turned by a random rotation, so that a difference spreads evenly over all
axes, and cut into parts of a few axes. The squared distance of two vectors is the sum over their
parts, so some part of a pair within the radius is within the radius over the root of the
number of parts. In the few axes of a part metric cells do separate rows, which they do not for whole
vectors: a row lies in the cell of its nearest anchor and visits later cells whose bisector
plane is within the part's radius. Rows that meet compare only this part, and pairs that
pass are candidates; no pair within the radius is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions.vectors import as_binary, as_matrix, fixed_width, unit_rows

# Axes of a part, anchors of a part at most, and rows spread or compared at a time.
WIDTH, ANCHORS, STRIP_ROWS = 8, 256, 512
# Room for rounding: parts are stored in single precision.
SLACK = 1e-6


def rotation(dim: int, seed: int = 42) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]


def part_sizes(dim: int) -> list[int]:
    """Axes of each part: as even as can be."""
    count = max(1, dim // WIDTH)
    return [dim // count + (i < dim % count) for i in range(count)]


def spread_parts(rows: DataFrame, dim: int, radius: float) -> DataFrame:
    """(cell, home, row, part) of rows(row, vector): each row once for its cell in every part, and
    once for each cell that it visits. Cells of all parts are numbered through; ``part`` holds
    the part's axes."""
    # Anchors are a bounded sample.
    wanted = rows.orderBy(F.xxhash64("row"), "row").limit(ANCHORS).select("vector").toArrow()
    turn, sizes = rotation(dim), part_sizes(dim)
    edges = np.cumsum([0, *sizes])
    anchors = np.zeros((1, dim))
    if wanted.num_rows:
        anchors = unit_rows(as_matrix(wanted.column("vector"))) @ turn
    reach = radius / math.sqrt(len(sizes))
    shipped = rows.sparkSession.sparkContext.broadcast((turn, anchors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned, points = shipped.value
        for batch in batches:
            for lo in range(0, batch.num_rows, STRIP_ROWS):
                piece = batch.slice(lo, STRIP_ROWS)
                x = unit_rows(as_matrix(piece.column(1))) @ turned
                for p, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    own, stock = x[:, a:b], points[:, a:b]
                    d2 = (own**2).sum(axis=1)[:, None] + (stock**2).sum(axis=1) - 2 * own @ stock.T
                    home = d2.argmin(axis=1)
                    every = np.arange(len(own))
                    between = np.sqrt(
                        np.maximum(((stock[home][:, None] - stock[None]) ** 2).sum(axis=2), 1e-30)
                    )
                    plane = (d2 - d2[every, home][:, None]) / (2 * between)
                    later = np.arange(len(stock))[None, :] > home[:, None]
                    at, cell = np.nonzero(later & (plane <= reach + SLACK))
                    at, cell = np.append(every, at), np.append(home, cell)
                    part = np.zeros((len(at), max(sizes)), np.float32)
                    part[:, : b - a] = own[at]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array((cell + p * len(stock)).astype(np.int32)),
                            pa.array(np.arange(len(at)) < len(own)),
                            piece.column(0).take(pa.array(at)),
                            as_binary(part),
                        ],
                        ["cell", "home", "row", "part"],
                    )

    return rows.select("row", "vector").mapInArrow(
        run, "cell int, home boolean, row long, part binary"
    )


def part_kernel(dim: int, radius: float):
    """Task function: pairs of rows of two blocks that are near in one part."""
    sizes = part_sizes(dim)
    near = radius**2 / len(sizes) + SLACK
    width = max(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        if table.num_rows == 0:
            return
        side, row = table.column("side").to_numpy(), table.column("row").to_numpy()
        x = fixed_width(table.column("part").combine_chunks(), 4 * width)
        x = np.ascontiguousarray(x).view(np.float32).astype(np.float64)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = table.column("a")[0].as_py() == table.column("b")[0].as_py()
        if same:
            right = left
        other = x[right]
        for lo in range(0, len(left), STRIP_ROWS):
            strip = x[left[lo : lo + STRIP_ROWS]]
            d2 = (strip**2).sum(axis=1)[:, None] + (other**2).sum(axis=1) - 2 * strip @ other.T
            close = d2 <= near
            if same:
                close &= np.arange(len(right))[None, :] > (lo + np.arange(len(strip)))[:, None]
            i, j = np.nonzero(close)
            u, v = row[left[i + lo]], row[right[j]]
            out = pa.table({"row_a": np.minimum(u, v), "row_b": np.maximum(u, v)})
            yield from out.to_batches(max_chunksize=65_536)

    return run
