"""The exact neighbour graph by pairs of blocks, for rows that cells do not keep apart.

Where a row's reach touches a large share of the metric cells, its copies in them cost more than
they save. Rows are dealt to few large blocks instead, each pair of blocks is a task, and a pair
of rows is compared once for the lists of both. A row brings the distance of the k-th row that it
has already found, so few pairs pass the screen in single precision; those are settled exactly
where they meet. A task holds two blocks and a bounded number of entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions.vectors import as_matrix, cosine_distances, screen_margin, unit_rows
from vecloom.operators import blocks

# This many blocks, or as many as keep each within the bytes and rows.
MOST_BLOCKS, BLOCK_BYTES, MOST_ROWS = 16, 16 * 1024 * 1024, 1 << 18
# Rows of a tile that is compared at a time.
TILE_LEFT, TILE_RIGHT = 256, 1024
# Entries that wait before lists are cut to their k nearest.
WAITING = 1_000_000
# Distances have twelve decimals, so they are sorted as whole numbers below this one.
DECIMALS, WIDEST = 1e12, 1 << 42


class Lists:
    """The k nearest entries of each of some rows, ties by the other row's place. ``low`` is
    the similarity below which no entry can enter a row's list."""

    def __init__(self, k: int, low: np.ndarray, slack: float):
        self.k, self.slack = k, slack
        self.low = low.astype(np.float32)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = self.settled = 0

    def add(self, row: np.ndarray, other: np.ndarray, distance: np.ndarray) -> None:
        self.parts.append((row, other, distance))
        self.size += len(row)
        if self.size - self.settled > WAITING:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        row, other, distance = (np.concatenate(p) for p in zip(*self.parts))
        number = row * WIDEST + np.rint(distance * DECIMALS).astype(np.int64)
        order = np.argsort(number)
        number = number[order]
        if (number[1:] == number[:-1]).any():
            order = np.lexsort((other, distance, row))
        row, other, distance = row[order], other[order], distance[order]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, int)
        rank = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
        last = rank == self.k - 1
        self.low[row[last]] = np.maximum(
            self.low[row[last]], (1.0 - distance[last] - self.slack).astype(np.float32)
        )
        kept = rank < self.k
        out = row[kept], other[kept], distance[kept]
        self.parts, self.size = [out], len(out[0])
        self.settled = self.size
        return out


def passing(
    sims: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, slack: float
) -> np.ndarray:
    """The places of a tile, flat, that can enter the list of their row or of their column. Where
    very many could, the tile's own k-th similarities tell them apart."""
    close = np.flatnonzero(sims >= np.minimum(low[:, None], high[None, :]))
    if len(close) <= 4 * k * sum(sims.shape):
        return close
    # One more than k, since a row may meet itself.
    for axis, least in ((1, low), (0, high)):
        if sims.shape[axis] > k + 1:
            at = sims.shape[axis] - k - 1
            kth = np.partition(sims, at, axis=axis).take(at, axis=axis)
            np.maximum(least, kth - np.float32(slack), out=least)
    return np.flatnonzero(sims >= np.minimum(low[:, None], high[None, :]))


def graph_kernel(k: int):
    """Task function over the rows (a, b, side, key, vector, r) of two blocks, or of one: for each
    row its k nearest of the other block within its reach, as (qid, id, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        if table.num_rows == 0:
            return
        table = table.take(np.argsort(table.column("key").to_numpy()))
        side, keys = table.column("side").to_numpy(), table.column("key").to_numpy()
        same = table.column("a")[0].as_py() == table.column("b")[0].as_py()
        x = unit_rows(as_matrix(table.column("vector")))
        slack = 2 * screen_margin(x.shape[1])
        low = 1.0 - table.column("r").to_numpy() ** 2 / 2.0 - slack
        del table
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return

        def rows_of(place, other_place, found) -> Iterator[pa.RecordBatch]:
            row, other, distance = found
            for lo in range(0, len(row), 65_536):
                part = slice(lo, lo + 65_536)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[place[row[part]]]),
                        pa.array(keys[other_place[other[part]]]),
                        pa.array(distance[part]),
                    ],
                    ["qid", "id", "distance"],
                )

        a, b = x[left], x[right]
        a32 = a.astype(np.float32)
        b32 = a32 if same else b.astype(np.float32)
        of_right = Lists(k, low[right], slack)
        for lo in range(0, len(a), TILE_LEFT):
            strip = a32[lo : lo + TILE_LEFT]
            of_left = of_right if same else Lists(k, low[left[lo : lo + TILE_LEFT]], slack)
            base = lo if same else 0
            for at in range(lo if same else 0, len(b), TILE_RIGHT):
                sims = strip @ b32[at : at + TILE_RIGHT].T
                own = of_left.low[base : base + len(strip)].copy()
                others = of_right.low[at : at + TILE_RIGHT].copy()
                close = passing(sims, own, others, k, slack)
                i, j = np.divmod(close, sims.shape[1])
                if same:
                    later = j + at > i + lo
                    close, i, j = close[later], i[later], j[later]
                value = sims.reshape(-1)[close]
                distance = cosine_distances(a, i + lo, b, j + at)
                enters = value >= own[i]
                of_left.add(i[enters] + base, j[enters] + at, distance[enters])
                enters = value >= others[j]
                of_right.add(j[enters] + at, i[enters] + lo, distance[enters])
            if not same:
                yield from rows_of(left[lo : lo + TILE_LEFT], right, of_left.cut())
        yield from rows_of(right, left, of_right.cut())

    return run


def block_graph(rows: DataFrame, n: int, dim: int, k: int) -> DataFrame:
    """(qid, id, distance): for each of about ``n`` rows(key long, vector, r) of ``dim`` numbers
    the rows within the distance ``r`` that are the k nearest of some block; the k nearest of
    all are among them."""
    most = max(1, min(MOST_ROWS, BLOCK_BYTES // (4 * max(1, dim))))
    count = F.lit(max(min(MOST_BLOCKS, -(-n // blocks.BLOCK_ROWS)), -(-n // most), 1))
    own = blocks.block_of("key", count)
    sent = blocks.spread(rows.select("key", "vector", "r"), blocks.triangle_groups(own, count))
    key = rows.schema["key"].dataType
    schema = T.StructType(
        [T.StructField("qid", key), T.StructField("id", key), T.StructField("distance", T.DoubleType())]
    )
    return sent.groupBy("a", "b").applyInArrow(graph_kernel(k), schema)
