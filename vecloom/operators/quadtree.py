"""A quadtree over places on a map, whose boxes follow the density of the points.

Points are counted on a fine grid, and only the counts of occupied grid cells, a bounded number
of them, reach the driver. Boxes are split, from the whole map down, for as long as they hold
more points than wanted and are larger than a grid cell.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Grid cells of an axis, by the number of axes: at most 65,536, or 32,768, cells in all.
LEVELS = {2: 8, 3: 5}


@dataclass
class Boxes:
    """``of_cell``: the box of each grid cell, in the order of cell numbers. For each box the
    number of its points, and their centre."""

    low: np.ndarray
    width: np.ndarray
    levels: int
    of_cell: np.ndarray
    count: np.ndarray
    centre: np.ndarray

    def cell(self, axes: tuple[str, ...]) -> Column:
        """The number of the grid cell that a point lies in."""
        side = 1 << self.levels
        number = F.lit(0).cast("long")
        for axis, low, width in zip(axes, self.low.tolist(), self.width.tolist()):
            place = F.floor((F.col(axis) - low) / width * side)
            number = number * side + F.greatest(F.lit(0), F.least(place, F.lit(side - 1)))
        return number.cast("int")


def density_boxes(points: DataFrame, axes: tuple[str, ...], most: int) -> Boxes:
    """Boxes of at most ``most`` points each, or of one grid cell."""
    edges = points.agg(
        *[f(a).alias(f"{n}_{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in axes]
    ).first()
    low = np.array([edges[f"lo_{a}"] for a in axes])
    width = np.array([edges[f"hi_{a}"] for a in axes]) - low
    width[width <= 0] = 1.0
    levels = LEVELS[len(axes)]
    side, count = 1 << levels, len(axes)
    grid = Boxes(low, width, levels, np.zeros(0, int), np.zeros(0), np.zeros(0))
    table = points.groupBy(grid.cell(axes).alias("cell")).agg(
        F.count("*").alias("n"), *[F.sum(a).alias(a) for a in axes]
    ).toArrow()
    cells = table.column("cell").to_numpy()
    n = np.zeros(side**count)
    n[cells] = table.column("n").to_numpy()
    sums = np.zeros((side**count, count))
    sums[cells] = np.stack([table.column(a).to_numpy() for a in axes], axis=1)
    of_cell = np.zeros(side**count, np.int64)
    numbers = np.arange(side**count).reshape((side,) * count)
    found: list[np.ndarray] = []
    waiting = [(numbers, levels)]
    while waiting:
        part, level = waiting.pop()
        inside = n[part.reshape(-1)].sum()
        if not inside:
            continue
        if inside <= most or level == 0:
            of_cell[part.reshape(-1)] = len(found)
            found.append(part.reshape(-1))
            continue
        half = part.shape[0] // 2
        for corner in np.ndindex(*(2,) * count):
            at = tuple(slice(c * half, (c + 1) * half) for c in corner)
            waiting.append((part[at], level - 1))
    total = np.array([n[part].sum() for part in found])
    centre = np.array([sums[part].sum(axis=0) for part in found]) / total[:, None]
    return Boxes(low, width, levels, of_cell, total, centre)
