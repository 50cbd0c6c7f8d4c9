"""Column expressions on points: distances, cells, boxes and sort keys. All of them stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a cell of this side times eps has a diagonal of eps / 2: its points, and those of the eight cells around it, are neighbours.
DENSE_SIDE = 1 / (2 * math.sqrt(2))
#: Grids that only prune candidates are a little wider than eps, so rounding puts no neighbour two cells away.
PRUNING = 1 + 1e-9


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Euclidean distance; multiplied out rather than pow(), so other engines round alike."""
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def within(x1: Column, y1: Column, x2: Column, y2: Column, eps: float) -> Column:
    """Whether two points are neighbours: at a distance of eps or less."""
    return distance(x1, y1, x2, y2) <= F.lit(float(eps))


def cell_index(value: Column, origin: Column | float, side: float) -> Column:
    """The index of the cell that a coordinate falls into."""
    return F.floor((value - origin) / F.lit(float(side))).cast("long")


def cells_of(side: float) -> list[Column]:
    """cx, cy of a grid of that side with its origin at 0."""
    return [F.floor(F.col(a) / F.lit(float(side))).cast("long").alias(f"c{a}") for a in "xy"]


def linear_cell(cx: Column, cy: Column, n_x: Column) -> Column:
    """One number for a cell; x runs fastest."""
    return cx + cy * n_x


def box_around(x: Column, y: Column, eps: float) -> list[Column]:
    """xmin, xmax, ymin, ymax of the square of half-width eps around a point."""
    e = F.lit(float(eps))
    return [(x - e).alias("xmin"), (x + e).alias("xmax"), (y - e).alias("ymin"), (y + e).alias("ymax")]


def in_box(x: Column, y: Column, xmin: Column, xmax: Column, ymin: Column, ymax: Column) -> Column:
    return x.between(xmin, xmax) & y.between(ymin, ymax)


def boxes_overlap(a: str, b: str) -> Column:
    """Whether the closed boxes of two aliased tables share a point."""
    return (
        (F.col(f"{a}.xmin") <= F.col(f"{b}.xmax")) & (F.col(f"{b}.xmin") <= F.col(f"{a}.xmax"))
        & (F.col(f"{a}.ymin") <= F.col(f"{b}.ymax")) & (F.col(f"{b}.ymin") <= F.col(f"{a}.ymax"))
    )


def radians(degrees: Column) -> Column:
    return degrees * F.lit(math.pi) / F.lit(180.0)


def degree_bins(x: Column, y: Column) -> tuple[Column, Column]:
    """One-degree bins of longitude and latitude."""
    return F.ceil(x / F.lit(180.0) * F.lit(180.0)).cast("long"), F.ceil(y / F.lit(360.0) * F.lit(360.0)).cast("long")
