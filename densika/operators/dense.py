"""Dense cells: small cells with so many points that all of them are core and neighbours of one another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densika.functions.geometry import DENSE_SIDE
from densika.operators.components import connected_components
from densika.operators.grid import cells

# Fixed value: points a cell, as a share of min_pts, from which dense cells are worth their detection.
WORTH = 0.25


def with_small_cells(points: DataFrame, eps: float) -> DataFrame:
    """points with sx, sy, their cell in the grid of side eps / (2 sqrt 2)."""
    side = F.lit(float(eps) * DENSE_SIDE)
    return points.select("*", F.floor(F.col("x") / side).cast("long").alias("sx"), F.floor(F.col("y") / side).cast("long").alias("sy"))


def dense_cells(points: DataFrame, eps: float, min_pts: int) -> DataFrame:
    """sx, sy, n and the smallest id of each cell with min_pts points or more."""
    found = with_small_cells(points, eps).groupBy("sx", "sy").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    return found.where(F.col("n") >= min_pts)


def adjacency(dense: DataFrame) -> DataFrame:
    """a, b: the smallest ids of dense cells that touch, each pair once; four of the eight directions reach all pairs."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (-1, 1), (0, 1), (1, 1))))
    out = dense.select("least", "sx", "sy", F.explode(steps).alias("s")).select(
        F.col("least").alias("a"), (F.col("sx") + F.col("s.i")).alias("sx"), (F.col("sy") + F.col("s.j")).alias("sy")
    )
    return out.join(dense.select("sx", "sy", F.col("least").alias("b")), ["sx", "sy"]).select("a", "b")


def cell_components(points: DataFrame, eps: float, min_pts: int) -> DataFrame:
    """sx, sy, component: dense cells by their connected component, which is its smallest point id."""
    dense = dense_cells(points, eps, min_pts)
    found = connected_components(adjacency(dense), local_edges=1 << 18)
    return dense.join(found, dense["least"] == found["id"], "left").select("sx", "sy", F.coalesce("component", "least").alias("component"))


def dense_points(points: DataFrame, eps: float, min_pts: int) -> DataFrame:
    """The points of dense cells, with cell and the cell's smallest id."""
    dense = dense_cells(points, eps, min_pts).select("sx", "sy", "least")
    return with_small_cells(points, eps).join(dense, ["sx", "sy"])


def query_points(points: DataFrame, eps: float, min_pts: int) -> DataFrame:
    """The points of no dense cell: those whose neighbours have to be searched."""
    dense = dense_cells(points, eps, min_pts)
    return with_small_cells(points, eps).join(dense, ["sx", "sy"], "left_anti")


def crowding(points: DataFrame, eps: float) -> DataFrame:
    """One row: the mean number of points in a point's own cell, which a few hot cells raise as a mean over cells doesn't."""
    n = F.col("n").cast("double")
    return cells(points, eps).agg((F.sum(n * n) / F.sum(n)).alias("crowding"))


def occupancy(points: DataFrame, eps: float, min_pts: int) -> DataFrame:
    """One row: points, cells with points, points for each of a cell's eight small cells, and whether that is worth dense cells."""
    found = cells(points, eps).agg(F.sum("n").alias("n_points"), F.count("*").alias("n_cells"))
    mean = F.col("n_points") / (F.lit(8.0) * F.col("n_cells"))
    return found.select("n_points", "n_cells", mean.alias("mean_occupancy"), (mean >= F.lit(min_pts * WORTH)).alias("use_dense"))
