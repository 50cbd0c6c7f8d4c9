"""The grid: extents, cells and histograms of points (id, x, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from densika.functions.geometry import cell_index, linear_cell
from densika.operators.ordered import running_sum


def clean(points: DataFrame, id_col: str = "id", x_col: str = "x", y_col: str = "y") -> DataFrame:
    """id, x, y as numbers; rows with a null or NaN are dropped whole."""
    own = points.select(F.col(id_col).cast("long").alias("id"), F.col(x_col).cast("double").alias("x"), F.col(y_col).cast("double").alias("y"))
    return own.where("id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")


def extent(points: DataFrame, eps: float) -> DataFrame:
    """One row: the bounding box, padded by eps."""
    e = F.lit(float(eps))
    return points.agg(
        (F.min("x") - e).alias("min_x"), (F.max("x") + e).alias("max_x"), (F.min("y") - e).alias("min_y"), (F.max("y") + e).alias("max_y")
    )


def dimensions(points: DataFrame, eps: float) -> DataFrame:
    """One row: the box, and the number of cells along each axis and in all."""
    e = F.lit(float(eps))
    n_x, n_y = (F.ceil((F.col(f"max_{a}") - F.col(f"min_{a}")) / e).cast("long") for a in "xy")
    return extent(points, eps).select("*", n_x.alias("n_x"), n_y.alias("n_y")).withColumn("n_cells", F.col("n_x") * F.col("n_y"))


def with_cells(points: DataFrame, eps: float) -> DataFrame:
    """points with cx, cy and the linear cell of the padded grid; the box is one row, so it is broadcast."""
    d = F.broadcast(dimensions(points, eps).select("min_x", "min_y", "n_x"))
    cx, cy = cell_index(F.col("x"), F.col("min_x"), eps), cell_index(F.col("y"), F.col("min_y"), eps)
    return points.join(d).select(*points.columns, cx.alias("cx"), cy.alias("cy"), linear_cell(cx, cy, F.col("n_x")).alias("cell"))


def cells(points: DataFrame, eps: float) -> DataFrame:
    """Cells that hold points: cx, cy, cell, n."""
    return with_cells(points, eps).groupBy("cx", "cy", "cell").agg(F.count("*").alias("n"))


def cell_members(points: DataFrame, eps: float) -> DataFrame:
    """cx, cy, place, id: the points of each cell in the order of their ids, a row for each."""
    place = F.row_number().over(Window.partitionBy("cx", "cy").orderBy("id"))
    return with_cells(points, eps).select("cx", "cy", place.cast("long").alias("place"), "id")


def x_histogram(points: DataFrame, eps: float) -> DataFrame:
    """bin, n for every bin along x, empty ones too."""
    d = dimensions(points, eps)
    e = F.lit(float(eps))
    counts = points.join(F.broadcast(d.select("min_x"))).groupBy(F.floor((F.col("x") - F.col("min_x")) / e).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    bins = d.where("n_x IS NOT NULL").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_x") - 1)).alias("bin"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def x_cumulative(points: DataFrame, eps: float) -> DataFrame:
    """bin, n, running count and running fraction along x."""
    summed = running_sum(x_histogram(points, eps), "bin", "n", "cum")
    total = F.broadcast(points.agg(F.count("*").alias("total")))
    return summed.join(total).select("bin", "n", "cum", (F.col("cum") / F.col("total")).alias("frac"))
