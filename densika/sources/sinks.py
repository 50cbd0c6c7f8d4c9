"""Sinks: labels, a line of figures for each run, samples to plot, and an index of points by cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densika.functions.geometry import PRUNING, cells_of
from densika.operators.ordered import ordinal


def write_labels(labels: DataFrame, path: str, mode: str = "errorifexists") -> None:
    labels.write.mode(mode).parquet(path)


def append_stats(summary: DataFrame, path: str, seconds: float, partitions: int, **settings: object) -> None:
    """Appends one CSV line: seconds, the settings, partitions, the number of labels and the noise fraction with four digits."""
    given = [F.lit(str(v)).alias(k) for k, v in settings.items()]
    noise = F.format_string("%.3e", "noise_fraction").alias("noise_fraction")
    line = summary.select(F.lit(f"{seconds:.4f}").alias("seconds"), *given, F.lit(partitions).alias("partitions"), "n_labels", noise)
    line.coalesce(1).write.mode("append").csv(path)  # of one row


def save_index(points: DataFrame, table: str, radius: float, buckets: int = 64) -> None:
    """Saves id, x, y as a table bucketed by the cell that a range join of that radius uses, so that joins don't shuffle it."""
    celled = points.select("id", "x", "y", *cells_of(radius * PRUNING)).repartition(buckets, "cx", "cy")
    celled.write.mode("errorifexists").format("parquet").bucketBy(buckets, "cx", "cy").sortBy("cx", "cy").saveAsTable(table)
    points.sparkSession.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('radius' = '{float(radius)!r}')")


def load_index(spark: SparkSession, table: str, radius: float) -> DataFrame:
    """id, x, y, cx, cy of a saved index, for neighbors.indexed_counts(); it must have been saved for that radius."""
    saved = spark.sql(f"SHOW TBLPROPERTIES {table} ('radius')").first()["value"]
    if saved != repr(float(radius)):
        raise ValueError(f"the index was saved for a radius of {saved}")
    return spark.table(table)


# The sizes of clusters that are plotted, the stride of their points, and the window (xmin, xmax, ymin, ymax).
LEAST, MOST, EVERY, WINDOW = 100, 1_700_000_000, 10, (0, 360, -25, 25)


def plot_sample(
    labels: DataFrame, least: int = LEAST, most: int = MOST, every: int = EVERY, box: tuple[float, float, float, float] = WINDOW
) -> DataFrame:
    """id, x, y, cluster: every tenth point, by id, of clusters of a suitable size, within a box; no noise."""
    sizes = labels.where("cluster > 0").groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n").between(least, most))
    # A cluster may hold most points, so places are counted by ranges of ids and carried over.
    placed = ordinal(labels.join(sizes.select("cluster"), "cluster"), "id", "place", ("cluster",))
    xmin, xmax, ymin, ymax = box
    inside = F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax)
    return placed.where(((F.col("place") - 1) % every == 0) & inside).select("id", "x", "y", "cluster")


def write_plot_sample(labels: DataFrame, path: str, **how: object) -> None:
    plot_sample(labels, **how).write.mode("errorifexists").option("header", True).csv(path)
