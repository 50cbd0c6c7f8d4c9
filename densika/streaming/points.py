"""Streams of points (Structured Streaming): counts by cell, and labels for points that arrive after a clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from densika.operators.neighbors import range_join

POINT = "id long, x double, y double, ts timestamp"


def read_points(spark: SparkSession, folder: str, files_a_batch: int = 16) -> DataFrame:
    """A stream of the Parquet files that come into a folder."""
    return spark.readStream.schema(POINT).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def cell_counts(stream: DataFrame, side: float, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """window, cx, cy, n: points by cell and time window; points that come later than late after the newest don't count."""
    cells = [F.floor(F.col(a) / F.lit(float(side))).cast("long").alias(f"c{a}") for a in "xy"]
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("window"), *cells).agg(F.count("*").alias("n"))


def label_batch(arrivals: DataFrame, labels: DataFrame, eps: float) -> DataFrame:
    """id, x, y, cluster of each arrival: the smallest cluster that has a core point within eps, or 0. Ids are distinct."""
    core = labels.where("is_core").select("x", "y", "cluster")
    found = range_join(arrivals, core, eps, ["id"], ["cluster"]).groupBy("id").agg(F.min("cluster").alias("cluster"))
    return arrivals.select("id", "x", "y").join(found, "id", "left").select("id", "x", "y", F.coalesce("cluster", F.lit(0)).cast("int").alias("cluster"))


def label_arrivals(stream: DataFrame, labels: DataFrame, eps: float, folder: str, checkpoint: str) -> DataStreamWriter:
    """A query, to be started, that writes label_batch() of each micro-batch to a folder.

    A batch is joined as a table is, so however many core points lie around an arrival, no row holds them. A batch that is
    run again after a failure replaces what it had written.
    """

    def write(batch: DataFrame, number: int) -> None:
        label_batch(batch, labels, eps).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
