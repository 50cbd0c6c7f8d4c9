"""Sources of points and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _numbered(rows: DataFrame, out: str) -> DataFrame:
    """rows of a file source, with their places from 0 on in the order of files and lines; they have _file and _block.

    A row's place in its split is counted as it is read; a pass before it counts the rows of each split, and the driver adds
    these up (a row for each split). So nothing is sorted or shuffled, and neither the number nor the order of tasks matters.
    """
    rows = rows.withColumn("_seen", F.monotonically_increasing_id())  # grows by 1 within a task
    splits = rows.groupBy("_file", "_block").agg(F.count("*").alias("n"), F.min("_seen").alias("first")).collect()
    starts, total = [], 0
    for r in sorted(splits):
        starts.append((r["_file"], r["_block"], total - r["first"]))
        total += r["n"]
    start = rows.sparkSession.createDataFrame(starts, "_file string, _block long, _start long")
    return rows.join(F.broadcast(start), ["_file", "_block"]).withColumn(out, F.col("_seen") + F.col("_start"))


def _split() -> list[F.Column]:
    """Which split of which file a row is from."""
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]


def read_csv(spark: SparkSession, path: str, bad_rows: str = "drop", kind: str = "double") -> DataFrame:
    """id, x, y from text with two numbers a line and no header; ids are the good lines' places in the order of files and lines.

    A line that isn't two finite-or-infinite numbers is dropped whole (bad_rows="drop") or fails the read ("fail"): values
    never move from one column or line to another. kind="float" rounds coordinates to single precision.
    """
    if bad_rows not in ("drop", "fail"):
        raise ValueError("bad_rows is drop or fail")
    lines = spark.read.option("mode", "PERMISSIVE").schema("x string, y string, more string").csv(path, enforceSchema=True)
    x, y = (F.expr(f"try_cast(trim({c}) AS double)").alias(c) for c in "xy")
    rows = lines.select(x, y, F.col("more").isNull().alias("two"), *_split())
    good = "x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND two"
    if bad_rows == "fail":
        ok = F.when(F.expr(good), F.lit(True)).otherwise(F.raise_error(F.lit("a line is not two numbers")).cast("boolean"))
        rows = rows.where(ok)
    else:
        rows = rows.where(good)
    return _numbered(rows, "id").select("id", *(F.col(c).cast(kind).cast("double").alias(c) for c in "xy"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """place, cluster: the first comma-separated field of each line as an integer, and the line's place from 0 on."""
    first = F.expr("try_cast(trim(split(value, ',')[0]) AS int)")
    return _numbered(spark.read.text(path).select(first.alias("cluster"), *_split()), "place").select("place", "cluster")


# Fixed value.
SEED = 12347


def uniform(spark: SparkSession, n: int, seed: int = SEED) -> DataFrame:
    """n points with x in [0, 360) and y in [-90, 90)."""
    return spark.range(n).select("id", (F.rand(seed) * 360).alias("x"), (F.rand(seed + 1) * 180 - 90).alias("y"))


def from_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """The first two components of each embedding."""
    e = F.col("embedding")
    return spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("id"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"))


def from_events(spark: SparkSession, folder: str) -> DataFrame:
    """Hours since 2024-01-01 (UTC) and value of each event."""
    ts = F.col("ts").cast("timestamp_ntz")
    hours = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), ts) / F.lit(3.6e9)
    return spark.read.parquet(f"{folder}/events.parquet").select(F.col("event_id").alias("id"), hours.alias("x"), F.col("value").cast("double").alias("y"))


def from_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Account balance and key of each customer."""
    return spark.read.parquet(f"{folder}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("x"), F.col("c_custkey").cast("double").alias("y"))


def from_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """Quantity and price in thousands; without an id, for queries that need none."""
    return spark.read.parquet(f"{folder}/lineitem.parquet").select(F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / F.lit(1000.0)).alias("y"))
