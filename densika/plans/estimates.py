"""Figures that choose a plan: samples, variances, and how many partitions a range join needs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densika.operators.neighbors import sampled_pair_count

#: Bytes of a pair in a shuffle, and bytes that a partition should hold.
PAIR_BYTES, PARTITION_BYTES = 24, 128 << 20


# Up to SMALL points every 100th is sampled, of more points SAMPLED in all; by what share more pairs are planned
# for; and how many more neighbours a reference point has, as its radius is 1.5 eps.
SMALL, SAMPLED, HEAD_ROOM, REFERENCE_AREA = 2_000_000, 40_000, 0.25, 2.25


def every(points: DataFrame, k: int) -> DataFrame:
    """Every k-th point by id."""
    return points.where(F.pmod("id", F.lit(k)) == 0)


def variance_order(points: DataFrame, k: int = 100) -> DataFrame:
    """dim, variance, place: the axes by falling variance of a sample."""
    sample = every(points, k).agg(F.var_pop("x").alias("x"), F.var_pop("y").alias("y"))
    ranked = sample.select(F.array_sort(F.array(*(F.struct((-F.col(c)).alias("minus"), F.lit(c).alias("dim")) for c in "xy"))).alias("o"))
    return ranked.select(F.posexplode("o").alias("place", "d")).select("d.dim", (-F.col("d.minus")).alias("variance"), (F.col("place") + 1).alias("place"))


def permuted(points: DataFrame, k: int = 100) -> DataFrame:
    """id, d1, d2: the coordinates in the order of variance_order()."""
    order = [r["dim"] for r in variance_order(points, k).orderBy("place").collect()]  # one row for each axis
    return points.select("id", *(F.col(dim).alias(f"d{n}") for n, dim in enumerate(order, 1)))


def sampling_step(n: int) -> int:
    """Of n points, every so many-th is sampled."""
    return 100 if n <= SMALL else math.ceil(n / SAMPLED)


def pair_estimate(points: DataFrame, eps: float) -> DataFrame:
    """One row: n_points, step, sampled, estimate of all pairs, of those of reference points, and what to plan for."""
    n = points.count()
    step = sampling_step(n)
    found = sampled_pair_count(points, eps, step)
    planned = F.ceil(F.col("estimate") * (1 + HEAD_ROOM)).cast("long")
    reference = F.ceil(F.col("estimate") * REFERENCE_AREA).cast("long")
    return found.select(F.lit(n).cast("long").alias("n_points"), F.lit(step).alias("step"), "sampled", "estimate", reference.alias("of_references"), planned.alias("planned"))


def shuffle_partitions(points: DataFrame, eps: float, least: int = 8) -> int:
    """Partitions for the pairs within eps, from a sample."""
    return max(least, math.ceil(pair_estimate(points, eps).first()["planned"] * PAIR_BYTES / PARTITION_BYTES))


def operators_of(df: DataFrame) -> list[str]:
    """The names of the physical operators that Catalyst chose, from the formatted plan."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    return [w for line in text.splitlines() if (w := line.lstrip(" :+-*()0123456789").split(" ")[0].split("(")[0])]
