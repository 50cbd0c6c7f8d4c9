"""Running sums and ordinals in the order of some columns, without one task that sees all rows.

Rows are cut into ranges of the columns, which Spark samples, so any keys will do, dense or sparse. A window runs within each
range. What comes before a range is the sum of the ranges before it: one figure for each range (and group).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from densika.operators.lineage import cut


def _carried(ranged: DataFrame, by: list[str]) -> DataFrame:
    """_range, by and _start: the sum of _value in the ranges before."""
    sums = ranged.groupBy(*by, "_range").agg(F.sum("_value").alias("_sum"))
    if by:
        before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        return sums.select(*by, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    total, out = 0, []
    for r in sorted(sums.collect()):  # a row for each range, of which there are as many as shuffle partitions
        out.append((r["_range"], total))
        total += r["_sum"] or 0
    kind = sums.schema["_sum"].dataType.simpleString()
    return F.broadcast(ranged.sparkSession.createDataFrame(out, f"_range int, _start {kind}"))


def running_sum(df: DataFrame, keys: str | list[str], value: str | Column, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df with the sum of a column over all rows up to each row's keys, itself included. Keys tell rows apart."""
    keys, by = [keys] if isinstance(keys, str) else list(keys), list(by)
    value = F.col(value) if isinstance(value, str) else value
    ranged = cut(df.withColumn("_value", value).repartitionByRange(*by, *keys)).withColumn("_range", F.spark_partition_id())
    own = Window.partitionBy(*by, "_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.join(_carried(ranged, by), [*by, "_range"]).withColumn(out, F.col("_start") + F.sum("_value").over(own))
    return summed.select(*df.columns, out)


def ordinal(df: DataFrame, keys: str | list[str], out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df with each row's 1-based place in the order of some columns."""
    return running_sum(df, keys, F.lit(1).cast("long"), out, by)
