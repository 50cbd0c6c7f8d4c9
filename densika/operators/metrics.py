"""Summaries of a clustering, and how alike two clusterings are. Labels are (id, cluster) with 0 for noise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densika.operators.ordered import ordinal, running_sum


def summary(labels: DataFrame) -> DataFrame:
    """One row: points, labels (noise counts as one), clusters, noise and its share."""
    noise = (F.col("cluster") == 0).cast("long")
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(noise).alias("noise"))
    n, z = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("noise"), F.lit(0))
    return sizes.agg(
        n.alias("n_points"), F.count("*").alias("n_labels"), F.count_if(F.col("cluster") > 0).alias("n_clusters"), z.alias("n_noise"),
        F.when(n > 0, z / n).alias("noise_fraction"),
    )


def sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("cluster").agg(F.count("*").alias("n"))


def compact(labels: DataFrame) -> DataFrame:
    """id, cluster, label: each cluster's rank among all, 0 being noise whether or not there is any."""
    ranks = ordinal(labels.where("cluster <> 0").select("cluster").distinct(), "cluster", "label")
    return labels.join(ranks, "cluster", "left").select("id", "cluster", F.coalesce("label", F.lit(0)).alias("label"))


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """c1, c2, n: how many points have each pair of labels."""
    both = a.select("id", F.col("cluster").alias("c1")).join(b.select("id", F.col("cluster").alias("c2")), "id")
    return both.groupBy("c1", "c2").agg(F.count("*").alias("n"))


def similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the mean over points of 1 (noise in both), 0 (in one) or the Jaccard similarity of their two clusters.

    From the contingency table and its marginals: two clusters of n1 and n2 points that share n score n / (n1 + n2 - n)
    for each of the n points.
    """
    table = contingency(a, b)
    n1, n2 = table.groupBy("c1").agg(F.sum("n").alias("n1")), table.groupBy("c2").agg(F.sum("n").alias("n2"))
    n, x, y = F.col("n"), F.col("c1") == 0, F.col("c2") == 0
    score = F.when(x & y, n.cast("double")).when(x | y, F.lit(0.0)).otherwise(n * (n / (F.col("n1") + F.col("n2") - n)))
    return table.join(n1, "c1").join(n2, "c2").agg(
        (F.sum(score) / F.sum(n)).alias("score"), F.coalesce(F.sum(F.when(x != y, n)), F.lit(0)).alias("noise_mismatch"),
        F.coalesce(F.sum(F.when(x & y, n)), F.lit(0)).alias("noise_agree"),
    )


def offsets(labels: DataFrame) -> DataFrame:
    """part, most, offset: what to add to each partition's cluster ids so that none meet (a running sum of most + 1)."""
    most = labels.groupBy("part").agg(F.max("cluster").alias("most")).withColumn("step", F.col("most") + 1)
    return running_sum(most, "part", "step", "upto").select("part", "most", (F.col("upto") - F.col("step")).alias("offset"))
