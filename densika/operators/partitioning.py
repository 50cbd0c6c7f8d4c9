"""Range partitions along x: boundaries, assignment, bands around the cuts, and schedules.

Partitions are few (a parameter), so their boundaries are one row with an array, which may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densika.operators.grid import dimensions, x_cumulative
from densika.operators.ordered import ordinal

# Fixed value: the share of a partition in which its edge may move forward.
LOOK_AHEAD = 0.75


def bounds(points: DataFrame, eps: float, parts: int) -> DataFrame:
    """One row: edges, an array of parts + 1 bins; inner edge k is the last bin with a running fraction of k / parts or less."""
    cum = x_cumulative(points, eps)
    inner = [F.coalesce(F.max(F.when(F.col("frac") <= F.lit(k / parts), F.col("bin"))), F.lit(0).cast("long")) for k in range(1, parts)]
    return cum.agg(F.array(F.lit(0).cast("long"), *inner, F.max("bin") + 1).alias("edges"))


def bounds_at_minima(points: DataFrame, eps: float, parts: int) -> DataFrame:
    """As bounds, each inner edge moved forward to the emptiest bin of the first 75 % of its partition (the first of equals)."""
    cum = x_cumulative(points, eps)
    at = cum.join(F.broadcast(bounds(points, eps, parts)))
    e = F.col("edges")
    inner = []
    for k in range(1, parts):
        width = F.floor((e[k + 1] - e[k]) * F.lit(LOOK_AHEAD))
        ahead = (F.col("bin") >= e[k]) & (F.col("bin") < e[k] + width)
        best = F.min(F.when(ahead, F.struct("n", "bin")))["bin"]
        inner.append(F.coalesce(best, F.max(e[k])))
    return at.agg(F.array(F.lit(0).cast("long"), *inner, F.max(e[parts])).alias("edges"))


def as_rows(edges: DataFrame) -> DataFrame:
    """part, lo_bin, hi_bin: half-open ranges of bins."""
    n = F.size("edges") - 1
    return edges.select("edges", F.explode(F.sequence(F.lit(0), n - 1)).alias("part")).select(
        "part", F.col("edges")[F.col("part")].alias("lo_bin"), F.col("edges")[F.col("part") + 1].alias("hi_bin")
    )


def with_bins(points: DataFrame, eps: float) -> DataFrame:
    d = F.broadcast(dimensions(points, eps).select("min_x"))
    return points.join(d).select(*points.columns, F.floor((F.col("x") - F.col("min_x")) / F.lit(float(eps))).cast("long").alias("bin"))


def assign(points: DataFrame, eps: float, parts: int, edges: DataFrame | None = None) -> DataFrame:
    """points with bin and part."""
    edges = bounds(points, eps, parts) if edges is None else edges
    inner = F.slice("edges", 2, parts - 1) if parts > 1 else F.array().cast("array<long>")
    part = F.size(F.filter(inner, lambda b: b <= F.col("bin")))
    return with_bins(points, eps).join(F.broadcast(edges)).select(*points.columns, "bin", part.alias("part"))


def slots(points: DataFrame, eps: float, parts: int) -> DataFrame:
    """id, part and the place (from 0) of each point among its partition's, by id."""
    return ordinal(assign(points, eps, parts), "id", "place", ("part",)).select("id", "part", (F.col("place") - 1).alias("slot"))


def band_bins(points: DataFrame, eps: float, parts: int) -> DataFrame:
    """The bins around inner edges: one on the left of each cut, three from it on."""
    rows = as_rows(bounds(points, eps, parts)).where("part > 0")
    return rows.select(F.explode(F.sequence(F.col("lo_bin") - 1, F.col("lo_bin") + 2)).alias("bin")).distinct()


def band_points(points: DataFrame, eps: float, parts: int) -> DataFrame:
    """Points in the bands around cuts; the bins are 4 for each cut at most, so they are broadcast."""
    return with_bins(points, eps).join(F.broadcast(band_bins(points, eps, parts)), "bin", "left_semi").select("id", "bin")


def density(points: DataFrame, eps: float, parts: int) -> DataFrame:
    """part, points, bins and whole points a bin; partitions without bins have density 0."""
    rows = as_rows(bounds(points, eps, parts))
    n = assign(points, eps, parts).groupBy("part").agg(F.count("*").alias("n_points"))
    joined = rows.join(n, "part", "left").select("part", F.coalesce("n_points", F.lit(0)).alias("n_points"), (F.col("hi_bin") - F.col("lo_bin")).alias("n_bins"))
    return joined.withColumn("density", F.when(F.col("n_bins") > 0, F.floor(F.col("n_points") / F.col("n_bins"))).otherwise(F.lit(0)).cast("long"))


def schedule(points: DataFrame, eps: float, parts: int) -> DataFrame:
    """place, part, density: the densest partition first, of equals the one with the highest number."""
    ranked = density(points, eps, parts).agg(F.sort_array(F.collect_list(F.struct("density", "part")), asc=False).alias("o"))
    return ranked.select(F.posexplode("o").alias("place", "p")).select((F.col("place") + 1).alias("place"), "p.part", "p.density")
