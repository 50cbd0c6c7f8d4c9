"""Range joins of points on a grid, and what is counted from them.

A pair within eps lies in cells that touch. One side is repeated for the nine cells around it, so the theta join becomes
an equi-join on the cell with the distance as residual; cells without points drop out of the join, AQE splits cells that
are hot. Nothing is broadcast unless the planner finds a side small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from densika.functions.geometry import PRUNING, cells_of, distance, in_box
from densika.operators.grid import with_cells


def _around(probes: DataFrame, side: float) -> DataFrame:
    """Each probe once for its cell and each of the eight around it."""
    steps = F.array(*(F.lit(k).cast("long") for k in (-1, 0, 1)))
    own = probes.select("*", *cells_of(side))
    own = own.select("*", F.explode(steps).alias("_sx"))
    own = own.select("*", F.explode(steps).alias("_sy"))
    return own.withColumns({"cx": F.col("cx") + F.col("_sx"), "cy": F.col("cy") + F.col("_sy")}).drop("_sx", "_sy")


#: Points that pairs_brute() takes at most, unless it is told otherwise.
BRUTE_POINTS = 50_000
#: Points of a block of pairs_brute(), those of one side that are compared at a time, and the most pairs of blocks in a task.
BLOCK_POINTS, STRIP_POINTS, TASK_BLOCKS = 4096, 64, 64


def range_join(
    probes: DataFrame, points: DataFrame, radius: float, probe_cols: list[str], point_cols: list[str], partitions: int | None = None, indexed: bool = False
) -> DataFrame:
    """All pairs of a probe and a point (both with x and y) at a distance of radius or less, with the named columns.

    partitions sets their number for the join; indexed points have cx, cy of sinks.save_index() and aren't shuffled.
    """
    side = radius * PRUNING
    a, b = _around(probes, side), points if indexed else points.select("*", *cells_of(side))
    if partitions:
        a, b = a.repartition(partitions, "cx", "cy"), b.repartition(partitions, "cx", "cy")
    a, b = a.alias("a"), b.alias("b")
    same = (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy"))
    near = distance(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y")) <= F.lit(float(radius))
    return a.join(b, same & near).select(*(F.col(f"a.{c.split(' ')[0]}").alias(c.split(" ")[-1]) for c in probe_cols), *(F.col(f"b.{c.split(' ')[0]}").alias(c.split(" ")[-1]) for c in point_cols))


def pairs(points: DataFrame, eps: float) -> DataFrame:
    """src, dst: all pairs of neighbours, both ways, every point its own."""
    return range_join(points, points, eps, ["id src"], ["id dst"])


def pairs_brute(points: DataFrame, eps: float, most: int | None = BRUTE_POINTS) -> DataFrame:
    """The same by comparing all pairs, as a check; fails beyond most points, and takes any number if most is None.

    Points are dealt into blocks by hash. Each two blocks meet once, in a row of their own, and are compared strip by strip, so
    a task holds a bounded number of points and of pairs, and nothing is broadcast. The time grows with the points' square.
    """
    if most is not None and points.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} points; take pairs()")
    points = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    k = max(1, -(-points.count() // BLOCK_POINTS))
    meetings = k * (k + 1) // 2
    tasks = min(meetings, max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-meetings // TASK_BLOCKS)))
    dealt = points.select(F.pmod(F.xxhash64("id", "x", "y"), F.lit(k)).alias("block"), F.struct("id", "x", "y").alias("point"))
    blocks = dealt.groupBy("block").agg(F.collect_list("point").alias("points"))
    a = blocks.select(F.col("block").alias("i"), F.col("points").alias("a"), F.explode(F.sequence("block", F.lit(k - 1).cast("long"))).alias("j"))
    both = a.join(blocks.select(F.col("block").alias("j"), F.col("points").alias("b")), "j").select("i", "j", "a", "b").repartition(tasks)
    names, strip, block, radius = ["src", "dst"], STRIP_POINTS, BLOCK_POINTS, float(eps)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, a, b in zip(*batch.columns, strict=True):
                (a_ids, *a_at), (b_ids, *b_at) = a.values.flatten(), b.values.flatten()
                (ax, ay), (bx, by) = ([v.to_numpy(zero_copy_only=False) for v in at] for at in (a_at, b_at))
                for m in range(0, len(ax), strip):
                    for n in range(0, len(bx), block):
                        with np.errstate(invalid="ignore", over="ignore"):  # infinite points are nobody's neighbours
                            dx, dy = (u[m : m + strip, None] - v[n : n + block] for u, v in ((ax, bx), (ay, by)))
                            near = np.flatnonzero(np.sqrt(dx * dx + dy * dy) <= radius)
                        if len(near):
                            p, q = np.divmod(near, dx.shape[1])
                            found = [a_ids.take(pa.array(p + m)), b_ids.take(pa.array(q + n))]
                            yield pa.RecordBatch.from_arrays(found, names)
                            if i != j:
                                yield pa.RecordBatch.from_arrays(found[::-1], names)

    kind = points.schema["id"].dataType.simpleString()
    return both.mapInArrow(compare, f"src {kind}, dst {kind}")


def neighbor_counts(points: DataFrame, eps: float, partitions: int | None = None) -> DataFrame:
    return range_join(points, points, eps, ["id"], ["id dst"], partitions).groupBy("id").agg(F.count("*").alias("n"))


def neighbor_lists(points: DataFrame, eps: float) -> DataFrame:
    """id, place, nbr: each point's neighbours in the order of their ids, a row for each."""
    place = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    return pairs(points, eps).select(F.col("src").alias("id"), place.cast("long").alias("place"), F.col("dst").alias("nbr"))


def core_points(points: DataFrame, eps: float, min_pts: int) -> DataFrame:
    return neighbor_counts(points, eps).where(F.col("n") >= min_pts).select("id", "n")


def window_counts(probes: DataFrame, points: DataFrame, eps: float) -> DataFrame:
    """For each probe, the points in the closed square of half-width eps around it, and those of them within eps."""
    side, e = eps * PRUNING, F.lit(float(eps))
    a, b = _around(probes, side).alias("a"), points.select("*", *cells_of(side)).alias("b")
    ax, ay, bx, by = (F.col(c) for c in ("a.x", "a.y", "b.x", "b.y"))
    same = (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy"))
    joined = a.join(b, same & in_box(bx, by, ax - e, ax + e, ay - e, ay + e))
    return joined.groupBy(F.col("a.id").alias("id")).agg(
        F.count("*").alias("in_window"), F.count_if(distance(ax, ay, bx, by) <= e).alias("in_range")
    )


def reference_points(points: DataFrame, eps: float) -> DataFrame:
    """cx, cy, rx, ry: the centres of the cells that hold points."""
    e = F.lit(float(eps))
    box = points.agg((F.min("x") - e).alias("min_x"), (F.min("y") - e).alias("min_y"))
    centre = [(F.col(f"min_{a}") + e / F.lit(2.0) + F.col(f"c{a}") * e).alias(f"r{a}") for a in "xy"]
    return with_cells(points, eps).select("cx", "cy").distinct().join(F.broadcast(box)).select("cx", "cy", *centre)


def reference_neighbors(points: DataFrame, eps: float) -> DataFrame:
    """cx, cy, id: the points within 1.5 eps of each reference point."""
    refs = reference_points(points, eps).select("cx", "cy", F.col("rx").alias("x"), F.col("ry").alias("y"))
    probes = refs.withColumnsRenamed({"cx": "ref_x", "cy": "ref_y"})
    return range_join(probes, points, 1.5 * eps, ["ref_x cx", "ref_y cy"], ["id"])


def indexed_counts(points: DataFrame, index: DataFrame, eps: float) -> DataFrame:
    """neighbor_counts() of probes among the points of a saved index, of which only the probes are shuffled."""
    return range_join(points, index, eps, ["id"], ["id dst"], indexed=True).groupBy("id").agg(F.count("*").alias("n"))


def sampled_pair_count(points: DataFrame, eps: float, every: int) -> DataFrame:
    """One row: neighbours of every k-th point by id, and the estimate for all."""
    some = points.where(F.pmod("id", F.lit(every)) == 0)
    return range_join(some, points, eps, ["id src"], ["id dst"]).agg(F.count("*").alias("sampled")).withColumn("estimate", F.col("sampled") * every)
