"""Connected components of an edge table (union-find in the relational form)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densika.operators.lineage import cut, cut_and_observe


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", local_edges: int = 0) -> DataFrame:
    """id, component: the smallest id that each endpoint reaches.

    Alternates the large-star and small-star steps (Kiveris et al., 2014) until no edge changes, in O(log^2 n) rounds.
    Both steps need one aggregate and one join by node. Edges go to the shared folder between rounds, so lineage stays
    short and a lost executor costs one round. At most local_edges edges, counted as they are written, are joined in one task
    instead, which takes about 100 bytes an edge; both ways give the same components. Edges with a null end are left out; loops make a component of one.
    """
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    now, found = cut_and_observe(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), F.count(F.lit(1)).alias("edges"))
    if found["edges"] <= local_edges:
        return now.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_in_one_task, "id long, component long")
    nodes = now.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    now, seen = now.where("a <> b"), None
    while True:
        # Ids are hashed before they are summed, so edge sets that differ hardly agree in count and sum.
        hashed = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        now, state = cut_and_observe(_small_star(_large_star(now)), F.count(F.lit(1)).alias("edges"), hashed.alias("sum"))
        if state == seen:
            break
        seen = state
    roots = now.groupBy("a").agg(F.min("b").alias("root"))
    return nodes.join(roots, nodes["id"] == roots["a"], "left").select("id", F.coalesce("root", "id").alias("component"))


def _in_one_task(table: pa.Table) -> pa.Table:
    """Hooks each root to the smallest it meets and shortens paths, all edges at a time."""
    ids, ends = np.unique(np.concatenate([table["a"].to_numpy(), table["b"].to_numpy()]), return_inverse=True)
    a, b = ends[: table.num_rows], ends[table.num_rows :]
    root = np.arange(len(ids))
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return pa.table({"id": pa.array(ids), "component": pa.array(ids[root])})
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (short := root[root] != root).any():
            root[short] = root[root][short]


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour, or to itself."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionAll(least.select("a", F.col("least").alias("b"))).where("a <> b").distinct()
