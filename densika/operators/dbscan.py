"""DBSCAN on two coordinates, as set operations.

N(p) holds all points at a distance of eps or less, p itself included. p is core if N(p) has min_pts points or more. Clusters
are the connected components of core points that are neighbours; a cluster's seed is its smallest core id, and clusters are
numbered from 1 in the order of their seeds. A point that isn't core joins the neighbouring cluster with the smallest
seed (border="canonical"), or does so only if the seed is smaller than its own id (border="scan"); else it is noise, 0.

Dense cells (side eps / (2 sqrt 2), min_pts points or more) make the same labels with fewer pairs: their points are core
without a count, a cell is one vertex, touching cells are linked without a distance, and only points outside them probe the
grid. Dense cells that don't touch but may hold neighbours are compared by points only while they aren't connected.
Pairs are never stored: each join is aggregated to counts, or to distinct edges of vertices, before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densika.functions.geometry import PRUNING, within
from densika.operators.components import connected_components
from densika.operators.dense import adjacency, crowding, with_small_cells
from densika.operators.grid import clean
from densika.operators.lineage import cut
from densika.operators.neighbors import neighbor_counts, range_join
from densika.operators.ordered import ordinal
from densika.operators.partitioning import assign
from densika.plans.estimates import shuffle_partitions

#: Up to so many edges, components are found in one task.
LOCAL_EDGES = 1 << 21


def _far_links(celled: DataFrame, linked: DataFrame, eps: float) -> DataFrame:
    """a, b: vertices of dense cells that hold neighbours but don't touch and aren't connected yet.

    Pairs of cells are found by cells, up to three apart and each once. A cell's points take part in a pair only where
    they lie within eps of the other cell's bounding box, so two hot cells side by side compare their rims.
    """
    box = [f"{f}{a}" for a in "xy" for f in ("min", "max")]
    steps = [(i, j) for i in range(4) for j in range(-3, 4) if (i > 0 or j > 0) and max(i, abs(j)) > 1]
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps))
    a = linked.select(F.explode(offsets).alias("s"), "sx", "sy", F.col("vertex").alias("va"), F.col("component").alias("ca"), *(F.col(c).alias(f"a_{c}") for c in box))
    a = a.withColumns({"sx": F.col("sx") + F.col("s.i"), "sy": F.col("sy") + F.col("s.j")})
    b = linked.select("sx", "sy", F.col("vertex").alias("vb"), F.col("component").alias("cb"), *(F.col(c).alias(f"b_{c}") for c in box))
    near = cut(a.join(b, ["sx", "sy"]).where("ca <> cb").select("va", "vb", *(f"{t}_{c}" for t in "ab" for c in box)))
    reach = F.lit(float(eps) * PRUNING)

    def rim(own: str, other: str) -> DataFrame:
        gaps = [F.greatest(F.col(f"{other}_min{c}") - F.col(c), F.col(c) - F.col(f"{other}_max{c}"), F.lit(0.0)) for c in "xy"]
        inside = celled.where("least IS NOT NULL").select(F.col("least").alias(f"v{own}"), "x", "y").join(near, f"v{own}")
        return inside.where((gaps[0] <= reach) & (gaps[1] <= reach)).select("va", "vb", F.col("x").alias(f"x{own}"), F.col("y").alias(f"y{own}"))

    pairs = rim("a", "b").join(rim("b", "a"), ["va", "vb"])
    pairs = pairs.where(within(F.col("xa"), F.col("ya"), F.col("xb"), F.col("yb"), eps))
    return pairs.select(F.col("va").alias("a"), F.col("vb").alias("b")).distinct()


def _core(points: DataFrame, eps: float, min_pts: int, dense: bool, partitions: int | None) -> tuple[DataFrame, DataFrame]:
    """Points with is_core and vertex (null unless core), and the links among vertices that need no probe."""
    if not dense:
        counts = neighbor_counts(points, eps, partitions).where(F.col("n") >= min_pts).select("id", F.col("id").alias("vertex"))
        found = points.join(counts, "id", "left").select("id", "x", "y", "vertex", F.lit(False).alias("dense"))
        return cut(found, "core points"), None
    small = with_small_cells(points, eps)
    boxes = [f(c).alias(f"{f.__name__}{c}") for c in "xy" for f in (F.min, F.max)]
    cells = cut(small.groupBy("sx", "sy").agg(F.count("*").alias("n"), F.min("id").alias("least"), *boxes).where(F.col("n") >= min_pts), "dense cells")
    celled = small.join(cells.select("sx", "sy", "least"), ["sx", "sy"], "left")
    sparse = celled.where("least IS NULL").select("id", "x", "y")
    core = range_join(sparse, points, eps, ["id"], ["id other"], partitions).groupBy("id").count().where(F.col("count") >= min_pts).select("id", F.col("id").alias("own"))
    found = celled.join(core, "id", "left")
    found = found.select("id", "x", "y", F.coalesce("least", "own").alias("vertex"), F.col("least").isNotNull().alias("dense"))
    touching = cut(adjacency(cells))
    component = connected_components(touching, local_edges=LOCAL_EDGES).withColumnRenamed("id", "least")
    linked = cells.join(component, "least", "left").withColumn("component", F.coalesce("component", "least")).withColumnRenamed("least", "vertex")
    far = _far_links(celled, linked, eps)
    return cut(found, "core points"), touching.unionAll(far)


def _linked_cells(found: DataFrame, links: DataFrame | None, eps: float) -> tuple[DataFrame, DataFrame | None]:
    """_core()'s result with one vertex for all core points of a cell whose diagonal is eps, as they are neighbours of one another."""
    side = F.lit(float(eps) / PRUNING / 2**0.5)
    placed = found.select("*", *(F.floor(F.col(c) / side).cast("long").alias(f"l{c}") for c in "xy"))
    core = placed.where("vertex IS NOT NULL").groupBy("lx", "ly").agg(F.min("id").alias("joint"))
    joined = placed.join(core, ["lx", "ly"], "left")
    out = cut(joined.select("id", "x", "y", F.when(F.col("vertex").isNotNull(), F.col("joint")).alias("vertex"), "dense"), "vertices")
    if links is None:
        return out, None
    own = out.select(F.col("id").alias("a"), F.col("vertex").alias("va")), out.select(F.col("id").alias("b"), F.col("vertex").alias("vb"))
    both = links.join(own[0], "a").join(own[1], "b").select(F.col("va").alias("a"), F.col("vb").alias("b"))
    inside = joined.where("dense").select(F.col("vertex").alias("a"), F.col("joint").alias("vb")).distinct()
    spans = inside.join(own[0], "a").select(F.col("va").alias("a"), F.col("vb").alias("b"))
    return out, both.unionAll(spans).where("a <> b").distinct()


def cluster(
    df: DataFrame, eps: float, min_pts: int, id_col: str = "id", x_col: str = "x", y_col: str = "y",
    border: str = "canonical", dense_cells: bool | str = "auto", partitions: int | str | None = None,
) -> DataFrame:
    """id, x, y, cluster, is_core, role (core, border or noise). Rows with a null or NaN are dropped; ids are distinct.

    partitions sets their number for range joins; "auto" takes it from a sample's neighbours, and at least the session's.
    """
    if border not in ("canonical", "scan"):
        raise ValueError("border is canonical or scan")
    if eps <= 0 or min_pts < 1:
        raise ValueError("eps must be positive and min_pts at least 1")
    points = clean(df, id_col, x_col, y_col)
    if partitions == "auto":
        partitions = shuffle_partitions(points, eps, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if dense_cells == "auto":
        crowded = crowding(points, eps).first()["crowding"]
        dense_cells = crowded is not None and crowded >= min_pts
    found, links = _core(points, eps, min_pts, bool(dense_cells), partitions)
    found, links = _linked_cells(found, links, eps)
    cored = found.where("vertex IS NOT NULL").select("x", "y", "vertex")
    touched = range_join(found.where("NOT dense"), cored, eps, ["id", "vertex own"], ["vertex"], partitions).where("own IS NULL OR own <> vertex")
    touched = cut(touched.select(F.when(F.col("own").isNull(), F.col("id")).alias("id"), "own", "vertex").distinct(), "touched vertices")
    edges = touched.where("own IS NOT NULL").select(F.col("own").alias("a"), F.col("vertex").alias("b"))
    component = connected_components(edges if links is None else edges.unionAll(links), local_edges=LOCAL_EDGES)
    vertices = found.where("vertex IS NOT NULL").select("vertex").distinct()
    seeds = vertices.join(component.withColumnRenamed("id", "vertex"), "vertex", "left").select("vertex", F.coalesce("component", "vertex").alias("seed"))
    numbers = ordinal(seeds.select("seed").distinct(), "seed", "cluster")
    seeds = cut(seeds.join(numbers, "seed").select("vertex", "seed", F.col("cluster").cast("int").alias("cluster")), "numbered vertices")
    joins = touched.where("own IS NULL").select("id", "vertex").join(seeds, "vertex")
    if border == "scan":
        joins = joins.where("seed < id")
    borders = joins.groupBy("id").agg(F.min("cluster").alias("border"))
    out = found.join(seeds.select("vertex", "cluster"), "vertex", "left").join(borders, "id", "left")
    is_core = F.col("vertex").isNotNull()
    role = F.when(is_core, "core").when(F.col("border").isNotNull(), "border").otherwise("noise")
    return out.select("id", "x", "y", F.coalesce("cluster", "border", F.lit(0)).alias("cluster"), is_core.alias("is_core"), role.alias("role"))


def core_components(points: DataFrame, eps: float, min_pts: int) -> DataFrame:
    """id, component of the core points: the smallest core id that each reaches."""
    labels = cluster(points, eps, min_pts).where("is_core").select("id", "cluster")
    seeds = labels.groupBy("cluster").agg(F.min("id").alias("component"))
    return labels.join(seeds, "cluster").select("id", "component")


def partition_merges(points: DataFrame, eps: float, min_pts: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """Clusters of each partition by itself (id, part, local: smallest core id), and the pairs of them that neighbours join.

    Core points are found over all partitions; only the links within a partition make local clusters.
    """
    core = neighbor_counts(points, eps).where(F.col("n") >= min_pts).select("id")
    placed = cut(assign(points, eps, parts).join(core, "id", "left_semi").select("id", "x", "y", "part"))
    linked = cut(range_join(placed, placed, eps, ["id a", "part pa"], ["id b", "part pb"]).where("a < b"))
    component = connected_components(linked.where("pa = pb"), local_edges=LOCAL_EDGES)
    local = placed.join(component, "id", "left").select("id", "part", F.coalesce("component", "id").alias("local"))
    local = cut(local)
    a, b = local.select(F.col("id").alias("a"), F.col("local").alias("la")), local.select(F.col("id").alias("b"), F.col("local").alias("lb"))
    across = linked.where("pa <> pb").join(a, "a").join(b, "b")
    return local, across.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()


def merged(local: DataFrame, merges: DataFrame) -> DataFrame:
    """id, cluster seed: local clusters after their merges; labels without a merge stay."""
    component = connected_components(merges, local_edges=LOCAL_EDGES).withColumnRenamed("id", "local")
    return local.join(component, "local", "left").select("id", F.coalesce("component", "local").alias("component"))
