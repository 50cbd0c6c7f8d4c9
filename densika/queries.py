"""One query for each operator of the engine, and the SQL that each is held against.

Points come from the test tables: embeddings (eps 0.02, 4 points), events (eps 1, 4) and customers (eps 100, 4).
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from densika.functions import geometry
from densika.operators import dbscan, dense, grid, metrics, neighbors, partitioning
from densika.operators.components import connected_components
from densika.operators.lineage import cut, shared_folder, traced
from densika.operators.ordered import ordinal, running_sum
from densika.plans import estimates
from densika.sources import points as sources
from densika.sources import sinks
from densika.streaming import points as streaming

EMB = (0.02, 4)
WIDE = (0.03, 4)
EVENTS = (1.0, 4)
CUST = (100.0, 4)
PARTS = 4

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

EMB_SQL = "SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings"
EVENTS_SQL = (
    "SELECT event_id AS id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0::DOUBLE AS x,"
    " CAST(value AS DOUBLE) AS y FROM events"
)
CUST_SQL = "SELECT c_custkey AS id, CAST(c_acctbal AS DOUBLE) AS x, CAST(c_custkey AS DOUBLE) AS y FROM customer"
ITEM_SQL = "SELECT CAST(l_quantity AS DOUBLE) AS x, l_extendedprice / 1000.0::DOUBLE AS y FROM lineitem"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _with(pts: str, eps: float, *steps: str, recursive: bool = False) -> str:
    """A WITH clause: pts, then the named steps, each built on those before."""
    known = {
        "box": f"SELECT min(x) - {eps} AS min_x, max(x) + {eps} AS max_x, min(y) - {eps} AS min_y, max(y) + {eps} AS max_y FROM pts",
        "dims": f"SELECT *, CAST(ceil((max_x - min_x) / {eps}) AS BIGINT) AS n_x, CAST(ceil((max_y - min_y) / {eps}) AS BIGINT) AS n_y FROM box",
        "celled": f"""SELECT pts.*, CAST(floor((x - min_x) / {eps}) AS BIGINT) AS cx, CAST(floor((y - min_y) / {eps}) AS BIGINT) AS cy,
            CAST(floor((x - min_x) / {eps}) AS BIGINT) + CAST(floor((y - min_y) / {eps}) AS BIGINT) * n_x AS cell FROM pts, dims""",
        "hist": """SELECT b.bin, count(c.cx) AS n FROM (SELECT unnest(range(n_x)) AS bin FROM dims) b LEFT JOIN celled c ON c.cx = b.bin GROUP BY b.bin""",
        "cum": """SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS cum,
            CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) / CAST((SELECT count(*) FROM pts) AS DOUBLE) AS frac FROM hist""",
        "edges": f"""SELECT CAST(k AS INTEGER) AS k, CASE WHEN k = 0 THEN 0 WHEN k = {PARTS} THEN (SELECT n_x FROM dims)
            ELSE coalesce((SELECT max(bin) FROM cum WHERE frac <= k / {float(PARTS)}::DOUBLE), 0) END AS edge FROM range({PARTS + 1}) t(k)""",
        "parts": "SELECT a.k AS part, CAST(a.edge AS BIGINT) AS lo_bin, CAST(b.edge AS BIGINT) AS hi_bin FROM edges a JOIN edges b ON b.k = a.k + 1",
        "placed": "SELECT c.*, p.part FROM celled c JOIN parts p ON c.cx >= p.lo_bin AND c.cx < p.hi_bin",
        "band": "SELECT DISTINCT lo_bin + s.s AS bin FROM parts, (VALUES (-1), (0), (1), (2)) s(s) WHERE part > 0",
        "pairs": f"SELECT a.id AS src, b.id AS dst FROM pts a JOIN pts b ON b.x BETWEEN a.x - 1.001 * {eps} AND a.x + 1.001 * {eps} AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {eps}",
    }
    clauses = [f"pts AS ({pts})"]
    for s in steps:
        clauses.append(f"{s} AS ({known[s]})" if s in known else s)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(clauses) + " "


def _small(eps: float, min_pts: int) -> list[str]:
    side = float(eps) * geometry.DENSE_SIDE
    return [
        f"small AS (SELECT id, x, y, CAST(floor(x / {side!r}) AS BIGINT) AS sx, CAST(floor(y / {side!r}) AS BIGINT) AS sy FROM pts)",
        f"dense AS (SELECT sx, sy, count(*) AS n, min(id) AS least FROM small GROUP BY sx, sy HAVING count(*) >= {min_pts})",
        """touch AS (SELECT a.least AS a, b.least AS b FROM dense a JOIN dense b ON
            (b.sx, b.sy) IN ((a.sx + 1, a.sy), (a.sx - 1, a.sy + 1), (a.sx, a.sy + 1), (a.sx + 1, a.sy + 1)))""",
    ]


def _labels(min_pts: int, border: str = "canonical", to: str = "") -> list[str]:
    """Steps after pairs that make labels{to}(id, x, y, cluster, is_core, role); pairs{to} are read."""
    scan = "AND s.seed < p.src" if border == "scan" else ""
    return [
        f"core{to} AS (SELECT src AS id FROM pairs{to} GROUP BY src HAVING count(*) >= {min_pts})",
        f"links{to} AS (SELECT src AS a, dst AS b FROM pairs{to} WHERE src IN (SELECT id FROM core{to}) AND dst IN (SELECT id FROM core{to}))",
        # roots spread upwards only from ids that reach nothing smaller in one step; the smallest wins in the end
        f"reach{to} AS (SELECT id AS root, id FROM core{to} UNION SELECT r.root, l.b FROM reach{to} r JOIN links{to} l ON l.a = r.id AND l.b > r.root)",
        f"comp{to} AS (SELECT id, min(root) AS seed FROM reach{to} GROUP BY id)",
        f"seeds{to} AS (SELECT id, seed, CAST(dense_rank() OVER (ORDER BY seed) AS INTEGER) AS cluster FROM comp{to})",
        f"""borders{to} AS (SELECT p.src AS id, min(s.cluster) AS cluster FROM pairs{to} p JOIN seeds{to} s ON s.id = p.dst {scan}
            WHERE p.src NOT IN (SELECT id FROM core{to}) GROUP BY p.src)""",
        f"""labels{to} AS (SELECT pts.id, pts.x, pts.y, coalesce(s.cluster, b.cluster, 0) AS cluster, s.id IS NOT NULL AS is_core,
            CASE WHEN s.id IS NOT NULL THEN 'core' WHEN b.id IS NOT NULL THEN 'border' ELSE 'noise' END AS role
            FROM pts LEFT JOIN seeds{to} s ON s.id = pts.id LEFT JOIN borders{to} b ON b.id = pts.id)""",
    ]


def _emb_labels(*more: str, border: str = "canonical") -> str:
    return _with(EMB_SQL, EMB[0], "pairs", *_labels(EMB[1], border), *more, recursive=True)


def _cluster(spark: SparkSession, sf_dir: str, eps: float = EMB[0], min_pts: int = EMB[1], **how: object) -> DataFrame:
    return dbscan.cluster(sources.from_embeddings(spark, sf_dir), eps, min_pts, **how)


# Grid


@query(_with(EVENTS_SQL, 1.0, "box") + "SELECT * FROM box")
def bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.extent(sources.from_events(spark, sf_dir), EVENTS[0])


@query(_with(EVENTS_SQL, 1.0, "box", "dims") + "SELECT *, n_x * n_y AS n_cells FROM dims")
def grid_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.dimensions(sources.from_events(spark, sf_dir), EVENTS[0])


@query(_with(EVENTS_SQL, 1.0, "box", "dims", "celled") + "SELECT id, cx, cy, cell FROM celled")
def cell_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.with_cells(sources.from_events(spark, sf_dir), EVENTS[0]).select("id", "cx", "cy", "cell")


@query(_with(ITEM_SQL, 1.0, "box", "dims", "celled") + "SELECT cx, cy, cell, count(*) AS n FROM celled GROUP BY ALL")
def nonempty_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.cells(sources.from_lineitem(spark, sf_dir), 1.0)


@query(_with(EMB_SQL, EMB[0], "box", "dims", "celled") + "SELECT cx, cy, row_number() OVER (PARTITION BY cx, cy ORDER BY id) AS place, id FROM celled")
def cell_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.cell_members(sources.from_embeddings(spark, sf_dir), EMB[0])


@query(_with(ITEM_SQL, 1.0, "box", "dims", "celled") + "SELECT count(DISTINCT cx) AS used_x, count(DISTINCT cy) AS used_y FROM celled")
def axis_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    celled = grid.cells(sources.from_lineitem(spark, sf_dir), 1.0)
    return celled.agg(F.count_distinct("cx").alias("used_x"), F.count_distinct("cy").alias("used_y"))


@query(_with(EVENTS_SQL, 1.0, "box", "dims", "celled", "hist") + "SELECT bin, n FROM hist")
def x_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.x_histogram(sources.from_events(spark, sf_dir), EVENTS[0])


@query(_with(EVENTS_SQL, 1.0, "box", "dims", "celled", "hist", "cum") + "SELECT * FROM cum")
def x_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.x_cumulative(sources.from_events(spark, sf_dir), EVENTS[0])


@query(_with(EVENTS_SQL, 1.0, "box", "dims", "celled", "hist") + "SELECT bin, CAST(sum(n) OVER (ORDER BY bin ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT) AS sum4 FROM hist")
def moving_sum4(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = grid.x_histogram(sources.from_events(spark, sf_dir), EVENTS[0])
    spread = bins.select(F.explode(F.sequence("bin", F.col("bin") + 3)).alias("bin"), "n")
    return bins.select("bin").join(spread, "bin").groupBy("bin").agg(F.sum("n").alias("sum4"))


# Partitions along x

_PARTED = ("box", "dims", "celled", "hist", "cum", "edges", "parts")


@query(_with(EVENTS_SQL, 1.0, *_PARTED) + "SELECT * FROM parts")
def partition_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioning.as_rows(partitioning.bounds(sources.from_events(spark, sf_dir), EVENTS[0], PARTS))


@query(
    _with(EVENTS_SQL, 1.0, *_PARTED, """moved AS (SELECT part AS k, CASE WHEN part = 0 THEN 0 ELSE coalesce(
        (SELECT arg_min(bin, n * 10000000000 + bin) FROM cum WHERE bin >= lo_bin AND bin < lo_bin + floor((hi_bin - lo_bin) * 0.75)), lo_bin) END AS edge
        FROM parts UNION ALL SELECT 4, n_x FROM dims)""")
    + "SELECT a.k AS part, CAST(a.edge AS BIGINT) AS lo_bin, CAST(b.edge AS BIGINT) AS hi_bin FROM moved a JOIN moved b ON b.k = a.k + 1"
)
def partition_bounds_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioning.as_rows(partitioning.bounds_at_minima(sources.from_events(spark, sf_dir), EVENTS[0], PARTS))


@query(_with(EVENTS_SQL, 1.0, *_PARTED, "placed") + "SELECT id, cx AS bin, part FROM placed")
def partition_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioning.assign(sources.from_events(spark, sf_dir), EVENTS[0], PARTS).select("id", "bin", "part")


@query(_with(EVENTS_SQL, 1.0, *_PARTED, "placed") + "SELECT id, part, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS slot FROM placed")
def partition_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioning.slots(sources.from_events(spark, sf_dir), EVENTS[0], PARTS)


@query(_with(EVENTS_SQL, 1.0, *_PARTED, "band") + "SELECT bin FROM band")
def shadow_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioning.band_bins(sources.from_events(spark, sf_dir), EVENTS[0], PARTS)


@query(_with(EVENTS_SQL, 1.0, *_PARTED, "band") + "SELECT id, cx AS bin FROM celled WHERE cx IN (SELECT bin FROM band)")
def shadow_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioning.band_points(sources.from_events(spark, sf_dir), EVENTS[0], PARTS)


_DENSITY = """density AS (SELECT p.part, count(c.id) AS n_points, p.hi_bin - p.lo_bin AS n_bins,
    CASE WHEN p.hi_bin > p.lo_bin THEN CAST(floor(count(c.id) / (p.hi_bin - p.lo_bin)::DOUBLE) AS BIGINT) ELSE 0 END AS density
    FROM parts p LEFT JOIN celled c ON c.cx >= p.lo_bin AND c.cx < p.hi_bin GROUP BY p.part, p.lo_bin, p.hi_bin)"""


@query(_with(EVENTS_SQL, 1.0, *_PARTED, _DENSITY) + "SELECT * FROM density")
def partition_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioning.density(sources.from_events(spark, sf_dir), EVENTS[0], PARTS)


@query(_with(EVENTS_SQL, 1.0, *_PARTED, _DENSITY) + "SELECT CAST(row_number() OVER (ORDER BY density DESC, part DESC) AS INTEGER) AS place, part, density FROM density")
def density_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioning.schedule(sources.from_events(spark, sf_dir), EVENTS[0], PARTS)


# Dense cells


@query(
    _with(EMB_SQL, EMB[0], "box", "dims", "celled")
    + "SELECT *, n_points / (8.0::DOUBLE * n_cells) AS mean_occupancy, n_points / (8.0::DOUBLE * n_cells) >= 1.0 AS use_dense FROM (SELECT count(*) AS n_points, count(DISTINCT cell) AS n_cells FROM celled)"
)
def densebox_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.occupancy(sources.from_embeddings(spark, sf_dir), *EMB)


@query(_with(EMB_SQL, 0.2, *_small(0.2, 4)) + "SELECT * FROM dense")
def dense_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.dense_cells(sources.from_embeddings(spark, sf_dir), 0.2, 4)


@query(_with(EMB_SQL, 0.2, *_small(0.2, 4)) + "SELECT a, b FROM touch")
def dense_cell_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.adjacency(dense.dense_cells(sources.from_embeddings(spark, sf_dir), 0.2, 4))


@query(
    _with(EMB_SQL, 0.2, *_small(0.2, 4), "sym AS (SELECT a, b FROM touch UNION ALL SELECT b, a FROM touch)",
          "reach AS (SELECT least AS root, least AS id FROM dense UNION SELECT r.root, l.b FROM reach r JOIN sym l ON l.a = r.id AND l.b > r.root)", recursive=True)
    + "SELECT d.sx, d.sy, min(r.root) AS component FROM dense d JOIN reach r ON r.id = d.least GROUP BY d.sx, d.sy"
)
def dense_cell_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.cell_components(sources.from_embeddings(spark, sf_dir), 0.2, 4)


@query(_with(EMB_SQL, 0.2, *_small(0.2, 4)) + "SELECT id, sx, sy, least FROM small JOIN dense USING (sx, sy)")
def dense_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.dense_points(sources.from_embeddings(spark, sf_dir), 0.2, 4).select("id", "sx", "sy", "least")


@query(_with(EMB_SQL, 0.2, *_small(0.2, 4)) + "SELECT id FROM small WHERE (sx, sy) NOT IN (SELECT (sx, sy) FROM dense)")
def query_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.query_points(sources.from_embeddings(spark, sf_dir), 0.2, 4).select("id")


# Range joins


@query(_with(EMB_SQL, EMB[0], "pairs") + "SELECT src, dst FROM pairs")
def eps_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.pairs(sources.from_embeddings(spark, sf_dir), EMB[0])


@query(_with(EMB_SQL, EMB[0], "pairs") + "SELECT src, dst FROM pairs")
def eps_pairs_brute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.pairs_brute(sources.from_embeddings(spark, sf_dir), EMB[0], most=None)


@query(_with(EVENTS_SQL, EVENTS[0], "pairs") + "SELECT src AS id, count(*) AS n FROM pairs GROUP BY src")
def neighbor_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.neighbor_counts(sources.from_events(spark, sf_dir), EVENTS[0])


@query(_with(CUST_SQL, CUST[0], "pairs") + "SELECT src AS id, row_number() OVER (PARTITION BY src ORDER BY dst) AS place, dst AS nbr FROM pairs")
def neighbor_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.neighbor_lists(sources.from_customers(spark, sf_dir), CUST[0])


@query(_with(EVENTS_SQL, EVENTS[0], "pairs") + "SELECT count(*) AS n_pairs FROM pairs")
def pair_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.pairs(sources.from_events(spark, sf_dir), EVENTS[0]).agg(F.count("*").alias("n_pairs"))


@query(
    _with(CUST_SQL, CUST[0])
    + """SELECT a.id, count(*) AS in_window, count(*) FILTER (sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 100) AS in_range
    FROM pts a JOIN pts b ON b.x BETWEEN a.x - 100 AND a.x + 100 AND b.y BETWEEN a.y - 100 AND a.y + 100 GROUP BY a.id"""
)
def window_query_mbb(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = sources.from_customers(spark, sf_dir)
    return neighbors.window_counts(pts, pts, CUST[0])


@query(
    _with(CUST_SQL, 100, "boxes AS (SELECT id, x - 100 AS xmin, x + 100 AS xmax, y - 100 AS ymin, y + 100 AS ymax FROM pts)",
          "query AS (SELECT CAST(0 AS DOUBLE) AS xmin, CAST(2500 AS DOUBLE) AS xmax, CAST(0 AS DOUBLE) AS ymin, CAST(400 AS DOUBLE) AS ymax)")
    + "SELECT b.* FROM boxes b, query q WHERE b.xmin <= q.xmax AND q.xmin <= b.xmax AND b.ymin <= q.ymax AND q.ymin <= b.ymax"
)
def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = sources.from_customers(spark, sf_dir)
    boxes = pts.select("id", *geometry.box_around(F.col("x"), F.col("y"), CUST[0])).alias("b")
    window = spark.range(1).select(*(F.lit(v).alias(c) for c, v in (("xmin", 0.0), ("xmax", 2500.0), ("ymin", 0.0), ("ymax", 400.0)))).alias("q")
    return boxes.join(F.broadcast(window), geometry.boxes_overlap("b", "q")).select("b.*")


_REFS = """refs AS (SELECT DISTINCT cx, cy, min_x + {0} / 2.0::DOUBLE + cx * {0} AS rx, min_y + {0} / 2.0::DOUBLE + cy * {0} AS ry FROM celled, box)""".format("CAST(0.02 AS DOUBLE)")
_REF_NEAR = "near AS (SELECT r.cx, r.cy, p.id FROM refs r JOIN pts p ON sqrt((r.rx - p.x) * (r.rx - p.x) + (r.ry - p.y) * (r.ry - p.y)) <= 0.03)"


@query(_with(EMB_SQL, EMB[0], "box", "dims", "celled", _REFS) + "SELECT * FROM refs")
def reference_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.reference_points(sources.from_embeddings(spark, sf_dir), EMB[0])


@query(_with(EMB_SQL, EMB[0], "box", "dims", "celled", _REFS, _REF_NEAR) + "SELECT * FROM near")
def ref_neighbors_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.reference_neighbors(sources.from_embeddings(spark, sf_dir), EMB[0])


@query(_emb_labels("box", "dims", "celled", _REFS, _REF_NEAR) + """SELECT cx, cy, count(DISTINCT cluster) AS n_clusters,
    string_agg(DISTINCT CAST(cluster AS VARCHAR), ',' ORDER BY CAST(cluster AS VARCHAR)) AS clusters
    FROM near JOIN labels USING (id) WHERE cluster > 0 GROUP BY cx, cy""")  # fmt: skip
def ref_cluster_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = sources.from_embeddings(spark, sf_dir)
    labels = dbscan.cluster(pts, *EMB).where("cluster > 0").select("id", "cluster")
    found = neighbors.reference_neighbors(pts, EMB[0]).join(labels, "id").groupBy("cx", "cy")
    sets = found.agg(F.collect_set(F.col("cluster").cast("string")).alias("s"))
    return sets.select("cx", "cy", F.size("s").cast("long").alias("n_clusters"), F.array_join(F.array_sort("s"), ",").alias("clusters"))


@query(_with(EMB_SQL, EMB[0], "pairs") + "SELECT count(*) AS sampled, count(*) * 10 AS estimate FROM pairs WHERE src % 10 = 0")
def estimate_pairs_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.sampled_pair_count(sources.from_embeddings(spark, sf_dir), EMB[0], 10)


@query(
    _with(EMB_SQL, EMB[0], "pairs", "step AS (SELECT count(*) AS n, CASE WHEN count(*) <= 2000000 THEN 100 ELSE CAST(ceil(count(*) / 40000.0) AS INTEGER) END AS step FROM pts)",
          "s AS (SELECT count(*) AS sampled FROM pairs, step WHERE src % step.step = 0)")
    + """SELECT n AS n_points, step, sampled, sampled * step AS estimate, CAST(ceil(sampled * step * 2.25::DOUBLE) AS BIGINT) AS of_references,
    CAST(ceil(sampled * step * 1.25::DOUBLE) AS BIGINT) AS planned FROM s, step"""
)
def pair_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What shuffle_partitions() plans by."""
    return estimates.pair_estimate(sources.from_embeddings(spark, sf_dir), EMB[0])


@query(_with(EVENTS_SQL, EVENTS[0], "pairs") + "SELECT src AS id, count(*) AS n FROM pairs GROUP BY src")
def saved_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """neighbor_count by a table of points that is bucketed by cell, saved and loaded again."""
    pts, table = sources.from_events(spark, sf_dir), f"points_{uuid.uuid4().hex}"
    sinks.save_index(pts, table, EVENTS[0], buckets=8)
    try:
        return cut(neighbors.indexed_counts(pts, sinks.load_index(spark, table, EVENTS[0]), EVENTS[0]))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


# Clustering


@query(_with(EMB_SQL, EMB[0], "pairs") + "SELECT src AS id, count(*) AS n FROM pairs GROUP BY src HAVING count(*) >= 4")
def core_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.core_points(sources.from_embeddings(spark, sf_dir), *EMB)


@query(_emb_labels() + "SELECT id, cluster FROM labels WHERE role = 'border'")
def border_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cluster(spark, sf_dir).where("role = 'border'").select("id", "cluster")


@query(_emb_labels() + "SELECT id, seed AS component FROM comp")
def core_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbscan.core_components(sources.from_embeddings(spark, sf_dir), *EMB)


@query(_emb_labels() + "SELECT id, x, y, cluster, is_core, role FROM labels")
def dbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cluster(spark, sf_dir)


@query(_emb_labels() + "SELECT id, x, y, cluster, is_core, role FROM labels")
def dbscan_labels_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cluster(spark, sf_dir, dense_cells=True)


@query(_emb_labels(border="scan") + "SELECT id, x, y, cluster, is_core, role FROM labels")
def dbscan_labels_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cluster(spark, sf_dir, border="scan")


@query(_with(EVENTS_SQL, EVENTS[0], "pairs", *_labels(EVENTS[1]), recursive=True) + "SELECT id, x, y, cluster, is_core, role FROM labels")
def dbscan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbscan.cluster(sources.from_events(spark, sf_dir), *EVENTS)


_SUMMARY = """SELECT count(*) AS n_points, count(DISTINCT cluster) AS n_labels, count(DISTINCT CASE WHEN cluster > 0 THEN cluster END) AS n_clusters,
    count(*) FILTER (cluster = 0) AS n_noise, count(*) FILTER (cluster = 0) / CAST(count(*) AS DOUBLE) AS noise_fraction FROM labels"""


@query(_emb_labels() + _SUMMARY)
def dbscan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(_cluster(spark, sf_dir))


@query(_with(CUST_SQL, CUST[0], "pairs", *_labels(CUST[1]), recursive=True) + _SUMMARY)
def dbscan_customers_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(dbscan.cluster(sources.from_customers(spark, sf_dir), *CUST))


@query(_emb_labels() + "SELECT cluster, count(*) AS n FROM labels GROUP BY cluster")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sizes(_cluster(spark, sf_dir))


@query(_emb_labels() + """SELECT id, cluster * 7 AS cluster, CASE WHEN cluster = 0 THEN 0 ELSE dense_rank() OVER (ORDER BY cluster = 0, cluster) END AS label FROM labels""")
def label_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.compact(_cluster(spark, sf_dir).select("id", (F.col("cluster") * 7).alias("cluster")))


@query(_emb_labels("""plotted AS (SELECT id, x, y, cluster, row_number() OVER (PARTITION BY cluster ORDER BY id) - 1 AS place, count(*) OVER (PARTITION BY cluster) AS n
    FROM labels WHERE cluster > 0)""") + "SELECT id, x, y, cluster FROM plotted WHERE n >= 10 AND place % 10 = 0 AND x BETWEEN -360 AND 360 AND y BETWEEN -25 AND 25")  # fmt: skip
def cluster_plot_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.plot_sample(_cluster(spark, sf_dir), least=10, box=(-360, 360, -25, 25))


# Partition by partition

_LOCAL = [
    "core AS (SELECT src AS id FROM pairs GROUP BY src HAVING count(*) >= 4)",
    "links AS (SELECT src AS a, dst AS b FROM pairs WHERE src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core))",
    "inner_links AS (SELECT a, b FROM links JOIN placed p ON p.id = a JOIN placed q ON q.id = b WHERE p.part = q.part)",
    "reach AS (SELECT id AS root, id FROM core UNION SELECT r.root, l.b FROM reach r JOIN inner_links l ON l.a = r.id AND l.b > r.root)",
    "local AS (SELECT id, min(root) AS local FROM reach GROUP BY id)",
    """merges AS (SELECT DISTINCT least(x.local, y.local) AS a, greatest(x.local, y.local) AS b FROM links JOIN placed p ON p.id = a JOIN placed q ON q.id = b
        JOIN local x ON x.id = a JOIN local y ON y.id = b WHERE p.part <> q.part)""",
]
_LOCAL_SQL = _with(EMB_SQL, EMB[0], *_PARTED, "placed", "pairs", *_LOCAL, recursive=True)


@query(_LOCAL_SQL + "SELECT id, part, local FROM local JOIN placed USING (id)")
def local_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbscan.partition_merges(sources.from_embeddings(spark, sf_dir), *EMB, PARTS)[0]


@query(_LOCAL_SQL + "SELECT a, b FROM merges")
def merge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbscan.partition_merges(sources.from_embeddings(spark, sf_dir), *EMB, PARTS)[1]


@query(_LOCAL_SQL + "SELECT a AS local FROM merges UNION SELECT b FROM merges")
def merge_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbscan.partition_merges(sources.from_embeddings(spark, sf_dir), *EMB, PARTS)[1].select(F.explode(F.array("a", "b")).alias("local")).distinct()


@query(_emb_labels() + "SELECT id, seed AS component FROM comp")
def merged_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbscan.merged(*dbscan.partition_merges(sources.from_embeddings(spark, sf_dir), *EMB, PARTS))


@query(
    _with(EMB_SQL, EMB[0], *_PARTED, "placed", "most AS (SELECT part, max(id % 17) AS most FROM placed GROUP BY part)")
    + "SELECT part, most, CAST(coalesce(sum(most + 1) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM most"
)
def cluster_id_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = partitioning.assign(sources.from_embeddings(spark, sf_dir), EMB[0], PARTS)
    return metrics.offsets(placed.select("part", (F.col("id") % 17).alias("cluster")))


@query(
    """WITH RECURSIVE e AS (SELECT l_orderkey AS a, l_orderkey + l_suppkey AS b FROM lineitem),
    sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    cc(id, component) USING KEY (id) AS (SELECT a, min(least(a, b)) FROM sym GROUP BY a
    UNION SELECT s.b, min(c.component) FROM cc c JOIN sym s ON s.a = c.id JOIN recurring.cc t ON t.id = s.b AND c.component < t.component GROUP BY s.b)
    SELECT id, component FROM cc"""
)
def union_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the edges that all line items make."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return connected_components(items.select(F.col("l_orderkey").alias("a"), (F.col("l_orderkey") + F.col("l_suppkey")).alias("b")))


@query(
    _with(EMB_SQL, EMB[0], "box", "dims", "celled", "hist", "cum", "edges", "parts", "band", "pairs", *_labels(EMB[1]), recursive=True)
    + "SELECT id, cx AS bin FROM labels JOIN celled USING (id) WHERE cluster = 0 AND cx IN (SELECT bin FROM band)"
)
def shadow_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise points in the bands around cuts."""
    pts = sources.from_embeddings(spark, sf_dir)
    noise = dbscan.cluster(pts, *EMB).where("cluster = 0").select("id")
    return partitioning.band_points(pts, EMB[0], PARTS).join(noise, "id", "left_semi")


@query(
    _with(EMB_SQL, EMB[0], "box", "dims", "celled", "hist", "cum", "edges", "parts", "band")
    + "SELECT DISTINCT cx, cy, min_x + CAST(0.02 AS DOUBLE) / 2.0::DOUBLE + cx * CAST(0.02 AS DOUBLE) AS rx,"
    " min_y + CAST(0.02 AS DOUBLE) / 2.0::DOUBLE + cy * CAST(0.02 AS DOUBLE) AS ry FROM celled, box WHERE cx IN (SELECT bin FROM band)"
)
def shadow_reference_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference points of the cells that hold points of the bands."""
    pts = sources.from_embeddings(spark, sf_dir)
    bins = F.broadcast(partitioning.band_bins(pts, EMB[0], PARTS).withColumnRenamed("bin", "cx"))  # four for each cut
    return neighbors.reference_points(pts, EMB[0]).join(bins, "cx", "left_semi")


@query(
    _emb_labels("boxes AS (SELECT cluster, count(*) AS n, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM labels WHERE cluster > 0 GROUP BY cluster)")
    + "SELECT boxes.*, id FROM labels JOIN boxes USING (cluster)"
)
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster's members, a row for each, with the cluster's size and bounding box."""
    found = cut(_cluster(spark, sf_dir).where("cluster > 0"))
    boxes = found.groupBy("cluster").agg(F.count("*").alias("n"), *(f(c).alias(f"{c}{f.__name__}") for c in "xy" for f in (F.min, F.max)))
    return found.select("cluster", "id").join(boxes, "cluster")


@query(_LOCAL_SQL + "SELECT part, count(DISTINCT local) AS n_clusters, max(local) AS most, count(*) AS n_core FROM local JOIN placed USING (id) GROUP BY part")
def local_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters, largest label and core points of each partition."""
    local, _ = dbscan.partition_merges(sources.from_embeddings(spark, sf_dir), *EMB, PARTS)
    return local.groupBy("part").agg(F.count_distinct("local").alias("n_clusters"), F.max("local").alias("most"), F.count("*").alias("n_core"))


@query(_with(ITEM_SQL, 1.0, "box", "dims", "celled") + "SELECT DISTINCT cell, row_number() OVER (ORDER BY cell) - 1 AS place FROM (SELECT DISTINCT cell FROM celled)")
def cell_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that hold points in ascending order, with their places."""
    found = grid.cells(sources.from_lineitem(spark, sf_dir), 1.0).select("cell")
    return ordinal(found, "cell", "place").select("cell", (F.col("place") - 1).alias("place"))


@query(_emb_labels() + "SELECT row_number() OVER (ORDER BY id) - 1 AS place, cluster FROM labels")
def labels_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written as text, one line each in the order of ids, and read back."""
    path = shared_folder(spark, "labels")
    _cluster(spark, sf_dir).orderBy("id").select("cluster", "role").write.csv(path)
    return sources.read_labels(spark, path)


# Two clusterings

_TWO = _with(
    EMB_SQL, EMB[0], "pairs", *_labels(EMB[1]),
    "pairs2 AS (SELECT a.id AS src, b.id AS dst FROM pts a JOIN pts b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.03)",
    *_labels(WIDE[1], to="2"), "tab AS (SELECT a.cluster AS c1, b.cluster AS c2, count(*) AS n FROM labels a JOIN labels2 b USING (id) GROUP BY ALL)", recursive=True,
)


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _cluster(spark, sf_dir), _cluster(spark, sf_dir, *WIDE)


@query(_TWO + "SELECT * FROM tab")
def cluster_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.contingency(*_two(spark, sf_dir))


@query(
    _TWO
    + """SELECT round(sum(CASE WHEN c1 = 0 AND c2 = 0 THEN n WHEN c1 = 0 OR c2 = 0 THEN 0 ELSE n * (n / CAST(n1 + n2 - n AS DOUBLE)) END) / sum(n), 9) AS score
    FROM tab JOIN (SELECT c1, sum(n) AS n1 FROM tab GROUP BY c1) USING (c1) JOIN (SELECT c2, sum(n) AS n2 FROM tab GROUP BY c2) USING (c2)"""
)
def cluster_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.similarity(*_two(spark, sf_dir)).select(F.round("score", 9).alias("score"))


@query(
    _TWO
    + "SELECT CAST(coalesce(sum(n) FILTER ((c1 = 0) <> (c2 = 0)), 0) AS BIGINT) AS noise_mismatch, CAST(coalesce(sum(n) FILTER (c1 = 0 AND c2 = 0), 0) AS BIGINT) AS noise_agree FROM tab"
)
def noise_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.similarity(*_two(spark, sf_dir)).select("noise_mismatch", "noise_agree")


# Orders, sources and sinks


@query(
    _with(EVENTS_SQL, 1.0, "sampled AS (SELECT x, y FROM pts WHERE id % 100 = 0)")
    + """SELECT dim, round(variance, 6) AS variance, CAST(row_number() OVER (ORDER BY variance DESC, dim) AS INTEGER) AS place
    FROM (SELECT 'x' AS dim, var_pop(x) AS variance FROM sampled UNION ALL SELECT 'y', var_pop(y) FROM sampled)"""
)
def dim_variance_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimates.variance_order(sources.from_events(spark, sf_dir), 100).withColumn("variance", F.round("variance", 6))


@query(
    _with(CUST_SQL, 1.0, "b AS (SELECT id, CAST(ceil(x / 180.0::DOUBLE * 180.0::DOUBLE) AS BIGINT) AS bin_x, CAST(ceil(y / 360.0::DOUBLE * 360.0::DOUBLE) AS BIGINT) AS bin_y FROM pts)")
    + "SELECT *, row_number() OVER (ORDER BY bin_x, bin_y, id) AS place FROM b"
)
def degree_bin_sort_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    bx, by = geometry.degree_bins(F.col("x"), F.col("y"))
    found = sources.from_customers(spark, sf_dir).select("id", bx.alias("bin_x"), by.alias("bin_y"))
    return ordinal(found, ["bin_x", "bin_y", "id"], "place")


@query(
    _with(CUST_SQL, 1.0, "k AS (SELECT id, CAST(trunc(x) AS BIGINT) AS key_x, CAST(trunc(y) AS BIGINT) AS key_y FROM pts)")
    + "SELECT *, row_number() OVER (ORDER BY key_x, key_y, id) AS place FROM k"
)
def truncated_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sources.from_customers(spark, sf_dir).select("id", F.col("x").cast("long").alias("key_x"), F.col("y").cast("long").alias("key_y"))
    return ordinal(found, ["key_x", "key_y", "id"], "place")


@query(_with(EMB_SQL, 0.2, "box", "dims", "celled") + "SELECT cx, cy, id, row_number() OVER (PARTITION BY cx, cy ORDER BY x, id) AS place FROM celled")
def sort_in_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    celled = grid.with_cells(sources.from_embeddings(spark, sf_dir), 0.2)
    place = F.row_number().over(Window.partitionBy("cx", "cy").orderBy("x", "id"))
    return celled.select("cx", "cy", "id", place.cast("long").alias("place"))


@query(_with(CUST_SQL, 1.0) + "SELECT id, round(y * pi() / 180.0, 9) AS radians FROM pts")
def degrees_to_radians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.from_customers(spark, sf_dir).select("id", F.round(geometry.radians(F.col("y")), 9).alias("radians"))


@query(_with(CUST_SQL, 1.0) + "SELECT id, x, y FROM pts WHERE id % 10 = 0")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimates.every(sources.from_customers(spark, sf_dir), 10)


@query(_with(CUST_SQL, 1.0) + "SELECT row_number() OVER (ORDER BY id) - 1 AS id, x, y FROM pts")
def csv_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written as text in the order of ids, and read back."""
    path = shared_folder(spark, "points")
    sources.from_customers(spark, sf_dir).orderBy("id").select("x", "y").write.csv(path)
    return sources.read_csv(spark, path)


@query(
    """SELECT true AS timed, 'embeddings' AS dataset, '0.02' AS eps, '4' AS min_pts, 'auto' AS dense_cells, true AS parted, n_labels, printf('%.3e', noise_fraction) AS noise_fraction FROM ("""
    + _emb_labels() + _SUMMARY + ")"
)
def stats_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of figures that a run appends, read back."""
    path = f"{shared_folder(spark, 'stats')}/{uuid.uuid4().hex}"
    began = time.perf_counter()
    summary = cut(metrics.summary(_cluster(spark, sf_dir)))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sinks.append_stats(summary, path, time.perf_counter() - began, partitions, dataset="embeddings", eps=EMB[0], min_pts=EMB[1], dense_cells="auto")
    line = spark.read.schema("seconds double, dataset string, eps string, min_pts string, dense_cells string, partitions int, n_labels long, noise_fraction string").csv(path)
    timed, parted = (F.col("seconds") > 0).alias("timed"), (F.col("partitions") > 0).alias("parted")
    return line.select(timed, "dataset", "eps", "min_pts", "dense_cells", parted, "n_labels", "noise_fraction")


@query()
def stage_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of a clustering, with seconds and rows."""
    with traced() as steps:
        _cluster(spark, sf_dir)
    return spark.createDataFrame([(n, s.what, s.seconds, s.rows) for n, s in enumerate(steps, 1)], "place int, what string, seconds double, n_rows long")


@query("SELECT 10000 AS n, 10000 AS ids, true AS inside, true AS spread")
def synthetic_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated points: how many, whether all lie in the box, and whether each tenth of both axes has its share."""
    pts = sources.uniform(spark, 10_000)
    inside = F.min((F.col("x") >= 0) & (F.col("x") < 360) & (F.col("y") >= -90) & (F.col("y") < 90)).alias("inside")
    tenths = [F.count_if((F.col("x") >= 36 * k) & (F.col("x") < 36 * (k + 1))) for k in range(10)]
    tenths += [F.count_if((F.col("y") >= 18 * k - 90) & (F.col("y") < 18 * k - 72)) for k in range(10)]
    spread = (F.least(*tenths).between(800, 1200) & F.greatest(*tenths).between(800, 1200)).alias("spread")
    return pts.agg(F.count("*").cast("int").alias("n"), F.count_distinct("id").cast("int").alias("ids"), inside, spread)


@query("SELECT o_orderkey AS key, CAST(sum(o_custkey) OVER (ORDER BY o_orderkey) AS BIGINT) AS total FROM orders")
def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").cast("long").alias("n"))
    return running_sum(rows, "key", "n", "total").select("key", "total")


@query(
    _with(EVENTS_SQL, 1.0, "sampled AS (SELECT x, y FROM pts WHERE id % 100 = 0)", "turned AS (SELECT var_pop(y) > var_pop(x) AS t FROM sampled)")
    + "SELECT id, CASE WHEN t THEN y ELSE x END AS d1, CASE WHEN t THEN x ELSE y END AS d2 FROM pts, turned"
)
def dims_permuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimates.permuted(sources.from_events(spark, sf_dir), 100)


@query(
    _emb_labels("arrivals AS (SELECT id, x + 0.01::DOUBLE AS x, y FROM pts)")
    + """SELECT a.id, a.x, a.y, CAST(coalesce(min(l.cluster), 0) AS INTEGER) AS cluster FROM arrivals a LEFT JOIN labels l ON l.is_core
    AND sqrt((a.x - l.x) * (a.x - l.x) + (a.y - l.y) * (a.y - l.y)) <= 0.02 GROUP BY a.id, a.x, a.y"""
)
def label_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that arrive in a stream after a clustering, a little to the right of those that were clustered."""
    folder = shared_folder(spark, "arrivals")
    pts = sources.from_embeddings(spark, sf_dir)
    labels = cut(dbscan.cluster(pts, *EMB))
    moved = pts.select("id", (F.col("x") + F.lit(0.01)).alias("x"), "y", F.lit("2024-01-01").cast("timestamp").alias("ts"))
    moved.repartition(4).write.parquet(f"{folder}/in")
    stream = streaming.read_points(spark, f"{folder}/in", files_a_batch=2)
    streaming.label_arrivals(stream, labels, EMB[0], f"{folder}/out", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("id long, x double, y double, cluster int").parquet(f"{folder}/out").select("id", "x", "y", "cluster")
