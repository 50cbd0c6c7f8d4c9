"""The engine against hand-made labels, brute force and itself."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from densika.operators import dbscan, dense, grid, metrics, neighbors, partitioning
from densika.operators.components import connected_components
from densika.operators.lineage import shared_folder, traced
from densika.operators.ordered import ordinal, running_sum
from densika.plans import estimates
from densika.queries import QUERIES
from densika.sources import points as sources
from densika.sources import sinks
from densika.streaming import points as streaming

BLOB = [(0, 0), (0, 1), (1, 0), (1, 1)]
WINGS = [(-1, 0), (-1.5, 0), (-1.5, 0.5), (-1.5, -0.5), (1, 0), (1.5, 0), (1.5, 0.5), (1.5, -0.5)]
#: name: points, eps, min_pts, canonical labels, scan labels
MICRO = {
    "chain": ([(0, 0), (1, 0), (2, 0), (3, 0)], 1, 3, [1, 1, 1, 1], [0, 1, 1, 1]),
    "blobs": (BLOB + [(x + 10, y + 10) for x, y in BLOB] + [(5, 5)], 1.5, 3, [1] * 4 + [2] * 4 + [0], [1] * 4 + [2] * 4 + [0]),
    "exactly eps": ([(0, 0), (3, 4)], 5, 2, [1, 1], [1, 1]),
    "below eps": ([(0, 0), (3, 4)], 4.999, 2, [0, 0], [0, 0]),
    "duplicates": ([(1, 1)] * 3, 0.1, 3, [1, 1, 1], [1, 1, 1]),
    "bridge last": ([*WINGS, (0, 0)], 1, 4, [1] * 4 + [2] * 4 + [1], [1] * 4 + [2] * 4 + [1]),
    "bridge first": ([(0, 0), *WINGS], 1, 4, [1] + [1] * 4 + [2] * 4, [0] + [1] * 4 + [2] * 4),
    "noise": ([(0, 0), (5, 5), (-7, 3)], 1, 2, [0, 0, 0], [0, 0, 0]),
    "single": ([(2, 3)], 1, 1, [1], [1]),
    "negative": ([(-0.1, 0), (0.1, 0), (-0.1, -0.2), (0.1, -0.2)], 0.25, 3, [1] * 4, [1] * 4),
    "empty": ([], 1, 1, [], []),
}


def frame(spark, points):
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)], "id long, x double, y double")


def brute(points, eps, min_pts, border="canonical"):
    near = [[j for j, q in enumerate(points) if math.sqrt((p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1])) <= eps] for p in points]
    core = [len(n) >= min_pts for n in near]
    seed = {}
    for k in range(len(points)):
        if core[k] and k not in seed:
            todo = [k]
            while todo:
                p = todo.pop()
                if p not in seed:
                    seed[p] = k
                    todo += [q for q in near[p] if core[q] and q not in seed]
    rank = {s: r for r, s in enumerate(sorted(set(seed.values())), 1)}
    out = []
    for k in range(len(points)):
        own = [seed[q] for q in near[k] if core[q]]
        s = seed.get(k, min(own, default=None))
        out.append(0 if s is None or (border == "scan" and not core[k] and s > k) else rank[s])
    return out


def labels_of(df):
    return [r["cluster"] for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("name", MICRO)
@pytest.mark.parametrize("dense_cells", [False, True])
def test_micro(spark, name, dense_cells):
    points, eps, min_pts, canonical, scan = MICRO[name]
    for border, expected in (("canonical", canonical), ("scan", scan)):
        assert labels_of(dbscan.cluster(frame(spark, points), eps, min_pts, border=border, dense_cells=dense_cells)) == expected


@pytest.mark.parametrize("seed", range(3))
def test_random_points(spark, seed):
    rng = random.Random(seed)
    centres = [(rng.uniform(-3, 3), rng.uniform(-3, 3)) for _ in range(4)]
    points = [(rng.gauss(c[0], 0.25), rng.gauss(c[1], 0.25)) for c in centres for _ in range(40)] + [(rng.uniform(-4, 4), rng.uniform(-4, 4)) for _ in range(60)]
    df = frame(spark, points)
    for eps, min_pts in ((0.2, 4), (0.6, 6)):
        expected = brute(points, eps, min_pts)
        for how in ({"dense_cells": False}, {"dense_cells": True}, {"dense_cells": "auto"}):
            assert labels_of(dbscan.cluster(df, eps, min_pts, **how)) == expected
        assert labels_of(dbscan.cluster(df, eps, min_pts, border="scan")) == brute(points, eps, min_pts, "scan")
        assert sorted(map(tuple, neighbors.pairs(df, eps).collect())) == sorted(map(tuple, neighbors.pairs_brute(df, eps).collect()))


def test_merged_partitions_are_the_whole(spark):
    rng = random.Random(7)
    points = [(rng.uniform(0, 4), rng.uniform(0, 1)) for _ in range(250)]
    df = frame(spark, points)
    expected = {(r["id"], r["component"]) for r in dbscan.core_components(df, 0.2, 4).collect()}
    for parts in (1, 2, 5):
        local, merges = dbscan.partition_merges(df, 0.2, 4, parts)
        assert {(r["id"], r["component"]) for r in dbscan.merged(local, merges).collect()} == expected


def test_bad_arguments(spark):
    df = frame(spark, [(0, 0)])
    for how in ({"border": "other"}, {"eps": 0}, {"min_pts": 0}):
        with pytest.raises(ValueError):
            dbscan.cluster(df, **{"eps": 1.0, "min_pts": 1, **how})


def test_nulls_and_nans_are_dropped_whole(spark):
    rows = [(0, 0.0, 0.0), (1, None, 1.0), (2, float("nan"), 0.0), (None, 0.0, 0.0), (4, 0.0, 0.5)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    assert {(r["id"], r["cluster"]) for r in dbscan.cluster(df, 1.0, 2).collect()} == {(0, 1), (4, 1)}


def test_dense_cells_hold_core_points_only(spark):
    rng = random.Random(3)
    df = frame(spark, [(rng.gauss(0, 0.3), rng.gauss(0, 0.3)) for _ in range(200)])
    core = {r["id"] for r in neighbors.core_points(df, 0.3, 5).collect()}
    inside = {r["id"] for r in dense.dense_points(df, 0.3, 5).collect()}
    outside = {r["id"] for r in dense.query_points(df, 0.3, 5).collect()}
    assert inside <= core and not inside & outside and len(inside | outside) == 200


@pytest.mark.parametrize("local_edges", [0, 10_000])
def test_components(spark, local_edges):
    rng = random.Random(11)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, 5000), (0, 10**12)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")
    assert {(r["id"], r["component"]) for r in connected_components(df, local_edges=local_edges).collect()} == {(x, root(x)) for x in parent}
    assert connected_components(df.limit(0), local_edges=local_edges).count() == 0


def test_running_sums_cross_blocks(spark):
    keys = [5, 70_000, 70_001, 200_000, -3]
    df = spark.createDataFrame([(k, 2) for k in keys], "k long, v long")
    assert {(r["k"], r["s"]) for r in running_sum(df, "k", "v", "s").collect()} == {(k, 2 * (i + 1)) for i, k in enumerate(sorted(keys))}
    assert {(r["k"], r["p"]) for r in ordinal(df, "k", "p").collect()} == {(k, i + 1) for i, k in enumerate(sorted(keys))}
    assert ordinal(df.limit(0), "k", "p").count() == 0


def test_ordinals_of_sparse_keys_have_no_single_task(spark):
    """Hashed ids, alone, by group, and with ties that a second column tells apart."""
    df = spark.range(5000).select(F.xxhash64("id").alias("k"), (F.col("id") % 3).alias("g"), (F.col("id") % 50).alias("t"))
    rows = df.collect()
    found = ordinal(df, "k", "p")
    assert [r["k"] for r in found.orderBy("p").collect()] == sorted(r["k"] for r in rows)
    assert not any("SinglePartition" in line for line in found._jdf.queryExecution().toString().splitlines())
    assert [(r["t"], r["k"]) for r in ordinal(df, ["t", "k"], "p").orderBy("p").collect()] == sorted((r["t"], r["k"]) for r in rows)
    for g in range(3):
        own = ordinal(df, "k", "p", ("g",)).where(F.col("g") == g).orderBy("p").collect()
        assert [(r["p"], r["k"]) for r in own] == list(enumerate(sorted(r["k"] for r in rows if r["g"] == g), 1))


def test_partitions_cover_the_points(spark):
    rng = random.Random(5)
    points = [(rng.expovariate(1), rng.random()) for _ in range(400)] + [(0.5, 0.5)] * 300
    df = frame(spark, points)
    for parts in (1, 3, 8):
        rows = partitioning.as_rows(partitioning.bounds(df, 0.1, parts)).orderBy("part").collect()
        assert len(rows) == parts and rows[0]["lo_bin"] == 0
        assert all(a["hi_bin"] == b["lo_bin"] for a, b in itertools.pairwise(rows))
        placed = partitioning.assign(df, 0.1, parts)
        bounds = {r["part"]: (r["lo_bin"], r["hi_bin"]) for r in rows}
        assert all(bounds[r["part"]][0] <= r["bin"] < bounds[r["part"]][1] for r in placed.collect()) and placed.count() == 700


def test_similarity(spark):
    a = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 0), (4, 0)], "id long, cluster int")
    b = spark.createDataFrame([(0, 5), (1, 5), (2, 5), (3, 0), (4, 1)], "id long, cluster int")
    same, other = metrics.similarity(a, a).first(), metrics.similarity(a, b).first()
    assert same["score"] == 1.0 and same["noise_agree"] == 2
    assert other["score"] == pytest.approx((2 / 3 + 2 / 3 + 1 / 3 + 1 + 0) / 5) and (other["noise_mismatch"], other["noise_agree"]) == (1, 1)


def test_summary_of_nothing(spark):
    row = metrics.summary(spark.createDataFrame([], "id long, cluster int")).first()
    assert (row["n_points"], row["n_labels"], row["n_clusters"], row["n_noise"], row["noise_fraction"]) == (0, 0, 0, 0, None)


def test_csv(spark, tmp_path):
    path = tmp_path / "points.csv"
    path.write_text("1,2\nnan,3\n4,\n5, 6\nx,7\n1,2,3\n\n-8e1,9\n")
    rows = [tuple(r) for r in sources.read_csv(spark, str(path)).orderBy("id").collect()]
    assert rows == [(0, 1.0, 2.0), (1, 5.0, 6.0), (2, -80.0, 9.0)]
    with pytest.raises(Exception, match="two numbers"):
        sources.read_csv(spark, str(path), bad_rows="fail").collect()
    labels = tmp_path / "labels.txt"
    labels.write_text("3,x\n0\n-1,7\n")
    assert [tuple(r) for r in sources.read_labels(spark, str(labels)).orderBy("place").collect()] == [(0, 3), (1, 0), (2, -1)]


def test_places_in_many_files_and_splits(spark, tmp_path):
    """Ids follow files and lines, however files of different sizes are split and dealt to tasks."""
    folder, n = tmp_path / "many", 0
    folder.mkdir()
    for k, size in enumerate((3000, 10, 40_000, 0, 700)):
        (folder / f"part-{k}.txt").write_text("".join(f"{n + i},{k}\n" for i in range(size)) + "junk,\n" * k)
        n += size
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        points = sources.read_csv(spark, str(folder))
        assert points.rdd.getNumPartitions() > 3 and points.count() == n
        assert points.where("id <> CAST(x AS long)").count() == 0
        lines = "".join(p.read_text() for p in sorted(folder.iterdir())).splitlines()
        labels = sources.read_labels(spark, str(folder)).orderBy("place").collect()
        assert [tuple(r) for r in labels] == [(i, None if x.startswith("junk") else int(x.split(",")[0])) for i, x in enumerate(lines)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sources.read_csv(spark, str(folder / "part-3.txt")).count() == 0


def test_sinks(spark, tmp_path):
    labels = dbscan.cluster(frame(spark, MICRO["blobs"][0]), 1.5, 3)
    for _ in range(2):
        sinks.append_stats(metrics.summary(labels), str(tmp_path / "stats"), 12.5, 4, eps=1.5)
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "stats")).collect()] == [("12.5000", "1.5", "4", "3", "1.111e-01")] * 2
    sinks.write_plot_sample(labels, str(tmp_path / "plot"), least=1, every=2, box=(-100, 100, -100, 100))
    assert sorted(int(r["id"]) for r in spark.read.option("header", True).csv(str(tmp_path / "plot")).collect()) == [0, 2, 4, 6]
    sinks.write_labels(labels, str(tmp_path / "labels"))
    assert spark.read.parquet(str(tmp_path / "labels")).count() == 9


def test_range_join_is_an_equi_join(spark):
    names = estimates.operators_of(neighbors.pairs(frame(spark, BLOB), 1.0))
    assert not any("Cartesian" in n or "NestedLoop" in n for n in names)
    assert any("Join" in n for n in names)
    assert not any("BroadcastNestedLoop" in n for n in names)
    with pytest.raises(ValueError, match="pairs"):
        neighbors.pairs_brute(spark.range(neighbors.BRUTE_POINTS + 1).selectExpr("id", "0.0 AS x", "0.0 AS y"), 1.0)


def test_brute_pairs_of_more_points_than_the_guard(spark, tmp_path):
    n = neighbors.BRUTE_POINTS + 1
    spark.range(n).selectExpr("id AS vec_id", "array(floor(id / 3) * 0.05F, 0.0F) AS embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["eps_pairs_brute"](spark, str(tmp_path)).agg(F.count("*"), F.min("src"), F.max("dst"), F.count_if(F.expr("src DIV 3 = dst DIV 3")))
    assert tuple(found.first()) == (3 * n, 0, n - 1, 3 * n)


def test_brute_pairs_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_POINTS", 7)
    monkeypatch.setattr(neighbors, "STRIP_POINTS", 2)
    rng = random.Random(5)
    rows = [(k, rng.uniform(0, 3), rng.uniform(0, 3)) for k in range(60)] + [(None, 1.0, 1.0), (7, 1.0, 1.5), (100, 1.0, 1.5), (100, 1.0, 1.5)]
    odd = [(200, None, 1.0), (201, 1.0, None), (202, math.nan, 1.0), (203, math.inf, 1.0), (204, math.inf, 1.0), (205, -math.inf, 1e308), (None, None, None)]
    df = spark.createDataFrame(rows + odd, "id long, x double, y double").repartition(3)
    expected = [(a, b) for a, ax, ay in rows for b, bx, by in rows if math.sqrt((ax - bx) ** 2 + (ay - by) ** 2) <= 0.5]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    for most in (100, None):
        assert sorted(map(key, neighbors.pairs_brute(df, 0.5, most).collect())) == sorted(map(key, expected))
    assert neighbors.pairs_brute(df.limit(0), 0.5, None).collect() == []


def test_estimates_choose_partitions(spark, monkeypatch):
    assert [estimates.sampling_step(n) for n in (10, 2_000_000, 2_000_001, 50_000_000)] == [100, 100, 51, 1250]
    points = frame(spark, [(0.001 * k, 0.0) for k in range(1000)])
    row = estimates.pair_estimate(points, 2.0).first()
    assert (row["n_points"], row["step"], row["sampled"], row["estimate"], row["of_references"], row["planned"]) == (1000, 100, 10_000, 10**6, 2_250_000, 1_250_000)
    assert estimates.shuffle_partitions(points, 2.0) == 8
    monkeypatch.setattr(estimates, "PARTITION_BYTES", 1 << 20)
    assert estimates.shuffle_partitions(points, 2.0) == 29
    some = dbscan.cluster(points, 0.0015, 3, partitions="auto").collect()
    assert sorted(some) == sorted(dbscan.cluster(points, 0.0015, 3).collect()) == sorted(dbscan.cluster(points, 0.0015, 3, partitions=3, dense_cells=True).collect())


def test_saved_index_isnt_shuffled(spark):
    points = frame(spark, [(random.Random(k).random() * 9, k % 7 + 0.5) for k in range(300)])
    sinks.save_index(points, "index_of_points", 1.0, buckets=4)
    try:
        index = sinks.load_index(spark, "index_of_points", 1.0)
        found = neighbors.indexed_counts(points, index, 1.0)
        assert sorted(found.collect()) == sorted(neighbors.neighbor_counts(points, 1.0).collect())
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        names = estimates.operators_of(neighbors.range_join(points, index, 1.0, ["id"], ["id dst"], indexed=True))
        assert sum("Exchange" in n for n in names) == 1
        with pytest.raises(ValueError, match="radius"):
            sinks.load_index(spark, "index_of_points", 2.0)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE index_of_points")


def test_stages_are_traced(spark, caplog):
    with caplog.at_level("INFO", "densika"), traced() as steps:
        labels = dbscan.cluster(frame(spark, MICRO["blobs"][0]), 1.5, 3)
    assert labels.count() == 9 and next(s.rows for s in steps if s.what == "core points") == 9
    assert all(s.seconds > 0 for s in steps) and len({s.what for s in steps}) >= 4 and len(caplog.records) == len(steps)


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    class Session:
        class sparkContext:  # noqa: N801
            @staticmethod
            def getConf():
                return {"spark.master": "spark://somewhere:7077"}

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session, "x")
    assert shared_folder(spark, "x") != shared_folder(spark, "x")


def test_uniform(spark):
    r = sources.uniform(spark, 2000).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    assert 0 <= r[0] < r[1] < 360 and -90 <= r[2] < r[3] < 90 and r[4] == 2000


def test_grid_of_nothing(spark):
    empty = frame(spark, [])
    assert grid.x_histogram(empty, 1.0).count() == 0 and grid.cells(empty, 1.0).count() == 0


def test_streams(spark, tmp_path):
    points = frame(spark, MICRO["blobs"][0])
    labels = dbscan.cluster(points, 1.5, 3)
    stamped = points.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60))
    stamped.write.parquet(str(tmp_path / "in"))
    stream = streaming.read_points(spark, str(tmp_path / "in"))
    run = streaming.label_arrivals(stream, labels, 1.5, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    arrived = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["id"], r["cluster"]) for r in arrived) == sorted((r["id"], r["cluster"]) for r in labels.collect())
    run = streaming.cell_counts(stream, 5.0).writeStream.format("memory").outputMode("complete").queryName("counted").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted((r["cx"], r["cy"], r["n"]) for r in spark.table("counted").collect()) == [(0, 0, 4), (1, 1, 1), (2, 2, 4)]
