"""Exact top-k search by inner product with pivot elimination (operator 6).

Vectors become integers, floor(scale * x). A few vectors that lie far apart are pivots; the distances from every vector of a
block to all pivots are a table that is computed once. By the triangle inequality |d(q, p) - d(x, p)| is at most d(q, x) for
every pivot p, and <q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2, so the largest of these differences bounds the score from above.
Candidates lie in batches of neighbours, sorted by nearest pivot and distance from it; a batch's bound takes the least
difference that its range of distances from a pivot allows. Each query scores its batches in the order of their bounds, in
rounds of 1, 2, 4, ... batches, until no bound left reaches its k-th best score: the result is exact. All queries of a round
that want the same batch are one matrix product.

Queries and candidates are dealt into blocks of bounded size by a hash of their id; each pair of a query block and a
candidate block is one group, searched in memory, and gives k rows a query. The queries are a stated set, so the work is
(queries x rows) / (block sizes) groups; no pair of rows is ever emitted but the k best of a block.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part; a query is compared
with the candidates of its own length; rows without an id take no part; of rows that share an id and a length, the one
whose vector comes first in lexicographic order counts, and a query's own id is never its candidate; ties go to the
smaller id; with fewer than k candidates all are returned; an empty table gives an empty table; only the id and vector
columns are read. Scores beyond 63 bits are cut to them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 8192
#: Pivots are chosen on the driver from so many vectors, the first ones by a hash of their id.
PIVOTS, PIVOT_SAMPLE = 32, 1024
#: Candidates of a batch, and how many scores are held before the best are chosen.
BATCH, HELD = 128, 1 << 20


def quantised(values: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * values.astype(np.float64))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each next pivot is the vector farthest from all pivots so far."""
    if not len(sample):
        return sample
    chosen = [0]
    nearest = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(n, len(sample)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (rows**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def exact_kind(x: np.ndarray, q: np.ndarray) -> type:
    """The smallest type in which all inner products of rows of x and q are exact."""
    most = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, x.shape[1])
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as integers, of vectors whose type is exact for them."""
    found = queries @ rows.T
    return found.clip(-(1 << 63), (1 << 63) - 1).astype(np.int64) if rows.dtype == object else found.astype(np.int64)


def as_exact(x: np.ndarray, kind: type) -> np.ndarray:
    """Whole numbers in that type; object for Python's integers."""
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) if kind is object else x.astype(kind)


def neighbours(table: np.ndarray, batch: int) -> list[np.ndarray]:
    """Batches of rows, sorted by their nearest pivot and the distance from it; table has the distances from all pivots."""
    if table.shape[1]:
        near = table.argmin(1)
        order = np.lexsort((table[np.arange(len(table)), near], near))
    else:
        order = np.arange(len(table))
    return [order[at : at + batch] for at in range(0, len(order), batch)]


def bounds(q: np.ndarray, x: np.ndarray, pivots: np.ndarray, batches: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores between each row of q and each batch of x."""
    squares = (q**2).sum(1)[:, None] + np.array([(x[b] ** 2).sum(1).max() for b in batches])[None]
    low = np.zeros_like(squares)
    if len(pivots):
        dq = distances(q, pivots)
        least, most = (np.array([f(table[b], 0) for b in batches]) for f in (np.min, np.max))
        for p in range(len(pivots)):
            own = dq[:, p, None]
            np.maximum(low, np.maximum(least[None, :, p] - own, own - most[None, :, p]), out=low)
        low = np.maximum(low - 1e-6 * (1 + np.sqrt(squares.max())), 0)  # more than rounding can take off a distance
    return (squares - low**2) / 2 + 1e-9 * squares + 1


def best_of(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The k best of each query among rows of query, score and id."""
    query, score, ids = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((ids, -score, query)) if score.min(initial=0) > -(1 << 63) else np.lexsort((ids, ~score, query))
    query, score, ids = query[order], score[order], ids[order]
    start = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
    return query[rank < k], score[rank < k], ids[rank < k]


def search(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, k: int, batch: int = BATCH) -> list[tuple[int, int, int, int]]:
    """The k best of each query among the candidates, with the number of candidates that were scored for it."""
    kind = exact_kind(x, q)
    exact, queries = as_exact(x, kind), as_exact(q, kind)
    table = distances(x, pivots) if len(pivots) else np.zeros((len(x), 0))
    batches = neighbours(table, batch)
    upper = bounds(q, x, pivots, batches, table)
    order = np.argsort(-upper, axis=1, kind="stable")
    sizes = np.array([len(b) for b in batches])
    worst, scored = np.full(len(q), -np.inf), np.zeros(len(q), np.int64)
    best = (np.zeros(0, np.int64),) * 3
    first, size = 0, 1
    while first < len(batches):
        asked = order[:, first : first + size]
        row, column = np.nonzero(np.take_along_axis(upper, asked, 1) >= worst[:, None])
        if not len(row):
            break
        wanted = asked[row, column]
        by = np.argsort(wanted, kind="stable")
        row, wanted = row[by], wanted[by]
        held, n = [best], 0
        for own in np.split(row, np.flatnonzero(np.diff(wanted)) + 1):
            b = wanted[n]
            n += len(own)
            own = own[upper[own, b] >= worst[own]]  # what was found in this round may do
            found = scores(queries[own], exact[batches[b]])
            scored[own] += sizes[b]
            i, j = np.nonzero((found >= worst[own][:, None]) & (q_ids[own][:, None] != ids[batches[b]][None]))
            held.append((own[i], found[i, j], ids[batches[b]][j]))
            if sum(len(h[0]) for h in held) > HELD:
                held = [best := best_of(held, k)]
                worst = worst_of(best, len(q), k)
        best = best_of(held, k)
        worst = worst_of(best, len(q), k)
        first, size = first + size, 2 * size
    return [(int(q_ids[a]), int(i), int(s), int(scored[a])) for a, s, i in zip(*best, strict=True)]


def worst_of(best: tuple[np.ndarray, ...], n: int, k: int) -> np.ndarray:
    """The k-th best score of each of n queries, as far as they have k."""
    out = np.full(n, -np.inf)
    full = np.bincount(best[0], minlength=n) == k
    ends = np.cumsum(np.bincount(best[0], minlength=n)) - 1
    out[full] = best[1][ends[full]]
    return out


def one_per_id(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In ascending order of ids; of rows that share an id, the first in lexicographic order."""
    order = np.argsort(ids, kind="stable")
    if len(ids) and (ids[order][1:] == ids[order][:-1]).any():
        order = np.lexsort([*x.T[::-1], ids])
    ids, x = ids[order], x[order]
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    return ids[first], x[first]


def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table["id"].to_numpy()
    flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids.astype(np.int64), flat.reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))


def top_k(df: DataFrame, is_query: Column, id_col: str, vector_col: str, k: int = 5, scale: float = 256.0, batch: int = BATCH, with_scored: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k other rows whose inner product with the query's vector is highest.

    is_query is an expression of df's columns. with_scored adds how many candidates of the row's block were scored for the query.
    """
    v = F.col("v")
    rows = df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<double>").alias("v"), is_query.alias("asks"))
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & usable)
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(PIVOT_SAMPLE).select("v").collect()  # a fixed number of rows
    pivots = np.zeros((0, 0))
    if sample:
        same = [r["v"] for r in sample if len(r["v"]) == len(sample[0]["v"])]
        pivots = choose_pivots(quantised(np.array(same, np.float64), scale), PIVOTS)
    n, asked = rows.agg(F.count("*"), F.count_if(F.coalesce("asks", F.lit(False)))).first()
    parts, blocks = max(1, math.ceil(n / CANDIDATE_BLOCK)), max(1, math.ceil(asked / QUERY_BLOCK))

    def dealt(what: DataFrame, own: str, own_n: int, other: str, other_n: int, asks: bool) -> DataFrame:
        """Each row once for every block of the other side."""
        return what.select(
            F.pmod(F.xxhash64("id", F.lit(own)), F.lit(own_n)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))).alias(other),
            F.size("v").alias("width"), F.lit(asks).alias("asks"), "id", "v",
        ).select("a", "b", "width", "asks", "id", "v")

    both = dealt(rows.where("asks"), "a", blocks, "b", parts, True).unionByName(dealt(rows, "b", parts, "a", blocks, False))

    def group(table: pa.Table) -> pa.Table:
        asks = table["asks"]
        ids, x = matrix(table.filter(pc.invert(asks)))
        q_ids, q = matrix(table.filter(asks))
        found: list[tuple[int, ...]] = []
        if len(ids) and len(q_ids):
            ids, x = one_per_id(ids, quantised(x, scale))
            q_ids, q = one_per_id(q_ids, quantised(q, scale))
            own = pivots if pivots.shape[1:] == x.shape[1:] else np.zeros((0, x.shape[1]))
            found = search(q_ids, q, ids, x, own, k, batch)
        columns = zip(*found, strict=True) if found else ([], [], [], [])
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score", "scored"])

    found = both.groupBy("a", "b", "width").applyInArrow(group, "query_id long, vec_id long, score long, scored long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", *(["scored"] if with_scored else []))


def brute_force(rows: Iterator[tuple[int, list[float]]], queries: set[int], k: int = 5, scale: float = 256.0) -> set[tuple[int, int, int, int]]:
    """The same result by scoring every pair; for tests."""
    ok = {i: [math.floor(scale * x) for x in v] for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in queries & set(ok):
        scored = sorted((-sum(a * b for a, b in zip(ok[q], v, strict=True)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out
