"""MinHash near-duplicates with sequential Bayesian verification (operator 4).

A document's set holds its distinct word shingles. Documents with equal sets are one class, known by its smallest id, so
groups of exact copies cost one row each: classes are aggregated in each task first, and a copy's class comes back by a join
of narrow rows, whose hot digests are left to AQE's skew join (so nothing is aggregated in the stage of that join). Classes
are banded by MinHash: BANDS bands of BAND_ROWS minima, which miss a pair of similarity 0.8 with a probability of 6e-5, of
0.85 with 8e-7. In a bucket, every class belongs to the cluster of the bucket's smallest class, its pivot; two classes that
share a bucket share a pivot, so all candidate pairs lie within clusters and a class travels once for each pivot, not for
each band.

Within a cluster, candidates are compared by batches of their signatures. After each batch a pair is dropped if its
similarity reaches the threshold only with a posterior probability under ``miss`` (uniform prior), or if the two sets'
sizes rule it out. Survivors that aren't connected yet are verified on their full sets, and only links of a spanning
forest leave the cluster. Clusters over BLOCK_CLASSES or BLOCK_SHINGLES are split into blocks by a hash of the class. First
each block is compared with itself and the pivot, which connects a cluster of near copies at a cost that grows with its
size; then those of its classes that aren't in its largest component yet, if any, are compared with all others, block by
block. So memory is bounded and no pair is lost. Connected components are found by an iterated join; no links, components
or sets reach the driver. A second scan of the texts makes the sets of those classes that have a pivot; a bitmap, sized by
their number up to BITMAP_BITS, tells nearly all others apart first.

Defined results: null and empty texts, and those without words, have an empty set and are linked with nothing; texts
with fewer words than a shingle have one shingle, all of them; a row without an id has no component and isn't kept; rows
that share an id are one document, linked with whatever any of them is; texts of any length are taken whole; an empty
table gives an empty table; only id and text are read. Shingles are known by 64-bit hashes, sets by 128-bit hashes.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densika.llm.common import LOWER, cut, map_batches, mixed, remembered
from densika.operators.components import connected_components

BANDS, BAND_ROWS = 24, 5
HASHES = BANDS * BAND_ROWS
#: A pair is dropped when its posterior probability of being similar falls under this, looked at after every BATCH hashes.
MISS, BATCH = 1e-6, 24
BLOCK_CLASSES, BLOCK_SHINGLES = 2048, 4 << 20
BITMAP_BITS = 1 << 28
MEMO_WORDS = 500_000
U = np.uint64
_random = np.random.default_rng(20240229)
MULTIPLY = _random.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1)
ADD = _random.integers(0, 1 << 32, HASHES, np.uint32)


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(data: bytes | None, width: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    words = (data or b"").translate(LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, U)
    h = np.fromiter(map(remembered("shingle words", Words).__getitem__, words), U, n)
    span = min(width, n)
    out = np.full(n - span + 1, span, U)
    for k in range(span):
        out = mixed(out * U(0xD6E8FEB86659FD93) + h[k : k + len(out)])
    return np.unique(out)


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """The minima of HASHES hash functions over a set that isn't empty."""
    h = (shingle_set >> U(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 4096):
        np.minimum(out, (MULTIPLY[:, None] * h[None, at : at + 4096] + ADD[:, None]).min(1), out=out)
    return out


def band_keys(sign: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=U)
    for column in sign.reshape(BANDS, BAND_ROWS).T:
        key = mixed(key * U(0xD6E8FEB86659FD93) + column.astype(U))
    return key.view(np.int64)


def bitmap_positions(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(ids.astype(np.int64).view(U)) % U(bits)).astype(np.int64)


@cache
def least_matches(percent: int, miss: float) -> tuple[int, ...]:
    """By batch, the fewest matching hashes with which a pair may still reach the threshold.

    With a uniform prior the similarity after m matches of n is Beta(m + 1, n - m + 1); its upper tail at t is the lower
    tail of a binomial with n + 1 trials, P(X <= m).
    """
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, least = 0.0, 0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                least = m
                break
        out.append(least)
    return tuple(out)


def links(ids: np.ndarray, sets: list[np.ndarray], signs: np.ndarray, side: np.ndarray, label: np.ndarray, percent: int, miss: float) -> list[tuple[int, int]]:
    """A spanning forest of the links among the classes; of two sides only pairs across, of one side all pairs.

    Classes with the same label are connected already.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, starts = np.unique(np.concatenate(sets), return_inverse=True)[1], np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mark = np.zeros(int(flat.max(initial=-1)) + 1, bool)
    least = least_matches(percent, miss)
    found = []
    two = side.any() and not side.all()
    label = label.copy()
    for i in range(n):
        may = label != label[i]
        may[: i + 1] = False
        if two:
            may &= side != side[i]
        small, large = np.minimum(sizes, sizes[i]), np.maximum(sizes, sizes[i])
        live = np.flatnonzero(may & (100 * small >= percent * large))
        matches = np.zeros(len(live), np.int64)
        for k, bound in enumerate(least):
            if not len(live):
                break
            part = slice(k * BATCH, (k + 1) * BATCH)
            matches = matches + (signs[live, part] == signs[i, part]).sum(1)
            ok = matches >= bound
            live, matches = live[ok], matches[ok]
        if not len(live):
            continue
        mark[flat[starts[i] : starts[i] + sizes[i]]] = True
        for j in live[np.argsort(-matches, kind="stable")].tolist():
            if label[i] == label[j]:
                continue
            both = int(mark[flat[starts[j] : starts[j] + sizes[j]]].sum())
            if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                label[label == label[j]] = label[i]
                found.append((int(ids[i]), int(ids[j])))
        mark[flat[starts[i] : starts[i] + sizes[i]]] = False
    return found


PROFILE = "id long, n long, digest binary, keys array<long>"


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """Each row's set size, set digest and band keys; null digest and keys for empty sets."""

    def batch(rows: dict[str, list]) -> dict[str, object]:
        n, digests, keys = [], [], []
        for data in rows["text"]:
            own = shingles(data, width)
            n.append(len(own))
            digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
            keys.append(band_keys(signature(own)) if len(own) else None)
        return {
            "id": pa.array(rows["id"], pa.int64()), "n": pa.array(n, pa.int64()),
            "digest": pa.array(digests, pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64())),
        }

    return map_batches(docs, PROFILE, batch)


def bitmap(ids: DataFrame, size: int) -> np.ndarray:
    """A bitmap of so many bits in which every id of the table has its bit."""

    def batch(rows: dict[str, list]) -> dict[str, object]:
        at = np.unique(bitmap_positions(np.array(rows["id"], np.int64), size))
        return {"word": pa.array(at >> 5), "bits": pa.array(np.int64(1) << (at & 31))}

    words = map_batches(ids.select("id"), "word long, bits long", batch).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 32, "<u4")
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype("<u4")
    return out.view(np.uint8)


def sets_of(docs: DataFrame, ids: DataFrame, width: int, size: int) -> DataFrame:
    """The sets and signatures of the rows whose id the table ids has."""
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(ids, size))

    def batch(rows: dict[str, list]) -> dict[str, object]:
        bits = wanted.value
        own = np.array([-1 if i is None else i for i in rows["id"]], np.int64)
        at = bitmap_positions(own, size)
        keep = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))
        out = [(rows["id"][k], s) for k in keep.tolist() if rows["id"][k] is not None and len(s := shingles(rows["text"][k], width))]
        return {
            "id": pa.array([i for i, _ in out], pa.int64()), "n": pa.array([len(s) for _, s in out], pa.int64()),
            "set": pa.array([s.tobytes() for _, s in out], pa.binary()),
            "sign": pa.array([signature(s).tobytes() for _, s in out], pa.binary()),
        }

    return map_batches(docs, "id long, n long, set binary, sign binary", batch)


def clusters(classes: DataFrame) -> DataFrame:
    """pivot, id, n: the members of each pivot's cluster, itself included; classes has id, n and keys."""
    keyed = classes.select("id", "n", F.explode("keys").alias("key"))
    pivots = cut(keyed.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("other")).where("pivot <> other").select("key", "pivot"))
    return keyed.join(pivots, "key").select("pivot", "id", "n").distinct()


def split(members: DataFrame) -> DataFrame:
    """members with the number of blocks of their cluster, and which of them is their own."""
    sizes = members.groupBy("pivot").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    parts = F.greatest(F.ceil(F.col("size") / BLOCK_CLASSES), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    return members.join(sizes.select(F.col("pivot"), parts.alias("parts")), "pivot").withColumn("own", in_block(F.col("parts")))


def in_block(parts: Column) -> Column:
    return F.pmod(F.xxhash64("id", F.lit("block")), parts).cast("int")


def blocks(members: DataFrame) -> DataFrame:
    """pivot, a, b, side, id, label: each block of a cluster with itself and the pivot."""
    pivots = members.where("id = pivot AND parts > 1").select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("a"), F.col("pivot").alias("id"))
    dealt = members.select("pivot", F.col("own").alias("a"), "id").unionAll(pivots).distinct()
    return dealt.select("pivot", "a", F.lit(-1).alias("b"), F.lit(0).alias("side"), "id", F.col("id").alias("label"))


def rest_blocks(members: DataFrame, component: DataFrame) -> DataFrame:
    """pivot, a, b, side, id, label: classes of split clusters that aren't in the largest component (side 1), with all blocks.

    component has id and component; a class that isn't there is its own.
    """
    known = members.where("parts > 1").join(component.withColumnRenamed("id", "node"), F.col("id") == F.col("node"), "left")
    known = cut(known.select("pivot", "id", "n", "parts", "own", F.coalesce("component", "id").alias("label")))
    sizes = known.groupBy("pivot", "label").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    per = sizes.groupBy("pivot").agg(F.max_by("label", F.struct("size", -F.col("label"))).alias("main"), F.sum("size").alias("size"), F.sum("total").alias("total"))
    main = sizes.withColumnsRenamed({"size": "main_size", "total": "main_total"}).join(per.withColumnRenamed("main", "label"), ["pivot", "label"])
    left, total = F.col("size") - F.col("main_size"), F.col("total") - F.col("main_total")
    rest_parts = F.greatest(F.ceil(left / BLOCK_CLASSES), F.ceil(total / BLOCK_SHINGLES)).cast("int")
    main = main.where(left > 0).select("pivot", F.col("label").alias("main"), rest_parts.alias("rest_parts"))
    both = known.join(main, "pivot")
    every = F.explode(F.sequence(F.lit(0), F.col("rest_parts") - 1)).alias("b")
    whole = both.select("pivot", F.col("own").alias("a"), every, F.lit(0).alias("side"), "id", "label")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("a")
    rest = both.where("label <> main").select("pivot", every, in_block(F.col("rest_parts")).alias("b"), F.lit(1).alias("side"), "id", "label")
    return whole.unionAll(rest)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, miss: float = MISS, bitmap_bits: int = BITMAP_BITS
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: components of documents whose Jaccard similarity is percent / 100 or more."""
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    own = cut(profiles(texts, width))
    usable = own.where("id IS NOT NULL AND digest IS NOT NULL")
    classes = cut(usable.groupBy("digest").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.min("n").alias("n"), F.first("keys").alias("keys")))
    copied = classes.where("id <> last").select("digest", F.col("id").alias("class"))
    classed = usable.select("id", "digest").join(copied, "digest", "left").select("id", F.coalesce("class", "id").alias("class"))
    member = classed.groupBy("id").agg(F.min("class").alias("class"), F.max("class").alias("last"))
    torn = member.where(F.col("class") != F.col("last")).select("id", F.col("class").alias("a"))
    torn = torn.join(classed.select("id", F.col("class").alias("b")), "id").where("a <> b").select("a", "b").distinct()
    members = cut(split(clusters(classes.select("id", "n", "keys"))))
    n = members.select("id").distinct().count()
    size = min(bitmap_bits, max(1 << 16, 1 << (8 * n).bit_length()))
    sets = sets_of(texts, members.select("id").distinct(), width, size)

    def group(table: pa.Table) -> pa.Table:
        remembered("clusters")
        # Rows of one id with several texts are one class with several sets: all are compared.
        table = table.sort_by([("side", "ascending"), ("id", "ascending")])
        ids, side, label = (table[c].to_numpy() for c in ("id", "side", "label"))
        sets_ = [np.frombuffer(x.as_buffer(), U) for x in table["set"]]
        signs = np.stack([np.frombuffer(x.as_buffer(), np.uint32) for x in table["sign"]])
        found = links(ids, sets_, signs, side, label, percent, miss)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    def verified(dealt: DataFrame) -> DataFrame:
        grouped = dealt.join(sets, "id").repartition("pivot", "a", "b").groupBy("pivot", "a", "b")
        return grouped.applyInArrow(group, "a long, b long").unionAll(torn)

    found = verified(blocks(members))
    if members.where("parts > 1").limit(1).count():
        found = cut(found)
        rest = cut(rest_blocks(members, connected_components(found)))
        if rest.limit(1).count():
            found = verified(rest).unionAll(found)
    component = cut(connected_components(found).select(F.col("id").alias("class"), "component"))  # a join that can be split
    found = member.join(component, "class", "left").select(F.col("id").alias("node"), F.coalesce("component", "class").alias("component"))
    out = F.coalesce("component", "id")
    return own.select("id", "n").join(found, F.col("id") == F.col("node"), "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), out.alias("component_id"),
        F.coalesce(F.col("id") == out, F.lit(False)).alias("kept"),
    )
