"""Suffix-array deduplication by merging Burrows-Wheeler transforms (operator 7).

Every byte of a text that a string of ``length`` bytes covers which also starts in a document with a smaller id is
removed. Strings are compared as windows of their texts.

1. Anchors. In each window one of its WINDOW substrings is the anchor, the one with the least hash, so equal windows have
   equal anchors at the same place. Windows in a row with the same anchor make a segment. Anchors are counted by bucket of
   their hash; a bitmap, sized by their number up to Limits.shared_bits, tells which ones two documents share; a second one those
   that many documents (Limits.hot) or more share. False positives of either cost time only, also where a bitmap is full.
2. Segments with a shared anchor are collected, equal ones of a task once, with the smallest id that has them; hot anchors
   are taken apart into windows, each dealt by its own hash, so an anchor that a third of all documents share meets in
   no one task.
3. In each bucket, segments that share an anchor with a different segment go into shards. A shard's windows are sorted
   as suffixes and kept as a Burrows-Wheeler transform over super-characters of two bytes, cut at depth ``length``. The
   shards' transforms are merged by refining their interleave: one stable distribution by the merged transform's symbols
   makes it right for one more super-character, and blocks of equal prefixes split where symbols differ, which gives the
   common prefixes. Blocks that last to depth ``length`` are the repeated intervals; no window is compared with another
   and no suffix is sorted again. The block's smallest id decides for each window.
4. Decisions return to the task's documents by the task's number and the bucket, and become spans; texts with spans, told
   apart by a bitmap of their rows, meet them in a join by row. Rows are known by 128 bits of id and text.

Defined results: null and empty texts have nothing to remove; texts shorter than ``length`` are kept whole; a missing id
counts as larger than all others; rows that share an id don't remove anything from one another; texts of any length are
taken whole; an empty table gives an empty table; only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densika.llm.common import cut, gave_back, lists, mixed, pack, remembered, slices, unpack

#: Substrings in a window among which the anchor is chosen; their length is ``length`` - WINDOW + 1.
WINDOW = 27
#: Bits of a bitmap for each entry, as long as it may grow.
BITS_PER_ENTRY = 12


@dataclass(frozen=True)
class Limits:
    """Sizes that bound memory; results don't depend on them."""

    hot: int = 20_000  # documents that share an anchor from which it is taken apart
    chunk: int = 1 << 20  # bytes of text whose anchors are found together
    flush: int = 8 << 20  # bytes of contents that a task collects before it passes them on
    shard: int = 1 << 16  # windows of a transform
    shared_bits: int = 1 << 29  # the largest bitmaps: of shared anchors, of hot ones, and of rows with spans
    hot_bits: int = 1 << 22
    row_bits: int = 1 << 27


LIMITS = Limits()
NO_ID = (1 << 63) - 1
U = np.uint64
LOW24 = U(0xFFFFFF)


def anchors(data: bytes, length: int) -> np.ndarray:
    """For each window, its anchor's 40-bit hash and place (24 bits). data is shorter than 16 MB."""
    k = length - WINDOW + 1
    n = len(data) - k + 1
    word = np.ndarray((len(data),), "<u8", data + bytes(8), 0, (1,)).copy()
    h = word[:n] * U(0x9E3779B97F4A7C15)
    for at in [*range(8, k - 7, 8), *([k - 8] if k % 8 else [])]:
        h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9) + word[at : at + n] * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0x94D049BB133111EB)
    h ^= h >> U(29)
    least = (h & ~LOW24) | np.arange(n, dtype=U)
    span = 1
    while span * 2 <= WINDOW:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[: len(least) - (WINDOW - span)], least[WINDOW - span :])


def pieces(texts: list[bytes | None], length: int, chunk: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts one after another in chunks; with each piece's row, start in the text, start in the chunk and windows."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def joined() -> tuple:
        sizes = np.array([len(d) for _, _, d in held])
        rows, starts = np.array([r for r, _, _ in held]), np.array([a for _, a, _ in held])
        return b"".join(d for _, _, d in held), rows, starts, np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes - length + 1

    for row, data in enumerate(texts):
        for at in range(0, max(0, len(data or b"") - length + 1), chunk):
            held.append((row, at, data[at : at + chunk + length - 1]))
            size += len(held[-1][2])
            if size >= chunk:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def segments(texts: list[bytes | None], length: int, chunk: int) -> Iterator[tuple]:
    """data, hash, row, start in the text, start and end in data of each segment, chunk by chunk."""
    for data, rows, starts, offsets, windows in pieces(texts, length, chunk):
        anchor = anchors(data, length)
        new = np.empty(len(anchor), bool)
        new[0], new[1:] = True, anchor[1:] != anchor[:-1]
        new[offsets] = True
        after = offsets + windows  # windows that reach into the next piece begin here
        new[after[after < len(new)]] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(anchor))
        piece = np.searchsorted(offsets, first, "right") - 1
        ok = first < after[piece]
        first, last, piece = first[ok], last[ok], piece[ok]
        yield data, anchor[first] >> U(24), rows[piece], starts[piece] + first - offsets[piece], first, last + length - 1


def ids_of(values: list) -> np.ndarray:
    return np.array([NO_ID if i is None else i for i in values], np.int64)


def bits_of(h: np.ndarray, size: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each hash in a bitmap of that size."""
    g = mixed(h)
    return (g & U(0xFFFFFFFF)) % size, (g >> U(32)) % size


class Bitmap:
    """One segment for each bucket of a hash's remainder."""

    def __init__(self, parts: list[bytes]):
        self.n, self.data = U(len(parts)), np.frombuffer(b"".join(parts), np.uint8)
        self.size = np.array([8 * len(x) for x in parts], U)
        self.start = np.concatenate([[U(0)], np.cumsum(self.size)[:-1]]).astype(U)

    def has(self, h: np.ndarray) -> np.ndarray:
        bucket = (h % self.n).astype(np.int64)
        base, out = self.start[bucket], np.ones(len(h), bool)
        for p in bits_of(h // self.n & U(0xFFFFFFFF), self.size[bucket]):
            at = base + p
            out &= (self.data[at >> U(3)] >> (at & U(7)).astype(np.uint8) & 1).astype(bool)
        return out

    @staticmethod
    def part(rest: np.ndarray, most: int) -> bytes:
        """The segment of some entries, of at most so many bits."""
        bits = min(most, max(64, len(rest) * BITS_PER_ENTRY // 64 * 64))
        out = np.zeros(bits, bool)
        for p in bits_of(rest, U(bits)):
            out[p] = True
        return np.packbits(out, bitorder="little").tobytes()


def part_bits(total: int, buckets: int) -> int:
    """A bucket's share of the largest bitmap; buckets are a power of two, and a word each if they are very many."""
    return max(64, total // buckets)


ANCHORS = "bucket int, hashes binary"


def count_anchors(length: int, buckets: int, limits: Limits):
    """Distinct anchors of a task by bucket, and in how many documents each is."""

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, doc = np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])
        order = np.argsort(h)
        h, doc = h[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        # an anchor with one document's id only counts as 1, however often it is there
        several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        count = np.where(several, np.maximum(np.diff(np.append(first, len(h))), 2), 1)
        h = h[first]
        bucket = (h % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rest, count = (h // U(buckets)).astype("<u4")[order], np.minimum(count, 65535).astype("<u2")[order]
        live = np.flatnonzero(np.diff(ends))
        # in a bucket hashes ascend, so their differences are small
        blobs = [pack(np.diff(rest[a:b], prepend=np.uint32(0)).astype("<u4"), count[a:b]) for a, b in zip(ends[live], ends[live + 1], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("anchors")
        held, size = [], 0
        for batch in slices(batches):
            columns = lists(batch)
            ids = ids_of(columns["id"])
            for _, h, row, *_ in segments(columns["text"], length, limits.chunk):
                held.append((h, ids[row]))
                size += len(h)
                if size >= 1 << 20:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def shared_anchors(table: pa.Table, buckets: int, limits: Limits) -> pa.Table:
    parts = [unpack(x, "<u4", "<u2") for x in table["hashes"].to_pylist()]
    rest = np.concatenate([np.cumsum(d, dtype=np.uint32) for d, _ in parts])
    count = np.concatenate([c for _, c in parts]).astype(np.int64)
    order = np.argsort(rest)
    rest, count = rest[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]]))
    total, rest = np.add.reduceat(count, first), rest[first].astype(U)
    shared = Bitmap.part(rest[total > 1], part_bits(limits.shared_bits, buckets))
    hot = Bitmap.part(rest[total >= limits.hot], part_bits(limits.hot_bits, buckets))
    return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int32()), "shared": [shared], "hot": [hot]})


#: What a task has in a bucket: contents (rest of the key, size, smallest id), their bytes, and their places (content, row,
#: start). Bucket -1 has the keys and ids of the task's rows.
BLOCKS = "task long, bucket int, contents binary, data binary, places binary"


class Collector:
    """Segments of some rows with shared anchors: distinct contents and where they are."""

    def __init__(self, length: int, buckets: int, limits: Limits, shared: Bitmap, hot: Bitmap):
        self.length, self.buckets, self.limits, self.shared, self.hot = length, buckets, limits, shared, hot
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.found: list[tuple[np.ndarray, ...]] = []  # content, key, row, start
        self.row_keys: list[int] = []
        self.row_more: list[int] = []
        self.ids: list[int] = []
        self.bytes = 0

    def add(self, row_keys: list[int], row_more: list[int], ids: list, texts: list[bytes | None]) -> None:
        base, index, length = len(self.row_keys), self.index, self.length
        self.row_keys += row_keys
        self.row_more += row_more
        self.ids += ids_of(ids).tolist()
        for data, h, row, start, a, b in segments(texts, length, self.limits.chunk):
            live = np.flatnonzero(self.shared.has(h))
            h, row, start, a, b = h[live], row[live], start[live], a[live], b[live]
            hot = self.hot.has(h)
            if hot.any():
                n = np.where(hot, b - a - length + 1, 1)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                h, row, start, a, b, hot = (np.repeat(x, n) for x in (h, row, start, a, b, hot))
                a, start = a + step, start + step
                b = np.where(hot, a + length, b)
                h = h.copy()
                h[hot] = [xxhash.xxh3_64_intdigest(data[x : x + length]) >> 24 for x in a[hot].tolist()]
            content = [index.setdefault(data[x:y], len(index)) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            self.found.append((np.array(content, np.int64), h, row + base, start))
            self.bytes += int((b - a).sum()) // 2

    def flush(self, task: int) -> pa.RecordBatch:
        content, key, row, start = (np.concatenate(x) for x in zip(*self.found, strict=True)) if self.found else [np.zeros(0, np.int64)] * 4
        n = len(self.index)
        keys, least = np.zeros(n, U), np.full(n, NO_ID, np.int64)
        keys[content] = key
        np.minimum.at(least, content, np.array(self.ids, np.int64)[row])
        texts = list(self.index)
        sizes = np.array([len(t) for t in texts], "<u4")
        bucket = (keys % U(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n) - ends[bucket[order]]
        by = np.argsort(bucket[content], kind="stable")
        occurs = np.searchsorted(bucket[content][by], np.arange(self.buckets + 1))
        content, row, start = (x[by].astype("<u4") for x in (place[content], row, start))
        rows = [(task, -1, pack(*(np.array(x, "<i8") for x in (self.row_keys, self.row_more, self.ids))), b"", b"")]
        rest = (keys // U(self.buckets)).astype("<u4")
        for b in np.flatnonzero(np.diff(ends)).tolist():
            own, at = order[ends[b] : ends[b + 1]], slice(occurs[b], occurs[b + 1])
            data = pa.compress(b"".join([texts[k] for k in own.tolist()]), "zstd", asbytes=True)
            rows.append((task, b, pack(rest[own], sizes[own], least[own]), data, pack(content[at], row[at], start[at])))
        self.clear()
        names = [f.split(" ") for f in BLOCKS.split(", ")]
        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        return pa.RecordBatch.from_pydict({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(names, zip(*rows, strict=True), strict=True)})


class Transform:
    """A shard's Burrows-Wheeler transform: for each depth, the super-character before each suffix, in sorted order."""

    def __init__(self, pair: np.ndarray, window: np.ndarray, length: int):
        """pair has the two bytes from each place on as a number; window has the places where windows begin."""
        order = np.arange(len(window))
        self.columns = []
        for before in range(length - 2, -1, -2):
            symbols = pair[window[order] + before]
            self.columns.append(symbols)
            order = order[np.argsort(symbols, kind="stable")]
        self.order = order


def merged_blocks(shards: list[Transform]) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the shards' sorted suffixes, refined to full depth, and the block of each place in it.

    interleave[i] is the shard of the i-th suffix of all; block numbers change where two neighbours differ.
    """
    sizes = [len(s.order) for s in shards]
    interleave = np.repeat(np.arange(len(shards)), sizes).astype(np.uint8 if len(shards) <= 256 else np.uint16 if len(shards) <= 65536 else np.int64)
    block = np.zeros(len(interleave), np.int64)
    symbols = np.empty(len(interleave), np.uint16)
    for depth in range(len(shards[0].columns)):
        symbols[np.argsort(interleave, kind="stable")] = np.concatenate([s.columns[depth] for s in shards])
        order = np.argsort(symbols, kind="stable")
        interleave, block, now = interleave[order], block[order], symbols[order]
        block = np.concatenate([[0], np.cumsum((now[1:] != now[:-1]) | (block[1:] != block[:-1]))])
    return interleave, block


def earlier(keys: np.ndarray, sizes: np.ndarray, data: bytes, least: np.ndarray, length: int, shard: int) -> np.ndarray:
    """For each of some different segments, the windows (as bits) that a segment with a smaller id has too."""
    out = np.zeros(len(keys), U)
    _, group, members = np.unique(keys, return_inverse=True, return_counts=True)
    several = np.flatnonzero(members[group] > 1)
    if not len(several):
        return out
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])[several]
    n = sizes[several] - length + 1
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    window, owner = np.repeat(start, n) + step, np.repeat(several, n)
    raw = np.frombuffer(data, np.uint8).astype(np.uint16)
    pair = (raw[:-1] << 8) | raw[1:]
    shards = [Transform(pair, window[at : at + shard], length) for at in range(0, len(window), shard)]
    interleave, block = merged_blocks(shards)
    suffix = np.empty(len(window), np.int64)
    suffix[np.argsort(interleave, kind="stable")] = np.concatenate([s.order + k * shard for k, s in enumerate(shards)])
    own = least[owner[suffix]]
    smallest = np.minimum.reduceat(own, np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])))[block]
    hit = suffix[smallest < own]
    np.bitwise_or.at(out, owner[hit], U(1) << step[hit].astype(U))
    return out


DECIDED = "task long, bucket int, decisions binary"


def decide(table: pa.Table, length: int, limits: Limits) -> pa.Table:
    """For each content of each task, the smallest id that has it, and which of its windows smaller ids have."""
    remembered("segments")
    index: dict[bytes, int] = {}
    found, owners = [], []
    for contents, packed in zip(table["contents"].to_pylist(), table["data"].to_pylist(), strict=True):
        found.append(unpack(contents, "<u4", "<u4", "<i8"))
        size = found[-1][1].astype(np.int64)
        ends = np.cumsum(size)
        text = pa.decompress(packed, int(ends[-1]), "zstd", asbytes=True)
        owners.append(np.array([index.setdefault(text[a:b], len(index)) for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]))
    owner, n = np.concatenate(owners), len(index)
    key, size, first = np.zeros(n, np.uint32), np.zeros(n, np.int64), np.full(n, NO_ID, np.int64)
    keys, sizes, least = (np.concatenate(x) for x in zip(*found, strict=True))
    key[owner], size[owner] = keys, sizes
    np.minimum.at(first, owner, least)
    bits = earlier(key, size, b"".join(index), first, length, limits.shard)
    gave_back()
    return pa.table({
        "task": table["task"], "bucket": table["bucket"].cast(pa.int32()), "decisions": pa.array([pack(first[o], bits[o]) for o in owners], pa.binary()),
    })


def spans_of(table: pa.Table, length: int) -> pa.Table:
    """The spans to remove from each row of a task: their starts and ends."""
    remembered("spans")
    rows = table.to_pylist()
    head = next(r for r in rows if r["bucket"] < 0)
    row_keys, row_more, ids = unpack(head["contents"], "<i8", "<i8", "<i8")
    found: list[tuple[np.ndarray, ...]] = []
    for r in rows:
        if r["bucket"] < 0:
            continue
        content, row, start = (x.astype(np.int64) for x in unpack(r["places"], "<u4", "<u4", "<u4"))
        size = unpack(r["contents"], "<u4", "<u4", "<i8")[1].astype(np.int64)[content]
        first, bits = (x[content] for x in unpack(r["decisions"], "<i8", "<u8"))
        whole = ids[row] > first
        found.append((row[whole], start[whole], (start + size)[whole]))
        part = np.flatnonzero(~whole & (bits > 0))
        for k in range(WINDOW):
            some = part[(bits[part] >> U(k) & U(1)).astype(bool)]
            found.append((row[some], start[some] + k, start[some] + k + length))
    row, a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
    order = np.lexsort((a, row))
    row, a, b = row[order], a[order], b[order]
    keys, more, spans = [], [], []
    if len(row):
        reach = np.maximum.accumulate((row << 32) + b)  # rows ascend, so a row's reach exceeds all of the rows before
        new = np.concatenate([[True], (row[1:] << 32) + a[1:] > reach[:-1]])
        first = np.flatnonzero(new)
        row, a, b = row[first], a[first], np.maximum.reduceat(b, first)
        at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        flat = np.stack([a, b], 1).astype("<i8")
        keys, more, spans = row_keys[row[at]], row_more[row[at]], [x.tobytes() for x in np.split(flat, at[1:])]
    gave_back()
    return pa.table({"row_key": pa.array(keys, pa.int64()), "row_more": pa.array(more, pa.int64()), "spans": pa.array(spans, pa.binary())})


def row_places(row_keys: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(row_keys.view(U)) % U(bits)).astype(np.int64)


KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def row_names(row_id: Column, text: Column) -> list[Column]:
    """128 bits in which rows agree that agree in id and text."""
    return [F.xxhash64(row_id, text), F.xxhash64(F.lit("more"), text, row_id)]


def narrowed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and keys in which rows agree that agree in both."""
    own = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return own.select("*", *(c.alias(name) for c, name in zip(row_names(F.col("id"), F.col("text")), ("row_key", "row_more"), strict=True)))


def repeat_spans(texts: DataFrame, length: int, limits: Limits = LIMITS) -> DataFrame:
    """row_key, row_more, spans: what to remove from each row of narrowed() that repeats something, as pairs of 64-bit integers."""
    if length % 2 or length < WINDOW + 7 or length > 1 << 16:
        raise ValueError("length must be even and at least 34")
    spark = texts.sparkSession
    buckets = 1
    while buckets < max(16, 4 * texts.rdd.getNumPartitions()):
        buckets *= 2
    counted = texts.mapInArrow(count_anchors(length, buckets, limits), ANCHORS).groupBy("bucket")
    parts = counted.applyInArrow(lambda t: shared_anchors(t, buckets, limits), "bucket int, shared binary, hot binary")
    shared, hot = [bytes(8)] * buckets, [bytes(8)] * buckets
    for r in cut(parts).toLocalIterator():  # bitmaps of bounded sizes
        shared[r["bucket"]], hot[r["bucket"]] = bytes(r["shared"]), bytes(r["hot"])
    maps = spark.sparkContext.broadcast((Bitmap(shared), Bitmap(hot)))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        collector = Collector(length, buckets, limits, *maps.value)
        task = TaskContext.get().partitionId() << 32
        remembered("anchors")
        for batch in slices(batches, 256):
            columns = lists(batch)
            collector.add(columns["row_key"], columns["row_more"], columns["id"], columns["text"])
            if collector.bytes >= limits.flush:
                yield collector.flush(task)
                task += 1
        if collector.row_keys:
            yield collector.flush(task)

    blocks = cut(texts.mapInArrow(collect, BLOCKS))
    decided = blocks.where("bucket >= 0").select("task", "bucket", "contents", "data").groupBy("bucket")
    decided = decided.applyInArrow(lambda t: decide(t, length, limits), DECIDED)
    own = blocks.select("task", "bucket", "contents", "places")
    joined = own.join(decided, ["task", "bucket"], "left").groupBy("task")
    return cut(joined.applyInArrow(lambda t: spans_of(t, length), "row_key long, row_more long, spans binary").dropDuplicates(["row_key", "row_more"]))


def without(text: bytes, spans: bytes | None) -> tuple[bytes, np.ndarray]:
    """What the spans leave of a text, and the spans as rows of an array."""
    found = np.frombuffer(spans or b"", "<i8").reshape(-1, 2)
    edges = [0, *found.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), found


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, limits: Limits = LIMITS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    texts = narrowed(docs, id_col, text_col)
    spans = repeat_spans(texts, length, limits)
    flags = docs.sparkSession.sparkContext.broadcast(row_bitmap(spans, limits.row_bits))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = flags.value
        remembered("spans")
        for batch in slices(batches):
            columns = lists(batch)
            place = row_places(np.array(columns["row_key"], np.int64), 8 * len(bits))
            flagged = (bits[place >> 3] >> (7 - (place & 7)) & 1).astype(bool)
            own = [t or b"" for t in columns["text"]]
            yield pa.RecordBatch.from_pydict({
                "row_key": batch.column("row_key"), "row_more": batch.column("row_more"), "id": batch.column("id"), "n_bytes": pa.array([len(t) for t in own], pa.int64()),
                "sha": pa.array([None if f else hashlib.sha256(t).hexdigest() for t, f in zip(own, flagged, strict=True)], pa.string()),
                "text": pa.array([pa.compress(t, "zstd", asbytes=True) if f else None for t, f in zip(own, flagged, strict=True)], pa.binary()),
            })

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("spans")
        for batch in slices(batches):
            out = []
            for r in batch.to_pylist():
                if r["sha"]:
                    out.append((r["id"], r["n_bytes"], 0, 0, r["sha"]))
                else:
                    text = pa.decompress(r["text"], r["n_bytes"], "zstd", asbytes=True) if r["n_bytes"] else b""
                    text, found = without(text, r["spans"])
                    out.append((r["id"], r["n_bytes"], r["n_bytes"] - len(text), len(found), hashlib.sha256(text).hexdigest()))
            fields = [f.split(" ") for f in RESULT.split(", ")]
            columns = zip(*out, strict=True) if out else ([] for _ in fields)
            yield pa.RecordBatch.from_pydict({n: pa.array(c, KINDS[k]) for (n, k), c in zip(fields, columns, strict=True)})

    rows = texts.mapInArrow(split, "row_key long, row_more long, id long, n_bytes long, sha string, text binary").join(spans, ["row_key", "row_more"], "left")
    return rows.select("id", "n_bytes", "sha", "text", "spans").mapInArrow(finish, RESULT)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """docs with their columns, the texts without what repeats; bytes of a character that is cut in two go too."""
    spans = repeat_spans(narrowed(docs, id_col, text_col), length).toDF("span_key", "span_more", "span_list")

    own = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("spans")
        for batch in slices(batches, 256):
            texts, found = batch.column(own).to_pylist(), batch.column(len(docs_names)).to_pylist()
            kept = [t if t is None or s is None else without(t.encode(), s)[0].decode("utf-8", "ignore") for t, s in zip(texts, found, strict=True)]
            columns = batch.columns[:-1]
            columns[own] = pa.array(kept, batch.schema.field(own).type)
            yield pa.RecordBatch.from_arrays(columns, docs_names)

    docs_names = list(docs.columns)
    key, more = row_names(docs[id_col].cast("long"), docs[text_col].cast("string"))
    joined = docs.join(spans, (key == spans["span_key"]) & (more == spans["span_more"]), "left")
    return joined.select(*(docs[c] for c in docs.columns), spans["span_list"]).mapInArrow(run, docs.schema)


def row_bitmap(spans: DataFrame, most_bits: int) -> np.ndarray:
    """A bitmap, sized by their number up to so many bits, with a bit for every row that has spans."""
    size = min(most_bits, max(1 << 16, 1 << (8 * spans.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(row_places(batch.column("row_key").to_numpy(), size))
            bit = np.int64(1) << (at & 31)
            first = np.flatnonzero(np.concatenate([[True], (at >> 5)[1:] != (at >> 5)[:-1]])) if len(at) else at
            yield pa.RecordBatch.from_pydict({"word": pa.array((at >> 5)[first]), "bits": pa.array(np.bitwise_or.reduceat(bit, first) if len(at) else bit)})

    words = spans.select("row_key").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size, bool)
    word, bits = words["word"].to_numpy(), words["bits"].to_numpy()
    for k in range(32):
        out[word[(bits >> k & 1) == 1] * 32 + k] = True
    return np.packbits(out)
