"""Hierarchical multi-length packing (operator 8).

Documents are encoded, ended with ``end_id`` and routed to tiers of context sizes (powers of two up to ``context``). The
largest remaining document opens a window of its tier; gaps of the window are filled from the shorter tiers, largest
first, and what no whole document fills is cut off the shortest document left. So every window is full. What is left of
a pool of documents goes into the next pool, and what is left of a partition is cut into windows whose sizes are powers
of two, so no window is padded. Windows are dealt into step groups of about equal token counts, largest first.

Each input partition is packed by itself, in pools of about POOL_TOKENS tokens: nothing is shuffled, and memory holds
one pool and one Arrow batch. Ids of sequences and step groups hold the partition's number, so they are unique. A task
that runs again reads the same rows and makes the same windows, given that the input's order is that of files.

Defined results: null and empty texts are a document of the one id ``end_id``; a null id is passed through; rows that
share an id are packed as documents of their own; texts of any length are cut into as many windows as they need; an
empty table gives an empty table; columns other than id and text are not read.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from densika.llm.bpe import Shared, columns
from densika.llm.common import lists, slices

POOL_TOKENS = 1 << 20
TIERS = (512, 1024, 2048, 4096)
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
    " tier long, step_group long"
)

#: A piece: its length, a number that breaks ties, its document (id, packed ids, tokens), and its start there.
Piece = tuple[int, int, tuple, int]


def windows(pieces: list[Piece], tiers: tuple[int, ...]) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full windows, each with its tier, made of the pieces; and the pieces that are left, shorter than a window."""
    left, full, largest = [], [], tiers[-1]
    for length, k, doc, start in pieces:
        whole = length // largest * largest
        full += [(largest, [(largest, k, doc, at)]) for at in range(start, start + whole, largest)]
        if length > whole:
            left.append((length - whole, k, doc, start + whole))
    left.sort(key=lambda p: p[:2])
    while left:
        first = left.pop()
        tier = next(t for t in tiers if t >= first[0])
        window, gap = [first], tier - first[0]
        while gap and left:
            at = bisect_right(left, gap, key=lambda p: p[0])
            if at:
                piece = left.pop(at - 1)
            else:
                length, k, doc, start = left.pop(0)
                piece = (gap, k, doc, start)
                insort(left, (length - gap, k, doc, start + gap), key=lambda p: p[:2])
            window.append(piece)
            gap -= piece[0]
        if gap:
            return full, window
        full.append((tier, window))
    return full, []


def binary_windows(pieces: list[Piece]) -> list[tuple[int, list[Piece]]]:
    """Windows that hold the pieces and whose sizes are powers of two, all different."""
    full, pieces = [], list(pieces)
    total = sum(p[0] for p in pieces)
    for size in (1 << b for b in reversed(range(total.bit_length())) if total >> b & 1):
        window, gap = [], size
        while gap:
            length, k, doc, start = pieces.pop(0)
            if length > gap:
                pieces.insert(0, (length - gap, k, doc, start + gap))
            window.append((min(length, gap), k, doc, start))
            gap -= min(length, gap)
        full.append((size, window))
    return full


def balanced(sizes: list[int], step_tokens: int) -> list[int]:
    """The step group of each window: largest first, to the group with the fewest tokens so far."""
    groups = [(0, g) for g in range(max(1, -(-sum(sizes) // step_tokens)))]
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        total, g = groups[0]
        heapq.heapreplace(groups, (total + sizes[k], g))
        out[k] = g
    return out


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
    tiers: tuple[int, ...] = TIERS, step_tokens: int = 1 << 17, with_ids: bool = False, pool_tokens: int = POOL_TOKENS,
) -> DataFrame:
    """A row for each piece, in the order of SCHEMA; with_ids adds the piece's ids."""
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers must be growing powers of two")
    shared, end = Shared(docs.sparkSession, path), int(end_id).to_bytes(4, "little")
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def rows(full: list, base: int, sequence: int, group: int) -> pa.RecordBatch:
        out: list[list] = [[] for _ in names]
        ids = []
        groups = balanced([t for t, _ in full], step_tokens)
        for n, (tier, window) in enumerate(full):
            offset = 0
            for length, _, (key, packed, tokens), start in window:
                part = packed[4 * start : 4 * (start + length)]
                values = (key, start, length, zlib.crc32(part), tokens, base + sequence + n, offset, tier, base + group + groups[n])
                for column, x in zip(out, values, strict=True):
                    column.append(x)
                offset += length
                if with_ids:
                    ids.append(np.frombuffer(part, "<u4").astype(np.int32))
        batch = {k: pa.array(v, pa.int64()) for k, v in zip(names, out, strict=True)}
        return pa.RecordBatch.from_pydict(batch | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {}))

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.get()
        base = TaskContext.get().partitionId() << 40
        pool: list[Piece] = []
        tokens = number = sequence = group = 0
        for batch in slices(batches):
            columns_ = lists(batch)
            for key, data in zip(columns_["id"], columns_["text"], strict=True):
                packed = encoder.pack(data or b"") + end
                n = len(packed) // 4
                pool.append((n, number, (key, packed, n), 0))
                number, tokens = number + 1, tokens + n
                if tokens >= pool_tokens:
                    full, pool = windows(pool, tiers)
                    yield rows(full, base, sequence, group)
                    sequence, group = sequence + len(full), group + len(full)
                    tokens = sum(p[0] for p in pool)
        full, pool = windows(pool, tiers)
        full += binary_windows(pool)
        if full:
            yield rows(full, base, sequence, group)

    return columns(docs, id_col, text_col).mapInArrow(partition, SCHEMA + ", ids array<int>" * with_ids)
