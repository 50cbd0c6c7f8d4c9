"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import sys
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from densika.operators.lineage import cut, drop_folder, shared_folder

__all__ = [
    "LOWER", "cut", "drop_folder", "gave_back", "held_out", "keep_rows", "lists", "make_importable", "map_batches", "mixed", "pack", "pack_parts", "read", "remainder", "remembered", "shared_folder", "slices", "unpack",
]

T = TypeVar("T")

#: Bytes with A-Z lower-cased; every other byte, so every other code point, stays.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64, one to one."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, their bytes sorted by significance and compressed, as most high bytes are alike."""
    return pack_parts(np.array([0, len(arrays[0])]), *arrays)[0]


def pack_parts(ends: np.ndarray, *arrays: np.ndarray) -> list[bytes]:
    """pack() of each part of the arrays; ends has where the first begins, and where each ends."""
    planes = np.empty((sum(a.itemsize for a in arrays), len(arrays[0])), np.uint8)
    at = 0
    for a in arrays:
        planes[at : at + a.itemsize] = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
        at += a.itemsize
    parts = zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
    return [(b - a).to_bytes(8, "little") + (pa.compress(planes[:, a:b].tobytes(), "zstd", asbytes=True) if b > a else b"") for a, b in parts]


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays that pack() was given, of these types."""
    n, types = int.from_bytes(data[:8], "little"), [np.dtype(k) for k in kinds]
    raw = pa.decompress(data[8:], n * sum(t.itemsize for t in types), "zstd", asbytes=True) if n else b""
    out, at = [], 0
    for t in types:
        part = np.frombuffer(raw, np.uint8, n * t.itemsize, at).reshape(t.itemsize, n)
        out.append(np.ascontiguousarray(part.T).view(t).ravel())
        at += n * t.itemsize
    return out


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table, by Spark's reader."""
    make_importable(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def make_importable(spark: SparkSession) -> None:
    """Python workers import this package from where the driver did, if that path is there too.

    On a cluster whose machines don't have the path, ship the package with --py-files.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    if root not in sys.path:
        sys.path.append(root)


def map_batches(df: DataFrame, schema: str, fn: Callable[[dict[str, list]], dict[str, object]]) -> DataFrame:
    """fn gets a dict of Python lists for each Arrow batch and returns a dict of columns in the order of schema.

    String columns arrive as UTF-8 bytes.
    """
    return df.mapInArrow(BatchMap(fn, list(df.columns)), schema)


class BatchMap:
    def __init__(self, fn: Callable, columns: list[str]):
        self.fn, self.columns = fn, columns

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict(self.fn(lists(batch)))


#: What the operator that runs in a Python worker remembers between tasks. Workers outlive queries, so there is one at a time.
_HELD: dict[str, object] = {}


def remembered(name: str, make: Callable[[], T] = dict) -> T:
    """The worker's memory of that name; those of other operators are given up first."""
    if name not in _HELD:
        _HELD.clear()
        gave_back()
        _HELD[name] = make()
    return _HELD[name]


def gave_back() -> None:
    """Returns freed memory to the system, which an allocator may keep for as long as the worker lives."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows that aren't empty; freed memory goes back after the last one."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    gave_back()


def keep_rows(docs: DataFrame, column: str, keep: Callable[[list], list[bool]]) -> DataFrame:
    """The rows for whose value in a column keep says yes, with all their columns, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = lists(batch.select([column]))[column]
            yield batch.filter(pa.array(keep(values), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def lists(batch: pa.RecordBatch) -> dict[str, list]:
    """Python lists of a batch's columns; strings as bytes."""
    out = {}
    for name, column in zip(batch.schema.names, batch.columns, strict=True):
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
        out[name] = column.to_pylist()
    return out


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the column's decimal text, modulo; null where the column is null."""
    return F.crc32(F.col(column).cast("string")) % modulus


def held_out(column: str, modulus: int, fold: int) -> Column:
    """Whether a row lies in the held-out fold; rows without an id don't."""
    return F.coalesce(remainder(column, modulus) == fold, F.lit(False))
