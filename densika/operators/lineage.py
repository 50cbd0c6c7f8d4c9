"""Cutting lineage through the folder that a cluster's machines share, and a trace of the stages that end so."""

from __future__ import annotations

import logging
import os
import re
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("densika")


@dataclass(frozen=True)
class Step:
    """A stage of a run: what it made, in how many seconds, and how many rows."""

    what: str
    seconds: float
    rows: int


_steps: ContextVar[list[Step] | None] = ContextVar("steps", default=None)


@contextmanager
def traced() -> Iterator[list[Step]]:
    """Collects the stages that run inside; they also go to the logger "densika" at level INFO."""
    steps: list[Step] = []
    token = _steps.set(steps)
    try:
        yield steps
    finally:
        _steps.reset(token)


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir).

    Only a session whose executors are threads of the driver may go without that setting; it gets a local folder.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = f"/tmp/densika-checkpoints-{os.getuid()}"
    return f"{base.rstrip('/')}/densika-{what}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever it is stored, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Spark then deletes an execution's shuffle files as soon as it ends; what is cut is never read from them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, what: str = "") -> DataFrame:
    """df, computed once and kept in the shared folder, so a lost executor costs no earlier stage.

    A stage with a name is traced; its rows are counted as they are written.
    """
    if not what:
        return _checkpointed(df)
    began = time.perf_counter()
    out, found = cut_and_observe(df, F.count(F.lit(1)).alias("rows"))
    step = Step(what, time.perf_counter() - began, found["rows"])
    log.info("%s: %d rows in %.3f s", step.what, step.rows, step.seconds)
    if (steps := _steps.get()) is not None:
        steps.append(step)
    return out


def cut_and_observe(df: DataFrame, *figures: Column) -> tuple[DataFrame, dict]:
    """cut(), and aggregates of df by name, which are found while it is written."""
    seen = Observation()
    out = _checkpointed(df.observe(seen, *figures))
    return out, seen.get


def _checkpointed(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(spark, "checkpoints"))
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(CLEANUP, before)
