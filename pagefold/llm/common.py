"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import write_table

#: Rows of a key beyond which the key is heavy, and the most keys that can be heavy, whatever the input: with n rows in all, a
#: heavy key has n / HEAVY_KEYS or more, so there are no more than that many.
HEAVY_ROWS = 10_000
HEAVY_KEYS = 1_000


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes a frame as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors."""
    return write_table(df, label)


def keyed_join(left: DataFrame, right: DataFrame, keys: list[str], n: str = "n", rows: int | None = None) -> DataFrame:
    """left joined with right, which has one row for each key and in column ``n`` how many rows of left have it (``n`` is dropped).

    The rows of a heavy key never meet in one task: heavy keys, a bounded number, are broadcast, the others are shuffled.
    rows: how many left has, if that is known. Both frames are read more than once, so large ones should be written tables.
    """
    total = right.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0] if rows is None else rows
    if total <= HEAVY_ROWS:
        return left.join(right.drop(n), keys)
    heavy = F.col(n) > max(HEAVY_ROWS, total // HEAVY_KEYS)
    few = right.where(heavy)
    rest = left.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(right.where(~heavy).drop(n), keys)
    return left.join(F.broadcast(few.drop(n)), keys).unionByName(rest)


def shared_rows(rows: DataFrame, key: str, node: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Rows of a written table whose key another node has, too, with the key's smallest node (rep) and number of rows (size).

    Keys are counted with map-side partial rows; they are broadcast if there are so few, else joined with heavy keys apart.
    """
    groups = rows.groupBy(key).agg(F.min(node).alias("rep"), F.max(node).alias("last"), F.count(F.lit(1)).alias("size")).where("rep < last")
    groups = materialize(groups.select(key, "rep", "size", F.col("size").alias("n")), "groups")
    if groups.count() <= broadcast_rows:
        return rows.join(F.broadcast(groups.drop("n")), key)
    return keyed_join(rows, groups, [key])


def blocks(texts: list[str], chars: int) -> Iterator[list[tuple[int, str]]]:
    """(position, text) pairs in runs of about so many characters; a longer text is a run of its own."""
    part: list[tuple[int, str]] = []
    size = 0
    for i, t in enumerate(texts):
        if part and size + len(t) > chars:
            yield part
            part, size = [], 0
        part.append((i, t))
        size += len(t)
    if part:
        yield part


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, which runs many tasks: for what is costly to load."""
    return sys.modules.setdefault("_pagefold_worker", types.ModuleType("_pagefold_worker")).__dict__


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a table that is written inside go when it is complete, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """So many rows at a time go to Python while what stands inside runs: for rows that hold large values."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
