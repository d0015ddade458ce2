"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import new_folder

#: A side of a join is broadcast only when it is known to have at most so many rows.
BROADCAST_ROWS = 1_000_000


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str, *partitions: str) -> DataFrame:
    """Write a result to the shared folder and read it back; this cuts its lineage."""
    spark = df.sparkSession
    folder = new_folder(spark, label)
    df.write.partitionBy(*partitions).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the (stored) frame has at most ``limit`` rows, else leave it.

    Beyond the limit Spark shuffles both sides of the join instead.
    """
    count = df.count() if rows is None else rows
    return F.broadcast(df) if count <= limit else df


def free_name(df: DataFrame, label: str) -> str:
    """A column name that the frame does not have, whatever it calls its columns."""
    taken = {name.lower() for name in df.columns}
    while label.lower() in taken:
        label = f"{label}_{uuid.uuid4().hex[:6]}"
    return label


def in_parts(texts: list[str | None], limit: int = 4 << 20) -> Iterator[list[str | None]]:
    """Consecutive parts of a batch with about ``limit`` characters each, so that what a
    task holds for them at a time stays bounded; a longer text is a part of its own."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def batch_parts(batch: pa.RecordBatch, column: str | int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about ``limit`` bytes of a text column each; a
    longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(batch):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def let(value: Column, body) -> Column:
    """Evaluate a value once for a body that uses it several times or in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the value written as text, modulo ``divisor``."""
    return F.crc32(F.col(column).cast("string")) % divisor
