"""Where a session keeps tables that must outlive an executor."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the one the session names, or its warehouse."""
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/gleaner/{label}-{uuid.uuid4().hex}"


_open_scope: ContextVar[list[str] | None] = ContextVar("open_scope", default=None)


def passing_folder(spark: SparkSession, label: str) -> str:
    """A new folder that goes when the open ``scratch`` scope ends, if there is one."""
    folder = new_folder(spark, label)
    scope = _open_scope.get()
    if scope is not None:
        scope.append(folder)
    return folder


def materialize(df: DataFrame, label: str, *partitions: str) -> DataFrame:
    """Write a result once and read it back, so later steps do not repeat it.

    ``partitions`` are columns that readers choose folders by.

    Frames built on it need the files until they have run.  Inside ``scratch`` the
    files go when the scope ends; outside any scope they stay in the shared folder.
    """
    folder = passing_folder(df.sparkSession, label)
    df.write.partitionBy(*partitions).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def materialize_counted(df: DataFrame, label: str, **counters: Column) -> tuple[DataFrame, dict[str, int]]:
    """``materialize``, and aggregates of the rows from the job that writes them.

    The planner may leave out the counting of a result that it finds to be empty; an
    empty result has counters of zero.
    """
    seen = Observation()
    stored = materialize(df.observe(seen, *(value.alias(name) for name, value in counters.items())), label)
    return stored, dict.fromkeys(counters, 0) if stored.isEmpty() else seen.get


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables written inside the scope when it ends, and no others."""
    written: list[str] = []
    token = _open_scope.set(written)
    try:
        yield
    finally:
        _open_scope.reset(token)
        hadoop = spark._jsc.hadoopConfiguration()
        for folder in written:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Run what is inside with another value of a setting of the session."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
