"""Comparing a corpus with the snapshot taken of it before.

A manifest has one row per document: ``path`` and a ``stamp`` that changes with
the content.  Only manifests are joined; texts stay where they are.  Stored manifests
lie in buckets of the path, sorted by it, so that two of them with as many buckets are
compared by a merge join without moving either.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ADDED, CHANGED, KEPT, REMOVED = "new", "changed", "unchanged", "removed"


def _table_name(folder: str) -> str:
    return "manifest_" + hashlib.sha256(folder.encode()).hexdigest()[:24]


def store_manifest(manifest: DataFrame, folder: str, buckets: int, dealt: bool = False) -> DataFrame:
    """Write (or add to) a manifest in buckets of ``path``.

    ``dealt`` says that the rows come from tables with the same buckets and lie right.
    """
    rows = manifest if dealt else manifest.repartition(buckets, "path")
    name = _table_name(folder)
    writer = rows.write.mode("append").bucketBy(buckets, "path").sortBy("path")
    writer.option("path", folder).saveAsTable(name)
    return manifest.sparkSession.table(name)


def open_manifest(spark: SparkSession, folder: str, schema: str, buckets: int) -> DataFrame:
    """A stored manifest, declared again where the session doesn't know it yet."""
    name = _table_name(folder)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet "
        f"CLUSTERED BY (path) SORTED BY (path) INTO {buckets} BUCKETS LOCATION '{folder}'"
    )
    return spark.table(name)


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, class`` for every path on either side."""
    before = old.select("path", F.col("stamp").alias("old_stamp"), F.lit(True).alias("was"))
    after = new.select("path", F.col("stamp").alias("new_stamp"), F.lit(True).alias("is"))
    kind = (
        F.when(F.col("was").isNull(), ADDED)
        .when(F.col("is").isNull(), REMOVED)
        .when(F.col("old_stamp").eqNullSafe(F.col("new_stamp")), KEPT)
        .otherwise(CHANGED)
    )
    return before.join(after, "path", "full_outer").select("path", kind.alias("class"))


def removed_docs(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("path"), "path", "left_anti")


def cascade_keep(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows whose document is still there."""
    return rows.join(kept.select("path"), "path", "left_semi")


def refresh_counts(diff: DataFrame) -> DataFrame:
    """Changed documents count as updated only; a rename is one add, one removal."""
    return diff.agg(
        F.count_if(F.col("class").isin(ADDED, CHANGED)).alias("updated"),
        F.count_if(F.col("class") == REMOVED).alias("removed"),
        F.count_if(F.col("class") != REMOVED).alias("documents"),
    )
