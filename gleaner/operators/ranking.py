"""Pooling passage scores into documents, and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def top_per_group(
    rows: DataFrame, group: str, order: Sequence[Column], limit: int, single: bool = False
) -> DataFrame:
    """Rows ranked 1..limit inside each group, in ``rank``.

    Every task passes on at most ``limit`` rows of a group.  ``single`` says that all
    rows belong to one group: an ordered limit then picks them, and only those few are
    numbered.
    """
    if single:
        rows = rows.orderBy(*order).limit(limit)
    whole = Window.partitionBy(group).orderBy(*order)
    ranked = rows.withColumn("rank", F.row_number().over(whole))
    return ranked.where(F.col("rank") <= limit)


def max_passage_score(scored: DataFrame) -> DataFrame:
    """Each document's best passage; an earlier passage wins a tie."""
    best = F.max(F.struct("score", (-F.col("ordinal")).alias("back"), "source")).alias("best")
    return scored.groupBy("query_id", "path").agg(best).select(
        "query_id",
        "path",
        F.col("best.score").alias("score"),
        (-F.col("best.back")).alias("passage"),
        F.col("best.source").alias("source"),
    )


def top_k(pooled: DataFrame, k: int, single: bool = False) -> DataFrame:
    """``query_id, rank, score, path, passage, source`` of the k best documents."""
    order = [F.desc("score"), F.asc("path")]
    best = top_per_group(pooled, "query_id", order, k, single)
    return best.select("query_id", "rank", "score", "path", "passage", "source")


def label_separation(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean score of wanted minus mean score of unwanted labelled documents."""
    wanted, unwanted = F.col("wanted"), ~F.col("wanted")
    return scored.join(labels, "path").groupBy("query_id").agg(
        F.round(
            F.avg(F.when(wanted, F.col("score"))) - F.avg(F.when(unwanted, F.col("score"))), 6
        ).alias("separation"),
        F.count_if(wanted).alias("wanted"),
        F.count_if(unwanted).alias("unwanted"),
    )
