"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``a, b`` (any ordered type) -> ``node, root``: the smallest node each one reaches.

    Nodes without a link do not appear.  Every round groups and joins the links on
    their nodes, so no component has to fit one task; the number of links never grows.
    """
    stars = stored(
        links.where("a != b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct(),
        "links",
    )
    while True:
        both = stars.select("node", "root").union(stars.select("root", "node"))
        lowest = both.groupBy("node").agg(F.min("root").alias("low"))
        # Large star: every larger neighbour of a node moves to the node's smallest neighbour.
        large = (
            both.where("root > node")
            .select("node", F.col("root").alias("other"))
            .join(lowest, "node")
            .select(F.col("other").alias("node"), F.least("low", "node").alias("root"))
            .distinct()
        )
        large = stored(large, "links")
        # Small star: a node and its smaller neighbours move to the smallest of them.
        least = large.groupBy("node").agg(F.min("root").alias("low"))
        small = (
            large.join(least, "node")
            .select(F.explode(F.array(F.struct("node", "low"), F.struct(F.col("root").alias("node"), "low"))).alias("x"))
            .select("x.node", F.col("x.low").alias("root"))
            .where("node != root")
            .distinct()
        )
        small = stored(small, "links")
        changed = small.exceptAll(stars).isEmpty() and stars.exceptAll(small).isEmpty()
        stars = small
        if changed:
            return stars
