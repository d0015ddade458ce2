"""Judgements kept between searches.

Scores are appended, never updated in place.  Files are grouped by namespace (query,
criteria and scorer), so a search reads only what was stored for its own queries.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import judging as J

SCHEMA = (
    "key string, score double, input_tokens long, output_tokens long, run string, "
    "stored timestamp, namespace string"
)


class ScoreCache:
    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def _stored(self, queries: DataFrame | None = None) -> DataFrame:
        """What is stored, for the namespaces of these queries (one each) or for all."""
        try:
            stored = self._spark.read.schema(SCHEMA).parquet(self._folder)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self._spark.createDataFrame([], SCHEMA)
        if queries is None:
            return stored
        names = [row.namespace for row in queries.select("namespace").distinct().collect()]
        return stored.where(F.col("namespace").isin(names))

    @staticmethod
    def _newest(stored: DataFrame) -> DataFrame:
        """One row per key; of judgements stored twice the later one counts."""
        last = F.max(F.struct("stored", "score")).alias("last")
        return stored.groupBy("namespace", "key").agg(last).select(
            "namespace", "key", F.col("last.score").alias("score")
        )

    def read(self, queries: DataFrame | None = None) -> DataFrame:
        """``namespace, key, score`` with one row per key."""
        return self._newest(self._stored(queries))

    def lookup(self, keyed: DataFrame, queries: DataFrame | None = None) -> DataFrame:
        """Add ``score`` to judgements that carry ``namespace`` and ``key``."""
        return keyed.join(self.read(queries), ["namespace", "key"], "left")

    def append(self, scored: DataFrame, run: str) -> None:
        """Store scores under the name of the run that asked for them."""
        rows = scored.select(
            "key", "score", *J.TOKENS, F.lit(run).alias("run"),
            F.current_timestamp().alias("stored"), "namespace",
        )
        spread = rows.hint("rebalance", F.col("namespace"))
        spread.write.partitionBy("namespace").mode("append").parquet(self._folder)

    def compact(self, folder: str) -> ScoreCache:
        """Write one row per key, the newest as it was stored, to another folder.

        The cache itself is left alone, so searches can go on until callers switch to
        the one returned.
        """
        rest = ("score", *J.TOKENS, "run")
        last = F.max(F.struct("stored", *rest)).alias("last")
        kept = self._stored().groupBy("namespace", "key").agg(last)
        rows = kept.select("key", *(f"last.{name}" for name in rest), "last.stored", "namespace")
        spread = rows.hint("rebalance", F.col("namespace"))
        spread.write.partitionBy("namespace").mode("append").parquet(folder)
        return ScoreCache(self._spark, folder)
