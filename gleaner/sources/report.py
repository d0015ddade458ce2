"""Reports of a ranking as tab-separated lines or as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T


def _escaped(text: Column) -> Column:
    """JSON escapes without the quotes, so a path cannot break its line."""
    quoted = T.json_text(text)
    return F.substring(quoted, F.lit(2), F.char_length(quoted) - 2)


def report_tsv(results: DataFrame) -> DataFrame:
    """``rank TAB score TAB path``, and TAB JSON text where there is one."""
    line = F.format_string("%d\t%.6f\t%s", "rank", "score", _escaped(F.col("path")))
    if "text" in results.columns:
        line = F.concat(line, F.lit("\t"), T.json_text(F.col("text")))
    return results.select("query_id", "rank", line.alias("line"))


def report_json(
    results: DataFrame,
    queries: DataFrame,
    corpus: str,
    scorer: str,
    exhaustive: bool,
    stats: dict[str, int],
) -> DataFrame:
    """One JSON object per query: ``query_id, report``.

    Each group holds the k results of one query.  Absent values are left out;
    criteria appear only if the caller gave them.
    """
    optional = [F.col(name) for name in ("source", "text") if name in results.columns]
    result = F.struct("rank", "path", "score", "passage", *optional)
    ranked = results.groupBy("query_id").agg(
        F.array_sort(F.collect_list(result)).alias("results")
    )
    criteria = F.when(F.col("yes").isNotNull(), F.struct("yes", "no"))
    counters = F.struct(*[F.lit(value).alias(name) for name, value in stats.items()])
    report = F.struct(
        "query",
        criteria.alias("criteria"),
        F.lit(corpus).alias("corpus"),
        F.lit(scorer).alias("scorer"),
        F.lit(exhaustive).alias("exhaustive"),
        F.coalesce("results", F.array().cast(ranked.schema["results"].dataType)).alias("results"),
        counters.alias("stats"),
    )
    return queries.join(ranked, "query_id", "left").select(
        "query_id", F.to_json(report).alias("report")
    )
