"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of cores.  Each
query runs once to warm up and is then timed.  Index builds write a new index
each time; the searches read the first one.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from gleaner.catalogue import queries as registered
from gleaner.catalogue import tables
from gleaner.session import new_folder
from gleaner.sources.fields import DocumentSource, FieldSource
from gleaner.sources.index import Index

HEADLINE = (
    "chunk_passages",
    "token_counts",
    "corpus_stats",
    "snapshot_diff",
    "field_union",
    "query_specs",
    "term_df",
    "bm25_scores",
    "shortlist",
    "max_passage_score",
    "search_documents",
    "search_index",
    "search_fields",
    "batch_search",
    "document_text",
)


def session(cores: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gleaner-bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="gleaner-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    known = registered.queries()

    def timed(run) -> float:
        started = time.perf_counter()
        run()
        return round(time.perf_counter() - started, 3)

    def run(name: str) -> None:
        known[name](spark, folder).write.format("noop").mode("overwrite").save()

    def build(source) -> None:
        Index(spark, new_folder(spark, "index-bench")).refresh(source)

    tables.document_index(spark, folder)
    tables.field_index(spark, folder)
    texts = DocumentSource(tables.documents(spark, folder), "documents")
    cells = FieldSource(tables.field_tables(spark, folder), tables.FIELDS, tables.KEYS, database=tables.DATABASE)
    seconds = {
        "index_build": timed(lambda: build(texts)),
        "field_index_build": timed(lambda: build(cells)),
    }
    for name in HEADLINE:
        run(name)
        seconds[name] = timed(lambda: run(name))
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
