"""Corpora and query tables derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.catalogue.specs import JSON, TEXT, json_cases, plain_cases
from gleaner.plans.corpus import Corpus
from gleaner.session import new_folder
from gleaner.sources.fields import DocumentSource, FieldSource
from gleaner.sources.index import Index

PROBE = "atonou heoron eroning einber una und onon eriner"
PROBE_YES = "heoron thereer ouerion"
PROBE_NO = "eroning einber und"
SHORTLIST = 500
TOP = 10
MANIFEST_BUCKETS = 16
DATABASE = "tables"
FIELDS = [
    "documents.text", "conversations.text", "part.p_name", "part.p_type",
    "customer.c_mktsegment", "nation.n_name", "region.r_name", "Region.R_NAME",
]
KEYS = {
    "documents": ["doc_id"], "conversations": ["turn", "conv_id"], "part": ["p_partkey"],
    "customer": ["c_custkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"],
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table, spread over all cores where its files are too few for that."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores)
    return rows


def path_of() -> Column:
    return F.format_string("%s/%d.txt", "source", "doc_id")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The ``documents`` table as files: ``path, text, source`` (and its id)."""
    return table(spark, folder, "documents").select(
        path_of().alias("path"), "text", F.lit(None).cast("string").alias("source")
    )


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with their labels, NULL where they have none."""
    labels = table(spark, folder, "labels")
    return table(spark, folder, "documents").join(labels, "doc_id", "left").withColumn(
        "path", path_of()
    )


def _later(spark: SparkSession, folder: str) -> DataFrame:
    """``path, text, quality`` of a later state of the corpus."""
    edited = F.when(F.col("lang") == "fr", F.concat("text", F.lit("\nfin"))).otherwise(
        F.col("text")
    )
    left = labelled(spark, folder).where("coalesce(toxic, 0) = 0")
    added = table(spark, folder, "benchmark").select(
        F.format_string("benchmark/%d.txt", "item_id").alias("path"), "text",
        F.lit(None).cast(left.schema["quality"].dataType).alias("quality"),
    )
    return left.select("path", edited.alias("text"), "quality").unionByName(added)


def takedown(spark: SparkSession, folder: str) -> DataFrame:
    """A later state of the corpus: toxic documents are gone, French ones were
    edited, and the benchmark items have come in as new documents."""
    return _later(spark, folder).select("path", "text")


def acceptable(rows: DataFrame) -> DataFrame:
    """The rows with a text, less that of documents of low quality."""
    return rows.withColumn("text", F.when(F.col("quality").eqNullSafe(0), None).otherwise(F.col("text")))


def damaged(spark: SparkSession, folder: str) -> DataFrame:
    """The documents, where those of low quality have lost their text."""
    return acceptable(labelled(spark, folder)).select("path", "text")


def damaged_takedown(spark: SparkSession, folder: str) -> DataFrame:
    """The later state, with the same losses."""
    return acceptable(_later(spark, folder)).select("path", "text")


def field_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: table(spark, folder, name) for name in KEYS}


def benchmark_queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("query"),
        F.lit(None).cast("string").alias("yes"),
        F.lit(None).cast("string").alias("no"),
    )


def manifest(rows: DataFrame) -> DataFrame:
    return rows.select("path", F.sha2("text", 256).alias("stamp"))


_stored: dict[tuple[str, str, str], Index] = {}


def _index(spark: SparkSession, folder: str, kind: str, build) -> Index:
    """An index is built once per session and then searched, as a user would."""
    key = (spark.sparkContext.applicationId, folder, kind)
    if key not in _stored:
        index = Index(spark, new_folder(spark, f"index-{kind}"))
        index.refresh(build())
        _stored[key] = index
    return _stored[key]


def document_index(spark: SparkSession, folder: str) -> Index:
    return _index(
        spark, folder, "documents",
        lambda: DocumentSource(documents(spark, folder), "documents"),
    )


def field_index(spark: SparkSession, folder: str) -> Index:
    return _index(
        spark, folder, "fields",
        lambda: FieldSource(field_tables(spark, folder), FIELDS, KEYS, database=DATABASE),
    )


def corpus(spark: SparkSession, folder: str) -> Corpus:
    return document_index(spark, folder).corpus()


def specs(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Every case of written queries, around every benchmark text."""
    quoted = F.to_json(F.array("text"))
    places = {TEXT: F.col("text"), JSON: F.expr("substring(quoted, 2, char_length(quoted) - 2)")}
    cases = plain_cases() if kind == "plain" else json_cases()
    forms = [F.concat(*(places.get(piece, F.lit(piece)) for piece in case.spec)) for case in cases]
    return (
        table(spark, folder, "benchmark")
        .withColumn("quoted", quoted)
        .select("item_id", F.posexplode(F.array(*forms)).alias("form", "spec"))
        .select((F.col("item_id") * 1000 + F.col("form")).alias("query_id"), "spec")
    )
