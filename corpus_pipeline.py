"""A corpus pipeline of five stages over the ``documents`` table.

Each stage takes (spark, docs, folder of tables) and returns a frame that is written
as Parquet and read again as the next stage's documents.  All but the last keep the
columns of ``documents``.

Null, blank and very short texts leave in the first stage, because they fail the base
rules.  Repeated rows with one id stay together; of copies under several ids the
smallest id stays.  Empty tables pass through as empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import bpe, decontamination, ngram_join, pii, quality_rules
from gleaner.llm.common import read, stored

TOKENIZER = "byte_bpe_50k.tiktoken"
KEY = "surrogate-key"


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove bad lines, then the documents that the quality rules reject."""
    return quality_rules.clean(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of linked documents."""
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark passage."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put surrogates in place of personal data."""
    return pii.anonymize(docs, KEY)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number, and the digest of what they decode to."""
    path = public_tokenizers.path(TOKENIZER)
    encoded = bpe.encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(bpe.decode(F.col("ids"), path), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", clean_lines),
    ("n-gram Jaccard join", drop_copies),
    ("benchmark decontamination", drop_contaminated),
    ("PII", replace_pii),
    ("byte-level BPE", encode),
]

#: SQL expresses neither the alignment, the keyed surrogates nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
