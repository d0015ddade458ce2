"""The registered queries of this subpackage: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import (
    bpe,
    decontamination,
    html_extraction,
    language_id,
    lexical_search,
    line_dedup,
    merkle,
    ngram_join,
    pii,
    quality_classifier,
    quality_rules,
    substring_dedup,
    toxicity_crf,
)
from gleaner.llm.common import read, remainder, small, stored

TOKENIZER = "byte_bpe_50k.tiktoken"
KEY = "surrogate-key"


def labelled(spark: SparkSession, folder: str, label: str, train: DataFrame) -> DataFrame:
    """Training rows with their label; a document labelled twice takes the larger label."""
    labels = read(spark, folder, "labels").groupBy("doc_id").agg(F.max(label).alias(label))
    return train.join(labels, "doc_id")


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = language_id.fit(docs.where(~held_out), "text", "lang", F.col("doc_id"))
    found = docs.select("doc_id", held_out.alias("held_out"), language_id.predict(model, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")


def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    pages = read(spark, folder, "pages").select("page_id", "url", "html")
    found = html_extraction.extract(pages).select("page_id", "url", "text")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The passages that documents repeat."""
    return substring_dedup.repeated_passages(read(spark, folder, "documents"))


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """The quality of every document, learned from the labels of two thirds of them."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    train = labelled(spark, folder, "quality", docs.where(~held_out))
    model = quality_classifier.fit(train, "text", "quality", F.col("doc_id"))
    scored = docs.select("doc_id", held_out.alias("held_out"), quality_classifier.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity_crf(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity of every document with its offending spans, learned from four fifths."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    labels = read(spark, folder, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labels = labels.where(remainder("doc_id", 5) != 0)
    chosen, shares = toxicity_crf.choose(labels, "toxic", F.col("doc_id"))
    train = docs.join(small(stored(chosen, "toxic-labels")), "doc_id")
    model = toxicity_crf.fit(train, "text", "toxic", F.col("doc_id"), shares=shares)
    found = docs.select("doc_id", held_out.alias("held_out"), toxicity_crf.predict(model, F.col("text")).alias("found"))
    return found.select(
        "doc_id",
        "held_out",
        "found.score",
        (F.col("found.score") >= 0.5).cast("int").alias("predicted"),
        "found.spans",
    )


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each benchmark passage found in a document."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.contaminated(docs, read(spark, folder, "benchmark"))
    return found.select("doc_id", F.inline("hits")).withColumnsRenamed({"start": "start_char", "end": "end_char"})


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with surrogates in place of its personal data."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return pii.anonymize(docs, KEY)


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    judged = docs.select("doc_id", quality_rules.rules()(F.col("text")).alias("verdict"))
    fields = [
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_lines", "n_bad_lines",
    ]
    return judged.select("doc_id", *(f"verdict.{name}" for name in fields))


def op8_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, folder, "documents"))


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    docs = read(spark, folder, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN, digest="ids_sha256")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids_sha256",
        F.sha2(bpe.decode(F.col("ids"), path), 256).alias("decoded_sha256"),
    )


def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that a document with a larger id keeps."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    kept = F.sha2(F.coalesce("text", F.lit("")), 256)
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves, roots and proofs of all documents, with a fifth of the texts tampered with."""
    lowered = F.translate("text", ascii_uppercase, ascii_lowercase)
    return merkle.manifest(read(spark, folder, "documents"), remainder("doc_id", 5) == 0, lowered)


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    index = lexical_search.ImpactIndex(read(spark, folder, "documents"))
    return index.search(read(spark, folder, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_decontamination": op2_decontamination,
        "op3_pii": op3_pii,
        "op4_html_extraction": op4_html_extraction,
        "op5_quality_rules": op5_quality_rules,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_ngram_join": op8_ngram_join,
        "op9_toxicity_crf": op9_toxicity_crf,
        "op10_bpe": op10_bpe,
        "op11_line_dedup": op11_line_dedup,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_lexical_search": op13_lexical_search,
    }
