from __future__ import annotations

import hashlib

import corpus_pipeline as C
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from gleaner.llm import bpe, decontamination, ngram_join, pii, quality_rules
from gleaner.llm.common import read, stored
from tests.llm.conftest import FOLDER


def test_every_stage_works_on_all_its_predecessor_kept(spark):
    docs = read(spark, FOLDER, "documents")
    columns = docs.columns
    benchmark = [decontamination.normal(r.text).strip() for r in read(spark, FOLDER, "benchmark").collect()]
    frames = [docs]
    for name, stage in C.STAGES:
        frames.append(stored(stage(spark, frames[-1], FOLDER), "test-stage"))
    assert all(frame.columns == columns for frame in frames[:-1])

    judged = {r.doc_id: quality_rules.judge(r.text) for r in docs.collect()}
    cleaned = {r.doc_id: r.text for r in frames[1].collect()}
    assert cleaned == {doc_id: "\n".join(good) for doc_id, (verdict, good) in judged.items() if verdict[6]}

    single = {r.doc_id for r in ngram_join.jaccard_components(frames[1]).collect() if r.doc_id == r.component_id}
    assert {r.doc_id for r in frames[2].collect()} == single

    leaks = {r.doc_id for r in frames[2].collect() if any(b in decontamination.normal(r.text) for b in benchmark)}
    assert {r.doc_id for r in frames[3].collect()} == single - leaks

    before = {r.doc_id: r.text for r in frames[3].collect()}
    after = {r.doc_id: r.text for r in frames[4].collect()}
    assert before.keys() == after.keys()
    touched = {r.doc_id for r in frames[3].where(pii.has_mention(F.col("text"))).collect()}
    assert {d for d in before if before[d] != after[d]} == touched

    vocabulary = bpe.vocabulary(public_tokenizers.path(C.TOKENIZER))
    ranks = {piece: rank for rank, piece in enumerate(vocabulary.pieces)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for row in frames[5].collect():
        ids = library.encode_ordinary(after[row.doc_id])
        assert list(row.ids) == ids and row.n_tokens == len(ids)
        assert row.decoded_sha256 == hashlib.sha256(after[row.doc_id].encode()).hexdigest()


def test_odd_rows_and_extra_columns_pass_through_all_stages(spark):
    docs = read(spark, FOLDER, "documents").limit(40)
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "x " * 60 + ".", None, None, None)], docs.schema
    )
    docs = docs.union(odd).union(docs.limit(3)).withColumn("hits", F.lit("extra")).withColumn("row", F.lit(1))
    for name, stage in C.STAGES:
        docs = stored(stage(spark, docs, FOLDER), "test-odd")
    assert docs.count() > 0


def test_an_empty_table_passes_through(spark):
    docs = read(spark, FOLDER, "documents").where("false")
    for name, stage in C.STAGES:
        docs = stored(stage(spark, docs, FOLDER), "test-empty")
    assert docs.count() == 0
