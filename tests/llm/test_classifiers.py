"""Language, quality and toxicity: held-out accuracy on the driver's tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import language_id, linear, quality_classifier, queries, toxicity_crf
from tests.llm.conftest import FOLDER

LARGER = "/root/testdata/sf0.01"


def held_out(spark, query, label, column="predicted"):
    if label == "lang":
        truth = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang")
    else:
        truth = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", label)
    rows = query(spark, LARGER).where("held_out").join(truth, "doc_id").collect()
    return [(row[column], row[label]) for row in rows]


def test_languages(spark):
    found = held_out(spark, queries.op1_language_id, "lang", "lang_pred")
    assert np.mean([a == b for a, b in found]) > 0.97


def test_quality(spark):
    found = held_out(spark, queries.op7_quality_classifier, "quality")
    assert np.mean([a == b for a, b in found]) > 0.95


def test_toxicity(spark):
    found = held_out(spark, queries.op9_toxicity_crf, "toxic")
    assert np.mean([a == b for a, b in found]) > 0.95


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    x, truth = rng.normal(size=(300, 5)), np.array([1.0, -2, 0.5, 0, 3])
    signs = np.sign(x @ truth + 0.3)
    weights = linear.dual_coordinate_descent([(np.arange(5), row) for row in x], signs, 5, cost=10, epochs=60)
    assert np.mean(np.sign(x @ weights[:-1] + weights[-1]) == signs) > 0.95


def test_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    transitions = rng.normal(size=(2, 2))
    lengths = np.array([1, 4, 2, 6])
    emissions = rng.normal(size=lengths.sum())
    found = toxicity_crf.marginals(emissions, lengths, transitions)
    start = 0
    for size in lengths:
        own, weights = emissions[start : start + size], []
        paths = [[i >> k & 1 for k in range(size)] for i in range(2**size)]
        for path in paths:
            score = sum(e for e, s in zip(own, path) if s) + sum(transitions[a, b] for a, b in zip(path, path[1:]))
            weights.append(np.exp(score))
        share = np.array(weights) / sum(weights)
        assert np.allclose(found[start : start + size], share @ np.array(paths))
        start += size


def test_pair_expectations_match_enumeration():
    rng = np.random.default_rng(3)
    for _ in range(20):
        transitions, lengths = rng.normal(size=(2, 2)), np.array([1, 5, 2, 6])
        emissions = 2 * rng.normal(size=lengths.sum())
        expected, start = np.zeros((2, 2)), 0
        for size in lengths:
            own, weights, counts = emissions[start : start + size], [], []
            for i in range(2**size):
                path = [i >> k & 1 for k in range(size)]
                pairs = list(zip(path, path[1:]))
                score = sum(e for e, s in zip(own, path) if s) + sum(transitions[a, b] for a, b in pairs)
                weights.append(np.exp(score))
                counts.append(np.bincount([2 * a + b for a, b in pairs], minlength=4).reshape(2, 2))
            expected += np.tensordot(np.array(weights) / sum(weights), np.array(counts), 1)
            start += size
        assert np.allclose(toxicity_crf.pair_expectations(emissions, lengths, transitions), expected)


def test_pairs_of_labels_are_counted_within_sentences():
    found = toxicity_crf.pair_counts(np.array([0, 1, 1, 1, 0, 1.0]), np.array([3, 1, 2]))
    assert found.tolist() == [[0, 2], [0, 1]]


def test_families_come_first():
    assert language_id.family_of("de-AT") == language_id.family_of("en") != language_id.family_of("fr")
    assert language_id.family_of("xx") == "only xx"


@pytest.fixture(scope="module")
def train(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    return docs.join(labels, "doc_id").cache()


def test_odd_texts_and_empty_tables(spark, train, docs, nothing):
    text = F.col("text")
    language = language_id.fit(train, "text", "lang", F.col("doc_id"))
    quality = quality_classifier.fit(train, "text", "quality", F.col("doc_id"))
    toxic = toxicity_crf.fit(train, "text", "toxic", F.col("doc_id"))
    frame = docs.select(
        "doc_id", "text", language_id.predict(language, text).alias("l"),
        quality_classifier.score(quality, text).alias("q"), toxicity_crf.predict(toxic, text).alias("t"),
    )
    rows = frame.collect()
    assert len(rows) == docs.count()
    for row in rows:
        has_letter = any(char.isalpha() for char in row.text or "")
        assert (row.l.lang == "und") == (not has_letter)
        assert all(0 <= score <= 1 for score in (row.l.score, row.q, row.t.score))
        assert all(0 <= s.start < s.end <= len(row.text) and s.probability > 0.5 for s in row.t.spans)
    same = [row for row in rows if row.doc_id == 3]
    assert len(same) == 2 and same[0] == same[1]
    assert nothing.select(language_id.predict(language, text), quality_classifier.score(quality, text), toxicity_crf.predict(toxic, text)).collect() == []


def test_training_without_rows_or_with_one_class(spark, train, docs):
    text, order = F.col("text"), F.col("doc_id")
    none = train.where("false")
    assert docs.select(language_id.predict(language_id.fit(none, "text", "lang", order), text).alias("l")).where("l.lang != 'und'").count() == 0
    one = train.where("quality = 1")
    for frame, share in ((none, 0.5), (one, (one.count() + 1) / (one.count() + 2))):
        model = quality_classifier.fit(frame, "text", "quality", order)
        scores = {round(r[0], 9) for r in docs.select(quality_classifier.score(model, text)).collect()}
        assert scores == {round(share, 9)}
    clean = toxicity_crf.fit(train.where("toxic = 0"), "text", "toxic", order)
    assert all(r[0].score < 0.05 and not r[0].spans for r in docs.select(toxicity_crf.predict(clean, text)).collect())
