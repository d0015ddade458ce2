from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from gleaner.llm import lexical_search as S
from tests.check_queries import compare
from tests.llm.conftest import FOLDER, rows_of

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return WORD.findall((text or "").translate(AZ))


def brute(docs, items, k):
    held = [(number, Counter(found), len(found)) for number, text in docs if (found := terms(text))]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(term for _, counts, _ in held for term in counts)
    rows = []
    for item, text in items:
        scores = []
        for number, counts, n in held:
            m = 50 + (50 * n * n_docs) // total
            score = 0
            for term in set(terms(text)) & set(counts):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                score += w * ((10**9 * counts[term]) // (1000 * counts[term] + 20 * m))
            if score > 0:
                scores.append((-score, number is not None, number))
        for rank, (score, _, number) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1):
            rows.append((item, rank, number, -score))
    return sorted(rows, key=repr)


def searched(spark, docs, items, k):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = S.ImpactIndex(frame).search(asked, k).select("item_id", "rank", "doc_id", "score")
    return sorted((tuple(r) for r in found.collect()), key=repr)


def corpus(seed=3, count=900):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["É", "naïve", "日本", "x1"]
    chances = [1 / (1 + i) for i in range(len(words))]
    docs = []
    for number in range(count):
        size = rng.choice((0, 1, 3, 10, 60, 400))
        text = rng.choice((" ", "-", "\x7f", "\n")).join(rng.choices(words, chances, k=size))
        docs.append((number - 20, text.upper() if rng.random() < 0.1 else text))
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(40)]
    return docs, items


@pytest.mark.parametrize("k", [1, 5, 50])
def test_results_match_the_definition(spark, k):
    docs, items = corpus()
    assert searched(spark, docs, items, k) == brute(docs, items, k)


def test_blocks_of_queries(spark, monkeypatch):
    docs, items = corpus(4, 200)
    monkeypatch.setattr(S, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(S, "BLOCK_TERMS", 60)
    assert searched(spark, docs, items, 10) == brute(docs, items, 10)


def test_nulls_ties_repeated_rows_and_long_texts(spark):
    long = "harbour " * 400_000 + "tide"
    docs = [(5, "tide Harbour"), (4, "tide harbour"), (4, "tide harbour"), (None, "tide harbour"), (None, None)]
    docs += [(6, ""), (7, " .,-"), (8, long), (9, "other words here"), (10, "More Other")]
    items = [(1, "tide"), (1, "tide"), (2, None), (None, "harbour tide"), (3, ""), (4, "nowhere"), (5, long)]
    for k in (2, 50):
        assert searched(spark, docs, items, k) == brute(docs, items, k)


def test_empty_tables_and_clashing_names(spark, docs, nothing, clashing):
    items = spark.createDataFrame([(1, "the of and"), (2, "la de")], "item_id long, text string")
    assert S.ImpactIndex(nothing).search(items).collect() == []
    index = S.ImpactIndex(docs)
    assert index.search(items.where("false")).collect() == []
    wide = clashing.withColumns({name: F.lit(1) for name in ("terms", "norm", "bucket", "query", "rank", "score")})
    asked = items.withColumns({name: F.lit("x") for name in ("query", "doc_id", "rank", "item")})
    assert rows_of(S.ImpactIndex(wide).search(asked)) == rows_of(index.search(items))


def test_string_items_and_extra_columns(spark, docs):
    items = spark.createDataFrame([("a", "the of and"), ("b", "la de")], "name string, body string")
    found = S.ImpactIndex(docs).search(items, 3, "name", "body")
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 6


def test_buckets_are_searched_from_the_longest_vectors_down(spark):
    docs, _ = corpus(5, 400)
    index = S.ImpactIndex(spark.createDataFrame(docs, "doc_id long, text string"))
    rounds = list(index.rounds())
    assert len(rounds) > 1 and [b for r in rounds for b in r] == [b for b, _ in index.buckets]
    lengths = {r.bucket: (r.low, r.high) for r in index.vectors.groupBy("bucket").agg(
        F.min("norm").alias("low"), F.max("norm").alias("high")).collect()}
    for bucket, (low, high) in lengths.items():
        assert 2 ** (bucket / S.BUCKETS) <= low * S.MARGIN and high < 2 ** ((bucket + 1) / S.BUCKETS) * S.MARGIN


def test_short_vectors_and_hopeless_pairs_are_pruned():
    asked = S.Queries([b"a", b"b"], [np.array([0, 1])], np.array([100, 10]))
    asked.thresholds[:] = 50_000_000
    best = S.Best(asked.thresholds, 5)
    ids, peaks = np.array([1, 2]), np.array([400_000, 500_000])
    rows, places = np.array([0, 1]), np.array([1, 0])
    impacts = np.array([400_000, 500_000])
    norms = np.array([400_000.0, 500_000.0])
    S.score_part(asked, best, ids, norms, peaks, rows, places, impacts)
    # The first document is too short for the threshold, the second reaches it exactly.
    assert best.rows.tolist() == [[0, 50_000_000, 2]]


def test_query_matches_its_sql(spark):
    name = "op13_lexical_search"
    message, _, good = compare(spark, FOLDER, name, contract.queries()[name], contract.oracle_sql()[name])
    assert good, message
