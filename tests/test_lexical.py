from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.operators import lexical as L
from gleaner.operators import ranking as K
from gleaner.plans import corpus as R
from gleaner.plans import search as S

WORDS = [f"word{i}" for i in range(40)]


def make_documents(spark, count=60, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        body = " ".join(rng.choices(WORDS, weights=range(1, 41), k=rng.randrange(0, 300)))
        rows.append((f"{rng.choice(WORDS)}/{i:03}.txt", body, None))
    return spark.createDataFrame(rows, "path string, text string, source string")


def brute_bm25(passages, query):
    """Scores by (path, ordinal), from the definition."""
    import re

    words = {
        (p.path, p.ordinal): (
            Counter(re.findall(r"[a-z0-9]+", p.path)),
            Counter(re.findall(r"[a-z0-9]+", p.text)),
        )
        for p in passages
    }
    sizes = {k: sum(a.values()) + sum(b.values()) for k, (a, b) in words.items()}
    mean = sum(sizes.values()) / len(sizes)
    scores = {}
    for term in dict.fromkeys(query.split()):
        holders = [k for k, (a, b) in words.items() if term in a or term in b]
        idf = max(math.log((len(sizes) - len(holders) + 0.5) / (len(holders) + 0.5)), 1e-6)
        for key in holders if holders else []:
            f = 5 * words[key][0][term] + words[key][1][term]
            norm = 1.2 * (0.25 + 0.75 * sizes[key] / mean)
            scores[key] = scores.get(key, 0.0) + idf * f * 2.2 / (f + norm)
    return {key: round(value, 6) for key, value in scores.items()}


@pytest.mark.parametrize("single", [True, False])
def test_shortlist_matches_brute_force(spark, single):
    documents = make_documents(spark)
    query = "word1 word2 word39 absent word1"
    corpus = R.scan(documents, query, 256)
    queries = S.one_query(spark, query)
    scores = brute_bm25(corpus.passages.collect(), query)
    best = {}
    for (path, ordinal), score in sorted(scores.items(), key=lambda e: (e[0][0], e[0][1])):
        if path not in best or score > best[path][0]:
            best[path] = (score, ordinal)
    order = sorted(best, key=lambda p: (-best[p][0], p))
    everyone = sorted(row.path for row in documents.collect())
    for limit in (5, 58):
        expected = [(p, best[p][1], best[p][0], 0) for p in order[:limit]]
        rest = [p for p in everyone if p not in order[:limit]]
        expected += [(p, 0, None, 1) for p in rest[: limit - len(expected)]]
        found = corpus.shortlist(queries, limit, single).collect()
        found = sorted(found, key=lambda r: (r.tier, -(r.bm25 or 0), r.path))
        assert [r.path for r in found] == [e[0] for e in expected]
        assert [r.ordinal for r in found] == [e[1] for e in expected]
        for row, e in zip(found, expected):
            assert row.bm25 is None if e[2] is None else abs(row.bm25 - e[2]) < 2e-6


def test_fill_serves_each_query_on_its_own(spark):
    documents = make_documents(spark, 30)
    rows = [(1, "word39"), (2, "😀"), (3, "absent")]
    queries = spark.createDataFrame(rows, "query_id long, query string")
    corpus = R.scan(documents, "word39", 256)
    found = corpus.shortlist(queries, 20).collect()
    counts = Counter(row.query_id for row in found)
    assert counts == {1: 20, 2: 20, 3: 20}
    assert len({(r.query_id, r.path) for r in found}) == 60
    first = sorted(row.path for row in documents.collect())[:20]
    assert sorted(r.path for r in found if r.query_id == 2) == first


@pytest.mark.parametrize("where", ["path", "last passage"])
def test_a_word_is_found_wherever_it_stands(spark, where):
    rows = [(f"ledger/{i}", "barley hops malt " * 90, None) for i in range(6)]
    if where == "path":
        rows.append(("ledger/saffron-7", "empty", None))
    else:
        rows.append(("ledger/7", "barley hops malt " * 90 + "saffron", None))
    documents = spark.createDataFrame(rows, "path string, text string, source string")
    corpus = R.scan(documents, "saffron", 256)
    row = corpus.candidates(S.one_query(spark, "saffron"), 1, True).first()
    assert row.path == rows[-1][0] and (row.ordinal > 0) == (where != "path")


def test_every_document_takes_one_place_however_often_it_matches(spark):
    rows = [(f"d{i}", "malt " * 200 * (i + 1), None) for i in range(4)] + [("e", "hops", None)]
    documents = spark.createDataFrame(rows, "path string, text string, source string")
    found = R.scan(documents, "malt", 256).shortlist(S.one_query(spark, "malt"), 4, True).collect()
    assert sorted(row.path for row in found) == ["d0", "d1", "d2", "d3"]


def test_a_limit_on_terms_is_a_choice_and_reported(spark):
    query = " ".join(f"t{i}" for i in range(80))
    asked = S.one_query(spark, query)
    assert L.explode_terms(asked).count() == 64 and L.explode_terms(asked, None).count() == 80
    assert [L.terms_left_out(asked, limit).first().left_out for limit in (64, 90, None)] == [16, 0, 0]
    rows = [("a", "t79", None), *((f"b{i}", "other", None) for i in range(5))]
    documents = spark.createDataFrame(rows, "path string, text string, source string")
    for limit, tier in ((64, 1), (None, 0)):
        corpus = R.scan(documents, query, 256, limit)
        first = corpus.shortlist(asked, 2, True, limit).where("path = 'a'").first()
        assert first.tier == tier


def test_repeated_tokens_in_path_and_text(spark):
    rows = [("a/a/b.txt", 0, "A " * 8000 + "a! c")]
    frame = spark.createDataFrame(rows, "path string, ordinal int, text string")
    found = {r.term: (r.tf_path, r.tf_text, r.dl) for r in L.postings(frame).collect()}
    assert found == {
        "a": (2, 8001, 8006), "b": (1, 0, 8006), "c": (0, 1, 8006), "txt": (1, 0, 8006),
    }


@pytest.mark.parametrize("single", [True, False])
def test_top_per_group_matches_a_full_sort(spark, single):
    rng = random.Random(11)
    rows = [(0 if single or rng.random() < 0.7 else rng.randrange(5), rng.randrange(50) / 50, f"{i:05}")
            for i in range(4000)]
    frame = spark.createDataFrame(rows, "g int, score double, path string").repartition(100)
    top = K.top_per_group(frame, "g", [F.desc("score"), F.asc("path")], 7, single).collect()
    for group in {r[0] for r in rows}:
        expected = sorted((r for r in rows if r[0] == group), key=lambda r: (-r[1], r[2]))[:7]
        mine = sorted((r for r in top if r.g == group), key=lambda r: r.rank)
        assert [(r.g, r.score, r.path) for r in mine] == expected
        assert [r.rank for r in mine] == list(range(1, len(expected) + 1))


def test_max_pool_prefers_the_earlier_of_equal_passages(spark):
    rows = [(0, f"d{i % 30:02}", i, (i * i % 9) / 8, None) for i in range(900)]
    frame = spark.createDataFrame(
        rows, "query_id long, path string, ordinal int, score double, source string"
    )
    best = {}
    for _, path, ordinal, score, _ in rows:
        best[path] = min(best.get(path, (1, 0)), (-score, ordinal))
    found = {r.path: (-r.score, r.passage) for r in K.max_passage_score(frame).collect()}
    assert found == best
    top = K.top_k(K.max_passage_score(frame), 4).orderBy("rank").collect()
    assert [r.path for r in top] == sorted(best, key=lambda path: (best[path][0], path))[:4]
