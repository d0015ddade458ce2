from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gleaner.llm import decontamination as D
from tests.llm.conftest import FOLDER

ALPHABET = "abcdefgh "


def best_distance(passage, text):
    """Edits of the best place for a whole passage in a text, from the full table."""
    above = [0] * (len(text) + 1)
    for i, char in enumerate(passage, 1):
        row = [i]
        for j, other in enumerate(text, 1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (char != other)))
        above = row
    return min(above)


def edited(rng, passage, count):
    chars = list(passage)
    for _ in range(count):
        at = rng.randrange(len(chars))
        kind = rng.random()
        if kind < 0.34:
            chars[at] = "z"
        elif kind < 0.67:
            chars.insert(at, "y")
        else:
            del chars[at]
    return "".join(chars)


def test_hits_are_those_of_the_full_table():
    rng = random.Random(8)
    passages = ["".join(rng.choices(ALPHABET, k=rng.randrange(30, 160))).strip() for _ in range(12)]
    indexes = D.build(list(enumerate(passages)), D.EDIT_RATE)
    for _ in range(150):
        number = rng.randrange(len(passages))
        budget = int(len(passages[number]) * D.EDIT_RATE)
        part = edited(rng, passages[number], rng.randrange(budget + 3))
        text = "".join(rng.choices(ALPHABET, k=rng.randrange(80))) + part + "".join(rng.choices(ALPHABET, k=40))
        distance = best_distance(D.normal(passages[number]), D.normal(text))
        found = [hit for hit in D.find(text, indexes) if hit[0] == number]
        assert [hit[3] for hit in found] == ([distance] if distance <= budget else [])


def test_places_of_a_hit_and_short_passages():
    indexes = D.build([(1, "the quick brown fox jumps over it"), (2, "tiny bit"), (None, "another one")], 0.06)
    text = "x" * 9000 + " The\nQuick brown fox jumps over it, a tiny bit, another one."
    hits = {hit[0]: text[hit[1] : hit[2]].lower().replace("\n", " ") for hit in D.find(text, indexes)}
    assert hits == {1: "the quick brown fox jumps over it", 2: "tiny bit", None: "another one"}
    assert D.find("destiny bits", indexes) == []


@pytest.mark.parametrize("block", [D.BLOCK_CHARS, 300])
def test_documents_with_a_passage_are_found_and_dropped(spark, docs, block):
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    items = [D.normal(row.text).strip() for row in benchmark.collect()]
    rows = docs.collect()
    wanted = {r.doc_id for r in rows if any(item in D.normal(r.text or "") for item in items)}
    found = D.contaminated(docs, benchmark, block_chars=block).collect()
    assert wanted and {r.doc_id for r in found} == wanted
    kept = D.decontaminate(docs, benchmark, block_chars=block).collect()
    assert len(kept) + len(found) == len(rows)


def test_odd_rows_on_either_side(spark, docs, nothing, clashing):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " "), (None, "one")], "item_id long, text string")
    assert {r.doc_id for r in D.contaminated(docs, odd).collect()} == {900_004}
    assert D.contaminated(docs, odd.where("false")).count() == 0
    assert D.contaminated(nothing, odd).count() == 0
    kept = D.decontaminate(clashing, odd)
    assert kept.columns == clashing.columns and kept.count() == docs.count() - 1
    assert D.decontaminate(docs.withColumn("hits", F.lit(1)), odd).columns == ["doc_id", "text", "hits"]


def test_ids_of_strings_and_a_taken_name(spark):
    passage = "the quick brown fox jumps over the lazy dog near the old stone bridge"
    items = spark.createDataFrame([("b-7", passage), ("", passage), (None, passage)], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"So {passage} it was.", 5), (2, "clean", 6)], "doc_id long, text string, hits int")
    found = D.contaminated(docs, items, name="found").collect()
    assert [(r.doc_id, r.hits, [h.item_id for h in r.found]) for r in found] == [(1, 5, ["", "b-7", None])]
    with pytest.raises(ValueError, match="hits already"):
        D.contaminated(docs, items)
