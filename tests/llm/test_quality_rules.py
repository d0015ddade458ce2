from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.llm import quality_rules as Q
from tests.llm.conftest import rows_of

SENTENCE = "The old harbour of the town was rebuilt after the great storm of that year."


def brute(text):
    """The base columns from their definition."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_base_columns_match_their_definition(spark, docs):
    odd = ["a b c a b c", "x " * 99, "a\x0bb\x0cc d e", "l\nl\n\n \nl", "# | <b> é" * 30]
    frame = docs.union(spark.createDataFrame(list(enumerate(odd, -9)), "doc_id long, text string"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    found = frame.select("text", Q.rules()(F.col("text")).alias("v")).select("text", *(f"v.{n}" for n in names))
    for row in found.collect():
        assert tuple(row[1:]) == brute(row.text)


@pytest.mark.parametrize(
    "line, bad",
    [
        (SENTENCE, False),
        (SENTENCE + ' "', False),
        ("Home | News | Sport | Weather | Contact.", True),
        ("BUY!! NOW!! CHEAP!! PILLS!! TODAY!!", True),
        ("a### b$$$ c&&& d%%% e***.", True),
        ("We use cookies to improve this page.", True),
        ("no sentence at all here", True),
        (SENTENCE + " Words after it", False),
    ],
)
def test_line_rules(line, bad):
    assert Q.bad_line(line, len(line.split())) == bad


def test_documents_are_cleaned_or_rejected(spark):
    good = "\n".join(f"Place{i} was seen by guest{i} on day{i} after rain{i} fell over hill{i} and lake{i}." for i in range(6))
    mixed = good + "\nHome | News | Sport | Weather."
    lost = "\n".join(f"menu{i} | item{i} | more{i}" for i in range(60)) + "\n" + good
    rows = [(1, good), (2, mixed), (3, lost), (4, SENTENCE), (5, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in Q.clean(frame).collect()} == {1: good, 2: good}


def test_very_long_texts(spark):
    lines = [f"Place{i} was seen by guest{i} on day{i} after rain{i} fell." for i in range(40_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join([*lines[:20_000], "menu | of | links", *lines[:5]]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in Q.clean(frame).collect()} == {1: rows[0][1], 2: "\n".join(lines[:20_000])}


def test_empty_tables_and_clashing_names(nothing, clashing, docs):
    assert Q.clean(nothing).collect() == []
    cleaned = Q.clean(clashing)
    assert cleaned.columns == clashing.columns
    assert rows_of(cleaned.select("doc_id", "text")) == rows_of(Q.clean(docs))
