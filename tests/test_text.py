from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import passages as P

TEXTS = [
    "",
    "plain words, plain WORDS",
    "Éa ÇA über été naïve_snake 12٣ 😀x",
    "αβγδε ΑΒΓ Ά" * 50,
    "a " * 9000,
    "tab\tline\nnbsp end",
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").cache()


def by_id(frame):
    return [row[1] for row in sorted(frame.collect())]


def plain_tokens(text):
    bare = "".join(
        c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c)
    )
    return re.findall(r"[^\W_]+", bare)


def test_tokens_fold_case_and_marks(rows):
    found = by_id(rows.select("id", T.tokens(F.col("text"))))
    assert found == [plain_tokens(text) for text in TEXTS]


def test_term_counts_match_a_counter(rows):
    found = by_id(rows.select("id", T.term_counts(T.tokens(F.col("text")))))
    for text, counts in zip(TEXTS, found):
        assert {c.term: c.n for c in counts} == dict(Counter(plain_tokens(text)))
        assert [c.term for c in counts] == sorted(c.term for c in counts)


def test_query_terms_are_distinct_in_order_and_capped(spark):
    words = [f"w{i}" for i in range(80)]
    frame = spark.createDataFrame([("B a b_A " + " ".join(words),)], "q string")
    terms = frame.select(T.query_terms(F.col("q"))).first()[0]
    assert terms == (["b", "a"] + words)[:64]


@pytest.mark.parametrize("size", [256, 1000, 4000])
def test_windows_cover_every_character(spark, size):
    overlap = min(400, size // 10)
    step = size - overlap
    lengths = [0, 1, size - 1, size, size + 1, step * 2, size + step, size + step + 1, step * 130 + 7]
    alphabet = "aβ😀é\n"
    texts = ["".join(alphabet[i * 7 % 5] for i in range(n)) for n in lengths]
    frame = spark.createDataFrame(
        [(f"{i:02}", t, None) for i, t in enumerate(texts)],
        "path string, text string, source string",
    )
    cut = P.chunk(frame, size)
    passages = {}
    for row in sorted(cut.collect(), key=lambda r: (r.path, r.ordinal)):
        passages.setdefault(row.path, []).append(row.text)
    for i, text in enumerate(texts):
        parts = passages[f"{i:02}"]
        assert parts[0] + "".join(part[overlap:] for part in parts[1:]) == text
        assert all(len(part) == size for part in parts[:-1])
        assert len(parts) == max(1, math.ceil((len(text) - overlap) / step))
    rebuilt = {row.path: row.text for row in P.rebuild(cut, size).collect()}
    assert rebuilt == {f"{i:02}": text for i, text in enumerate(texts)}
    last = cut.groupBy("path").agg(F.max("ordinal").alias("ordinal"))
    picked = P.cut_selected(frame, last, size)
    assert {r.path: r.text for r in picked.collect()} == {p: c[-1] for p, c in passages.items()}


def test_strip_and_percent_encoding(spark):
    values = ["  a b\n\x1f", "~*+ /é😀'()", "plain", "{\"id\":1}"]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    stripped = [r[0] for r in frame.select(T.strip(F.col("v"))).collect()]
    encoded = [r[0] for r in frame.select(T.percent_encode(F.col("v"))).collect()]
    assert stripped == [v.strip() for v in values]
    assert encoded == [quote(v, safe="") for v in values]


def test_chunk_size_is_checked():
    for size in (255, 16001):
        with pytest.raises(ValueError, match="chunk_chars"):
            P.check_chunk_chars(size)


@pytest.mark.parametrize(
    "text, words",
    [
        ("\U0002F800", ["丽"]),  # a compatibility ideograph beyond the first planes
        ("a\U000E0100b", ["ab"]),  # a variation selector is a mark without width
        ("का की", ["का", "की"]),  # spacing marks tell Indic words apart
        ("ÇA ÇA", ["ca", "ca"]),
    ],
)
def test_folding_covers_all_of_unicode(spark, text, words):
    frame = spark.createDataFrame([(text,)], "text string")
    assert frame.select(T.tokens(F.col("text")).alias("t")).first().t == words
