from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from gleaner.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    "", " ", "a", "don't I'LL we've", "tabs\t\tand\n\n\nlines \r\n", "x\x85y\x1cz w　", "12 345 ٣٤ Ⅷ",
    "naïve café ☃ 😀😀", "\x00\x01\x02", "é" * 3000 + " " * 3000, "### $$$ !!! --", "的 ひらがな 한국어 עברית",
]


@pytest.fixture(scope="module")
def library():
    vocabulary = bpe.vocabulary(PATH)
    ranks = {piece: rank for rank, piece in enumerate(vocabulary.pieces)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(frame, **options):
    return bpe.encode(frame, PATH, public_tokenizers.PATTERN, **options)


def test_ids_are_those_of_the_library_and_decode_to_the_bytes(spark, docs, library):
    odd = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    frame = docs.union(odd)
    found = encoded(frame.withColumn("copy", F.col("text")), digest="digest").select(
        "copy", "ids", bpe.decode(F.col("ids"), PATH).alias("bytes"), "digest"
    )
    rows = found.collect()
    assert len(rows) == frame.count()
    for row in rows:
        ids, text = library.encode_ordinary(row.copy or ""), row.copy or ""
        assert list(row.ids) == ids and bytes(row.bytes) == text.encode()
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert row.digest == hashlib.sha256(packed).hexdigest()


def test_every_piece_is_reached_by_merges(library):
    """So a word that is a piece of its own needs no look-up besides the merges."""
    for rank, piece in enumerate(bpe.vocabulary(PATH).pieces):
        if rank % 50 == 0:
            assert library._encode_single_piece(piece) == [rank]
            parts = list(bytes([b]) for b in piece)
            ranks = {p: r for r, p in enumerate(bpe.vocabulary(PATH).pieces)}
            while len(parts) > 1:
                pairs = [ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
                at = pairs.index(min(pairs))
                assert pairs[at] < 1 << 30
                parts[at : at + 2] = [parts[at] + parts[at + 1]]


def test_small_chunks_give_the_same(docs, monkeypatch):
    whole = {r.doc_id: r.ids for r in encoded(docs).collect()}
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 500)
    assert {r.doc_id: r.ids for r in encoded(docs).collect()} == whole
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 50)
    assert {r.doc_id: r.ids for r in encoded(docs.coalesce(1)).collect()} == whole


def test_long_words_are_merged_by_pairs(spark, library):
    """A word of 200,000 letters, and words around the length at which the heap takes over."""
    letters = random.Random(3)
    words = ["".join(letters.choices("abcdehinorst", k=n)) for n in (255, 256, 257, 5_000, 200_000)] + ["a" * 9_000]
    ranks = {piece: rank for rank, piece in enumerate(bpe.vocabulary(PATH).pieces)}
    for word in words:
        assert bpe.merge_long(word.encode(), ranks) == library.encode_ordinary(word)
    frame = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    assert {r.doc_id: r.ids for r in encoded(frame).collect()} == {
        i: library.encode_ordinary(word) for i, word in enumerate(words)
    }


def test_rank_files_with_too_many_pieces_are_refused(tmp_path):
    path = tmp_path / "large.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(b"%d" % i) + b" %d\n" % i for i in (0, 1 << 16)))
    with pytest.raises(ValueError, match="65,535"):
        bpe.vocabulary(str(path))


def test_empty_tables_and_clashing_names(nothing, clashing):
    assert encoded(nothing).collect() == []
    assert set(encoded(clashing).columns) == {*clashing.columns, "ids"} - {"text"}
    with pytest.raises(ValueError, match="another"):
        encoded(clashing.withColumn("ids", F.lit(1)))


def test_the_rank_map_is_planned_as_one_literal(spark):
    """An expression for each bucket filled the driver's heap."""
    plans = spark.range(1).select(bpe.rank_map(PATH).alias("ranks"))._jdf.queryExecution()
    assert plans.analyzed().toString().count("cast(") < 3
    assert not any(name in plans.optimizedPlan().toString() for name in ("from_json", "str_to_map", "cast("))
    buckets = spark.range(1).select(F.explode(bpe.rank_map(PATH)).alias("ranks")).select(F.explode("ranks")).collect()
    found = {(key, rank) for key, rank in buckets if rank >= 0}
    assert found == {(bpe._signed(left, right), rank) for left, right, rank in bpe.vocabulary(PATH).pairs}
