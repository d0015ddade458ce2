"""Text functions as Column expressions: folding, tokens, windows, encoding.

Everything here runs inside the JVM.  Text is measured in Unicode code points.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.fixed import MAX_OVERLAP, MAX_QUERY_TERMS, OVERLAP_SHARE

TOKEN = r"[\p{L}\p{N}\p{Mc}]+"
WINDOWS_PER_BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once for a body that uses it several times or in a lambda.

    A plain reference would be evaluated again for every element of the array
    that the lambda runs over.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """Return the two arguments of ``translate`` that remove diacritics.

    A letter whose canonical decomposition is one base followed only by non-spacing
    marks maps to its base; a letter whose caseless form is one other letter maps to
    that; such marks standing alone map to nothing.  Spacing marks belong to their
    word, in Indic scripts above all, and stay.  All of Unicode is covered.
    """
    sources, targets, dropped = [], [], []
    for code in chain(range(0x80, 0xD800), range(0xE000, 0x110000)):
        char = chr(code)
        if unicodedata.category(char) == "Mn":
            dropped.append(char)
            continue
        base, *rest = unicodedata.normalize("NFD", char)
        if any(unicodedata.category(mark) != "Mn" for mark in rest):
            continue
        caseless = base.casefold()
        target = caseless if len(caseless) == 1 and base == base.lower() else base
        if target != char:
            sources.append(char)
            targets.append(target)
    return "".join(sources + dropped), "".join(targets)


def fold(text: Column) -> Column:
    """Lower-case and strip diacritics; plain ASCII skips the character table."""
    lowered = F.lower(text)
    source, target = fold_table()
    is_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(is_ascii, lowered).otherwise(F.translate(lowered, source, target))


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits, in text order."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def distinct_terms(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def query_terms(text: Column, limit: int | None = MAX_QUERY_TERMS) -> Column:
    """The distinct terms used for lexical matching: the first ``limit`` in order, or all."""
    terms = distinct_terms(text)
    return terms if limit is None else F.slice(terms, 1, limit)


def sorted_line(words: Column) -> Column:
    """Tokens sorted into one string, each followed by a space."""
    return F.concat(F.array_join(F.sort_array(words), " "), F.lit(" "))


def term_counts(words: Column) -> Column:
    """Count equal tokens of one row: ``array<struct<term, n>>``, sorted by term.

    Sorting makes equal tokens neighbours, and a back-reference then cuts the
    joined string at every change of token.  The row never leaves its task, so
    counting needs no shuffle.
    """
    runs = F.regexp_extract_all(sorted_line(words), F.lit(r"([^ ]+ )\1*"), F.lit(0))

    def entry(run: Column) -> Column:
        term = F.substring_index(run, " ", 1)
        repeats = F.char_length(run) / (F.char_length(term) + 1)
        return F.struct(term.alias("term"), repeats.cast("int").alias("n"))

    return F.transform(runs, entry)


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode white space."""
    space = r"[\p{IsWhite_Space}\x1c-\x1f]"
    return F.regexp_replace(text, rf"\A{space}+|{space}+\z", "")


def percent_encode(text: Column) -> Column:
    """Percent-encode everything except ASCII letters, digits and ``_.-~``."""
    encoded = F.url_encode(text)
    for plain, fixed in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(plain), F.lit(fixed))
    return encoded


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def json_text(text: Column) -> Column:
    """A JSON string literal, quotes included."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)\A\[(.*)\]\z", 1)


def overlap_for(size: int) -> int:
    """Windows overlap by a tenth of their size, at most 400 code points."""
    return min(MAX_OVERLAP, size // OVERLAP_SHARE)


def window_count(text: Column, size: int) -> Column:
    """How many overlapping windows cover the text; an empty text has one."""
    overlap = overlap_for(size)
    beyond = F.char_length(text) - overlap
    return F.greatest(F.lit(1), F.ceil(beyond / (size - overlap)).cast("int"))


def window_at(text: Column, ordinal: Column, size: int) -> Column:
    """One window of a text, without cutting the others."""
    step = size - overlap_for(size)
    return F.substring(text, ordinal * step + 1, F.lit(size))


def windows(text: Column, size: int) -> Column:
    """All overlapping windows of a text as an array.

    ``substring`` walks from the start of its argument, so cutting every window
    from the whole text is quadratic in its length.  Blocks of 64 windows are
    cut first and the windows inside each block after that.
    """
    step = size - overlap_for(size)
    stride = WINDOWS_PER_BLOCK * step

    def blocks(count: Column) -> Column:
        last = F.floor((count - 1) / WINDOWS_PER_BLOCK).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda block: F.struct(
                F.substring(text, block * stride + 1, F.lit(stride + size - step)).alias("text"),
                F.least(F.lit(WINDOWS_PER_BLOCK), count - block * WINDOWS_PER_BLOCK).alias("count"),
            ),
        )

    def cut(block: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), block["count"] - 1),
            lambda k: F.substring(block["text"], k * step + 1, F.lit(size)),
        )

    return F.flatten(F.transform(let(window_count(text, size), blocks), cut))
