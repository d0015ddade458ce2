"""Line-first cleaning: bad lines go first, then documents that lost too much.

Each line with a word is judged on its own by three kinds of rules:

* punctuation: it ends like a sentence, and symbols and marks of emphasis are rare;
* navigation: separators or calls to click do not chop it into a menu;
* boilerplate: it is no stock phrase of web pages and repeats no earlier line.

Lines that fail are removed, and a document is kept if it passes the base rules and
lost at most ``max_lost`` of the characters in its words.

A null text counts as having no words; it and an empty text fail the base rules.
Very long texts are read whole.  Repeated rows get the same verdict, so ties cannot
arise; an empty table gives an empty one, and other columns pass through whatever their
names.
"""

from __future__ import annotations

import re

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import batch_parts

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: How a sentence ends and may be closed, what parts menu entries, stock phrases.
SENTENCE_ENDS = ".!?…:;。！？"
CLOSERS = SPACES + "\"'”’»)]*_"
INNER_END = re.compile(r"[.!?…。！？]\s")
SEPARATOR = re.compile(r"[|»›•·>]|::|->")
EMPHASIS = re.compile(r"[!?]{2,}")
STOCK_PHRASES = (
    "cookie policy", "accept cookies", "accept all cookies", "we use cookies",
    "all rights reserved", "terms of use", "terms of service", "terms and conditions",
    "privacy policy", "subscribe now", "subscribe to our", "sign in", "sign up", "log in",
    "click here", "read more", "skip to content", "skip to main content",
    "enable javascript", "share this", "share on", "follow us", "back to top", "lorem ipsum",
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_SHARE = 0.1
MAX_EMPHASIS_SHARE = 0.3
MAX_SEPARATOR_SHARE = 0.25
STOCK_WORDS = 30
MAX_LOST = 0.4

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_bad_lines long"
)


def words_of(text: str) -> list[bytes]:
    """Runs without space, tab, line feed, vertical tab, form feed or carriage return."""
    return text.encode("utf-8", "surrogatepass").split()


def word_chars_of(text: str) -> int:
    return len(text) - sum(map(text.count, SPACES))


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of three words that the text has more than once."""
    if len(words) < 4:
        return 0
    last_place = dict(zip(words, range(len(words)), strict=True))
    codes = np.fromiter(map(last_place.__getitem__, words), np.int64, len(words))
    pairs = codes[:-1] * len(words) + codes[1:]
    if len(words) > 2_000_000:  # three codes would not fit 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(words) + codes[2:]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    found = np.isin(windows, twice)
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(found)] |= found
    return int(covered.sum())


def count_symbols(text: str) -> int:
    return sum(map(text.count, SYMBOLS))


def bad_line(line: str, n_words: int) -> bool:
    """Punctuation, navigation and boilerplate rules for one line that has words."""
    stripped = line.rstrip(CLOSERS)
    if not (stripped and stripped[-1] in SENTENCE_ENDS) and not INNER_END.search(line):
        return True
    if count_symbols(line) > MAX_SYMBOL_SHARE * word_chars_of(line):
        return True
    if len(EMPHASIS.findall(line)) > max(1, MAX_EMPHASIS_SHARE * n_words):
        return True
    if len(SEPARATOR.findall(line)) >= max(2, MAX_SEPARATOR_SHARE * n_words):
        return True
    if n_words > STOCK_WORDS:
        return False
    lowered = line.lower()
    return any(phrase in lowered for phrase in STOCK_PHRASES)


def judge(text: str | None, max_lost: float = MAX_LOST) -> tuple[tuple, list[str]]:
    """All of ``FIELDS`` for one text, and its good lines."""
    text = text or ""
    words = words_of(text)
    word_chars = word_chars_of(text)
    good, seen, n_lines, n_repeated, n_bad, lost = [], set(), 0, 0, 0, 0
    for line in text.split("\n"):
        n_words = len(words_of(line))
        if not n_words:
            good.append(line)
            continue
        n_lines += 1
        repeat = line in seen
        n_repeated += repeat
        seen.add(line)
        if repeat or bad_line(line, n_words):
            n_bad += 1
            lost += word_chars_of(line)
        else:
            good.append(line)
    repeated = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * len(words)
    kept = not failed and lost <= max_lost * word_chars
    symbols = count_symbols(text)
    return (len(words), word_chars, symbols, n_repeated, repeated, failed, kept, n_lines, n_bad), good


def rules(max_lost: float = MAX_LOST):
    """The verdict on a text column as a struct of ``FIELDS``."""
    names = [field.split()[0] for field in FIELDS.split(", ")]

    @F.pandas_udf(FIELDS)
    def verdict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(text, max_lost)[0] for text in texts], columns=names)

    # Nondeterministic for the planner, so that a filter on the verdict runs it only once.
    return verdict.asNondeterministic()


def clean(docs: DataFrame, text: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """The kept documents, without their bad lines and with the same columns.

    A task holds the cleaned texts of a few megabytes of documents at a time.
    """
    place, kept = docs.columns.index(text), FIELDS.split(", ").index("kept boolean")

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch_parts(batch, place):
                rows, texts = [], []
                for row, value in enumerate(part.column(place).to_pylist()):
                    verdict, good = judge(value, max_lost)
                    if verdict[kept]:
                        rows.append(row)
                        texts.append("\n".join(good))
                columns = part.take(pa.array(rows, pa.int64())).columns
                columns[place] = pa.array(texts, part.column(place).type)
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return docs.mapInArrow(cleaned, docs.schema)
