"""Relevance arithmetic as Column expressions.

The lexical part is BM25 (Robertson & Zaragoza 2009) with field weights applied
to term frequencies before saturation (Robertson, Zaragoza & Taylor 2004).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.fixed import PATH_WEIGHT
from gleaner.functions import text as T

K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6
SCORER_LENGTH = 600


def idf(passages: Column, frequency: Column) -> Column:
    """Inverse passage frequency; the floor keeps very common terms ranked."""
    return F.greatest(
        F.log((passages - frequency + 0.5) / (frequency + 0.5)), F.lit(IDF_FLOOR)
    )


def weighted_frequency(tf_path: Column, tf_text: Column) -> Column:
    return tf_path * PATH_WEIGHT + tf_text


def bm25_term(weight: Column, frequency: Column, length: Column, mean: Column) -> Column:
    norm = K1 * (1 - B + B * length / mean)
    return weight * frequency * (K1 + 1) / (frequency + norm)


def _norm(length: Column) -> Column:
    return K1 * (1 - B + B * length / SCORER_LENGTH)


def _mean(total: Column, wanted: Column) -> Column:
    return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(total / F.size(wanted))


def saturation(criterion: Column, words: Column) -> Column:
    """Mean saturated frequency of the criterion's distinct terms, in [0, 1)."""

    def mean(wanted: Column) -> Column:
        norm = _norm(F.size(words))
        hits = T.term_counts(F.filter(words, lambda word: F.array_contains(wanted, word)))
        total = F.aggregate(hits, F.lit(0.0), lambda acc, hit: acc + hit["n"] / (hit["n"] + norm))
        return _mean(total, wanted)

    return T.let(T.distinct_terms(criterion), mean)


def stored_saturation(wanted: Column, judged: Column) -> Column:
    """The same from a passage's ``length`` and its ``groups`` of terms that occur equally
    often: each is intersected by hashing, whatever the number of terms."""
    norm = _norm(judged["length"])

    def add(total: Column, group: Column) -> Column:
        found = F.size(F.array_intersect(group["terms"], wanted))
        return total + found * (group["n"] / (group["n"] + norm))

    return _mean(F.aggregate(judged["groups"], F.lit(0.0), add), wanted)


def _contrast(yes: Column, no: Column) -> Column:
    return (1 + yes - no) / 2


def lexical_judgement(query: Column, yes: Column, no: Column, text: Column) -> Column:
    """A deterministic probability of relevance from token overlap alone."""

    def judge(words: Column) -> Column:
        contrast = _contrast(saturation(yes, words), saturation(no, words))
        return F.when(yes.isNull() | no.isNull(), saturation(query, words)).otherwise(contrast)

    return F.round(T.let(T.tokens(text), judge), 6)


def stored_judgement(query: Column, yes: Column, no: Column, judged: Column) -> Column:
    """The same from stored terms; the three criteria are arrays of distinct terms."""
    contrast = _contrast(stored_saturation(yes, judged), stored_saturation(no, judged))
    plain = stored_saturation(query, judged)
    return F.round(F.when(yes.isNull() | no.isNull(), plain).otherwise(contrast), 6)
