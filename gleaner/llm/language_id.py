"""Language identification in two steps: the family, then the language within it.

Families are told apart by one linear support vector machine each, against the rest.
Within a family, one machine for each pair of languages votes; ties and the score
follow the margins.  Features are counts of character n-grams of the letters of the
whole text, scaled to length one.

The families are a fixed table; a learned language outside it is a family of its own.
The model is fitted on at most about ``max_rows`` rows for each language, chosen by a
hash of the id; prediction reads the text and nothing else.

Texts that are null or have no letter are ``und`` with score 0.  Very long texts are
read whole, repeated rows get equal results, an empty table gives an empty one, and
extra columns are ignored.  With one learned language all other texts get it with
score 1; with none they are ``und`` with score 0.  Rows without a language teach nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.linear import code_points, dual_coordinate_descent, gram_buckets, probability

UNDETERMINED = "und"
BITS = 15
LONGEST = 3
MAX_ROWS = 1000
#: Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "semitic": "ar he mt am",
    "indo-aryan": "hi bn ur mr gu pa ne si",
    "dravidian": "ta te kn ml",
    "iranian": "fa ps ku tg",
    "sinitic": "zh yue",
    "austronesian": "id ms tl jv",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
LETTERS = regex.compile(r"\p{L}+")


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().split("-")[0].split("_")[0], f"only {lang}")


def grams(text: str | None) -> np.ndarray:
    """A bucket for every n-gram of the lower-cased words; none if there is no letter."""
    words = LETTERS.findall((text or "").lower())
    if not words:
        return np.empty(0, np.int64)
    return gram_buckets(code_points(" " + " ".join(words) + " "), LONGEST, BITS)


def scaled_counts(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(found, minlength=1)
    columns = np.flatnonzero(counts)
    values = np.sqrt(counts[columns].astype(float))
    return columns, values / np.sqrt(values @ values)


@dataclass
class Model:
    """Machines as columns of one matrix, and which of them answers what."""

    families: dict[str, list[str]]
    weights: np.ndarray
    family_column: dict[str, int] = field(default_factory=dict)
    pair_column: dict[tuple[str, str], int] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = grams(text)
        if not len(found) or not self.families:
            return UNDETERMINED, 0.0
        columns, values = scaled_counts(found)
        margins = values @ self.weights[columns] + self.weights[-1]
        names = list(self.families)
        family, certain = names[0], 1.0
        if len(names) > 1:
            against = np.array([margins[self.family_column[name]] for name in names])
            family = names[int(np.argmax(against))]
            shares = probability(2 * against)
            certain = float(shares.max() / shares.sum())
        langs = self.families[family]
        votes = {lang: 0.0 for lang in langs}
        wins = {lang: 0 for lang in langs}
        for first, second in combinations(langs, 2):
            margin = margins[self.pair_column[first, second]]
            wins[first if margin >= 0 else second] += 1
            votes[first] += float(probability(2 * margin))
            votes[second] += float(probability(-2 * margin))
        best = max(langs, key=lambda lang: (wins[lang], votes[lang]))
        share = votes[best] / sum(votes.values()) if len(langs) > 1 else 1.0
        return best, certain * share


def fit_rows(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """Rows are (language, columns, values)."""
    langs = sorted({lang for lang, _, _ in rows})
    families: dict[str, list[str]] = {}
    for lang in langs:
        families.setdefault(family_of(lang), []).append(lang)
    labels = np.array([lang for lang, _, _ in rows])
    owners = np.array([family_of(lang) for lang, _, _ in rows])
    vectors = [(columns, values) for _, columns, values in rows]
    machines: list[np.ndarray] = []
    model = Model(families, np.zeros(((1 << BITS) + 1, 0)))
    if len(families) > 1:
        for name in families:
            model.family_column[name] = len(machines)
            machines.append(dual_coordinate_descent(vectors, np.where(owners == name, 1.0, -1.0), 1 << BITS))
    for own in families.values():
        for first, second in combinations(own, 2):
            chosen = np.flatnonzero((labels == first) | (labels == second))
            signs = np.where(labels[chosen] == first, 1.0, -1.0)
            model.pair_column[first, second] = len(machines)
            machines.append(dual_coordinate_descent([vectors[i] for i in chosen], signs, 1 << BITS))
    if machines:
        model.weights = np.column_stack(machines)
    return model


def fit(labelled: DataFrame, text: str, lang: str, order: Column, max_rows: int = MAX_ROWS) -> Model:
    """Fit on rows with a language; ``order`` is what the choice of rows hashes.

    What reaches the driver is bounded by ``max_rows``, the languages and the buckets.
    """
    labelled = labelled.where(F.col(lang).isNotNull())
    counts = {row[lang]: row["count"] for row in labelled.groupBy(lang).count().collect()}
    wanted = F.lit(False)
    place = F.pmod(F.xxhash64(order), F.lit(1 << 30))
    for name, count in sorted(counts.items()):
        wanted = wanted | ((F.col(lang) == name) & (place < int(min(1.0, max_rows / count) * (1 << 30))))

    @F.pandas_udf("struct<columns:array<int>,values:array<float>>")
    def vector(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for value in texts:
            found = grams(value)
            columns, values = scaled_counts(found) if len(found) else (found, found)
            rows.append((columns.astype(np.int32), values.astype(np.float32)))
        return pd.DataFrame(rows, columns=["columns", "values"])

    chosen = labelled.where(wanted).select(F.col(lang).alias("lang"), vector(F.col(text)).alias("v"))
    rows = [
        (row["lang"], np.asarray(row["v"]["columns"], np.int64), np.asarray(row["v"]["values"], float))
        for row in chosen.toLocalIterator()
    ]
    return fit_rows([row for row in rows if len(row[1])])


def predict(model: Model, text: Column) -> Column:
    """``struct<lang, score>`` for a text column."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang:string,score:double>")
    def language(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(value) for value in texts], columns=["lang", "score"])

    return language.asNondeterministic()(text)
