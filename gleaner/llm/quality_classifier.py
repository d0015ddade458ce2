"""Quality classifier: naive Bayes support vectors.

Indicators of character n-grams and of shapes of neighbouring words are scaled by the
log ratio of their smoothed counts in the two classes; a linear hinge-loss model is
then fitted by dual coordinate descent, and a logistic curve turns margins into scores.

The model is fitted on at most about ``max_rows`` labelled rows, chosen by a hash of
the id; prediction reads every text whole and nothing but the text.

Null texts count as empty.  An empty text gets the score of a row without features.
Very long texts are read whole, repeated rows get equal scores, and an empty table
gives an empty one.  If the training rows hold one class only, all scores are that
class's share with add-one smoothing (0.5 without any row).  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.linear import code_points, dual_coordinate_descent, gram_buckets, logistic_fit, probability

BITS = 17
LONGEST = 3
MAX_ROWS = 4000
BETA = 0.25
REPEAT = "="


def word_shape(word: str) -> str:
    """A sign for the case of a word and for the mark it ends with."""
    case = 3 if word.islower() else 2 if word.isupper() else 1
    mark = 0 if word[-1].isalnum() else min(ord(word[-1]), 255)
    return chr(0xE000 + case * 256 + mark)


def shapes(text: str) -> str:
    """One sign for each word, a sign of its own where it repeats the word before."""
    words = text.split()
    return "".join(
        REPEAT if word == before else word_shape(word)
        for before, word in zip([None, *words], words, strict=False)
    )


def features(text: str | None) -> np.ndarray:
    """The buckets that the text has, sorted."""
    text = text or ""
    seen = np.zeros(1 << BITS, bool)
    seen[gram_buckets(code_points(text), LONGEST, BITS)] = True
    seen[gram_buckets(code_points(shapes(text)), LONGEST, BITS)] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    curve: np.ndarray

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum() / np.sqrt(max(len(found), 1))) + self.bias

    def score(self, text: str | None) -> float:
        return float(probability(self.curve[0] * self.margin(features(text)) + self.curve[1]))


def fit_rows(rows: list[tuple[np.ndarray, int]]) -> Model:
    labels = np.array([label for _, label in rows], np.int64)
    size = 1 << BITS
    if not len(rows) or labels.min() == labels.max():
        share = (labels.sum() + 1) / (len(rows) + 2)
        return Model(np.zeros(size), 0.0, np.array([0.0, np.log(share / (1 - share))]))
    counts = np.ones((2, size))
    for found, label in rows:
        counts[label, found] += 1
    shares = counts / (np.bincount(labels, minlength=2)[:, None] + 2)
    ratios = np.log(shares[1]) - np.log(shares[0])
    scaled = [(found, ratios[found] / np.sqrt(max(len(found), 1))) for found, _ in rows]
    fitted = dual_coordinate_descent(scaled, np.where(labels > 0, 1.0, -1.0), size)
    weights = fitted[:-1]
    # Interpolation between naive Bayes and the support vectors.
    mean = np.abs(weights).mean()
    weights = ((1 - BETA) * mean + BETA * weights) * ratios if BETA < 1 else weights * ratios
    model = Model(weights, BETA * float(fitted[-1]), np.array([1.0, 0.0]))
    margins = np.array([model.margin(found) for found, _ in rows])
    model.curve = logistic_fit(margins[:, None], labels)
    return model


def fit(labelled: DataFrame, text: str, label: str, order: Column, max_rows: int = MAX_ROWS) -> Model:
    """Fit on rows with a label; ``order`` is what the choice of rows hashes.

    What reaches the driver is bounded by ``max_rows`` times the number of buckets.
    """
    labelled = labelled.where(F.col(label).isin(0, 1))
    total = labelled.count()
    part = min(1.0, max_rows / max(total, 1))
    chosen = labelled.where(F.pmod(F.xxhash64(order), F.lit(1 << 30)) < int(part * (1 << 30)))

    @F.pandas_udf("array<int>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([features(value).astype(np.int32) for value in texts], dtype=object)

    rows = chosen.select(found(F.col(text)).alias("found"), F.col(label).cast("int").alias("label"))
    return fit_rows([(np.asarray(row.found, np.int64), row.label) for row in rows.toLocalIterator()])


def score(model: Model, text: Column) -> Column:
    """The probability of label 1 for a text column."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def predict(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(value) for value in texts], dtype=float)

    return predict(text)
