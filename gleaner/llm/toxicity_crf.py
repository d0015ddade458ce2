"""Toxicity: a linear-chain conditional random field over the words of each sentence.

Labelled tokens come from labelled documents: a word is a toxic token if it, or its
beginning, occurs in clearly more toxic documents than others.  The field is trained on
those tokens, with features of the word and its neighbours, so that it also finds
spellings that no labelled document has.  Forward-backward marginals give each word a
probability; a document's score is a logistic curve over their largest value and sum,
and runs of words above one half are the offending spans, with offsets in code points.

Fitting uses at most about ``max_rows`` labelled rows, chosen by a hash of the id, and
``max_sentences`` sentences of each kind; prediction reads every text whole.

Null, empty and wordless texts have no span and the score of a document without toxic
words.  Very long texts and sentences are read whole.  Repeated rows get equal results,
an empty table gives an empty one, and extra columns are ignored.  If the training
rows hold one class only, no word is toxic and all scores are that class's share.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import in_parts, stored
from gleaner.llm.linear import logistic_fit, probability

BITS = 18
MAX_ROWS = 6000
MAX_SENTENCES = 6000
EPOCHS = 6
BATCH = 256
PART_CHARS = 6 << 20
SHORTEST_STEM = 4
LONGEST_STEM = 6
MIN_DOCS = 4
MIN_PRECISION = 0.8
WORD = re.compile(r"[^\W\d_]+")
BREAK = re.compile(r"[.!?…\n]+")
TOKEN = re.compile(rf"{WORD.pattern}|{BREAK.pattern}")


def word_features(word: str) -> list[int]:
    """Buckets of the word itself, its beginnings and its end."""
    parts = [f"w{word}", *(f"b{word[:size]}" for size in range(3, LONGEST_STEM + 1)), f"e{word[-3:]}", "bias"]
    return [crc32(part.encode("utf-8", "surrogatepass")) >> (32 - BITS) for part in parts]


def neighbour_features(word: str | None) -> tuple[int, int]:
    """Buckets of the word as the one before, and as the one after."""
    stem = "" if word is None else word[:LONGEST_STEM]
    return tuple(
        crc32(f"{side}{stem}".encode("utf-8", "surrogatepass")) >> (32 - BITS) for side in "<>"
    )


N_FEATURES = len(word_features("word")) + 2


def sentences(text: str | None) -> list[list[str]]:
    """Lower-cased words, split at ends of sentences and lines."""
    parts = BREAK.split((text or "").lower())
    return [words for part in parts if (words := WORD.findall(part))]


def messages(
    emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight, forward and backward message of each token; sentences lie one after another.

    With two states a message is one ratio, so all sentences move a word at a time
    together, the longest first.
    """
    stay_out, enter, leave, stay_in = np.exp(transitions).ravel()
    weight = np.exp(np.clip(emissions, -30, 30))
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    ordered = lengths[order]
    forward, backward = np.empty(len(weight)), np.empty(len(weight))
    longest = int(ordered[0]) if len(ordered) else 0
    active = np.searchsorted(-ordered, -np.arange(1, longest + 1), "right")
    ratio = None
    for place in range(longest):
        at = starts[: active[place]] + place
        if place:
            ratio = ratio[: active[place]]
            ratio = weight[at] * (enter + ratio * stay_in) / (stay_out + ratio * leave)
        else:
            ratio = weight[at]
        forward[at] = ratio
    ends = starts + ordered - 1
    ratio = None
    for place in range(longest):
        at = ends[: active[place]] - place
        if place:
            ratio = ratio[: active[place]]
            after = weight[at + 1] * ratio
            ratio = (leave + after * stay_in) / (stay_out + after * enter)
        else:
            ratio = np.ones(active[0])
        backward[at] = ratio
    return weight, forward, backward


def marginals(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Probability of the toxic state of each token."""
    _, forward, backward = messages(emissions, lengths, transitions)
    odds = forward * backward
    return odds / (1 + odds)


def _inner(lengths: np.ndarray) -> np.ndarray:
    """Places of the tokens that have a next one in their sentence."""
    inner = np.ones(int(lengths.sum()), bool)
    inner[np.cumsum(lengths) - 1] = False
    return np.flatnonzero(inner)


def pair_expectations(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Expected number of each pair of neighbouring states, from the same messages."""
    weight, forward, backward = messages(emissions, lengths, transitions)
    at = _inner(lengths)
    left = np.stack([np.ones(len(at)), forward[at]])
    right = np.stack([np.ones(len(at)), weight[at + 1] * backward[at + 1]])
    tied = np.exp(transitions)[:, :, None] * left[:, None] * right[None]
    return (tied / tied.sum((0, 1))).sum(2)


def pair_counts(truth: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How often each pair of neighbouring states stands in the labels."""
    at = _inner(lengths)
    pairs = truth[at].astype(int) * 2 + truth[at + 1].astype(int)
    return np.bincount(pairs, minlength=4).reshape(2, 2).astype(float)


@dataclass
class Model:
    weights: np.ndarray
    transitions: np.ndarray
    curve: np.ndarray

    def token_probabilities(self, words: list[str], lengths: np.ndarray) -> np.ndarray:
        """Marginals for sentences of ``lengths`` words; each word's weights are added once."""
        if not words:
            return np.empty(0)
        coded = pa.array(words, pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        at = coded.indices.to_numpy()
        own = self.weights[np.array([word_features(word) for word in distinct])].sum(1)
        near = self.weights[np.array([neighbour_features(word) for word in distinct])]
        edge = self.weights[list(neighbour_features(None))]
        ends = np.cumsum(lengths)
        before = np.concatenate([[edge[0]], near[at[:-1], 0]])
        before[(ends - lengths)] = edge[0]
        after = np.concatenate([near[at[1:], 1], [edge[1]]])
        after[ends - 1] = edge[1]
        return marginals(own[at] + before + after, lengths, self.transitions)

    def many(self, texts: list[str | None]) -> list[tuple[float, list[tuple[int, int, float]]]]:
        """(score, spans) of each text."""
        cut = [sentences(text) for text in texts]
        words = [word for own in cut for sentence in own for word in sentence]
        lengths = np.array([len(sentence) for own in cut for sentence in own], np.int64)
        toxic = self.token_probabilities(words, lengths)
        found, start = [], 0
        for text, own in zip(texts, cut, strict=True):
            size = sum(map(len, own))
            part = toxic[start : start + size]
            start += size
            score = float(probability(document_margins(part) @ self.curve[:-1] + self.curve[-1]))
            spans = offsets(text, part) if size and part.max() > 0.5 else []
            found.append((score, spans))
        return found


def document_margins(toxic: np.ndarray) -> np.ndarray:
    if not len(toxic):
        return np.zeros(2)
    return np.array([toxic.max(), np.log1p(toxic[toxic > 0.05].sum())])


def offsets(text: str, toxic: np.ndarray) -> list[tuple[int, int, float]]:
    """Runs of words above one half, within a sentence: start, end, largest probability."""
    lowered = text.lower()
    if len(lowered) != len(text):
        lowered = "".join(low if len(low := char.lower()) == 1 else char for char in text)
    runs, place, open_run = [], 0, False
    for match in TOKEN.finditer(lowered):
        if BREAK.match(match.group()):
            open_run = False
            continue
        value = float(toxic[place]) if place < len(toxic) else 0.0
        place += 1
        if value <= 0.5:
            open_run = False
        elif open_run:
            runs[-1] = (runs[-1][0], match.end(), max(runs[-1][2], value))
        else:
            runs.append((match.start(), match.end(), value))
            open_run = True
    return runs


def train(rows: list[tuple[list[str], list[int]]], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and transitions by adaptive gradient steps on sentences."""
    weights, transitions = np.zeros(1 << BITS), np.zeros((2, 2))
    square, square_pairs = np.full(1 << BITS, 1e-2), np.full((2, 2), 1e-2)
    coded = []
    for words, labels in rows:
        around = [None, *words, None]
        found = [
            [*word_features(word), neighbour_features(around[i])[0], neighbour_features(around[i + 2])[1]]
            for i, word in enumerate(words)
        ]
        coded.append((np.array(found), np.array(labels, float)))
    random = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = random.permutation(len(coded))
        for begin in range(0, len(order), BATCH):
            chosen = [coded[i] for i in order[begin : begin + BATCH]]
            found = np.concatenate([columns for columns, _ in chosen])
            truth = np.concatenate([labels for _, labels in chosen])
            lengths = np.array([len(labels) for _, labels in chosen])
            emissions = weights[found].sum(1)
            toxic = marginals(emissions, lengths, transitions)
            slope = np.bincount(found.ravel(), np.repeat(truth - toxic, N_FEATURES), 1 << BITS) / len(chosen)
            slope -= 1e-5 * weights
            square += slope * slope
            weights += 0.5 * slope / np.sqrt(square)
            pairs = (pair_counts(truth, lengths) - pair_expectations(emissions, lengths, transitions)) / len(chosen)
            pairs -= 1e-3 * transitions
            square_pairs += pairs * pairs
            transitions += 0.1 * pairs / np.sqrt(square_pairs)
    return weights, transitions


def units(word: str) -> list[str]:
    """The word, and its beginnings as stems."""
    return [word, *(f"{word[:size]}-" for size in range(SHORTEST_STEM, LONGEST_STEM + 1) if len(word) > size)]


def _units_column():
    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        rows = []
        for text in texts:
            words = {word for sentence in sentences(text) for word in sentence}
            rows.append(sorted({unit for word in words for unit in units(word)}))
        return pd.Series(rows, dtype=object)

    return found


def toxic_units(labelled: DataFrame, text: str, label: str) -> set[str]:
    """Words and stems that mark toxic documents; their number is bounded by the sample."""
    found = labelled.select(F.col(label).alias("label"), F.explode(_units_column()(F.col(text))).alias("unit"))
    counts = found.groupBy("unit").agg(F.sum("label").alias("toxic"), F.count("*").alias("total"))
    sure = counts.where((F.col("toxic") >= MIN_DOCS) & (F.col("toxic") >= MIN_PRECISION * F.col("total")))
    return {row.unit for row in sure.select("unit").toLocalIterator()}


def choose(labels: DataFrame, label: str, order: Column, max_rows: int = MAX_ROWS) -> tuple[DataFrame, dict[int, float]]:
    """Some rows of a table of labels, and the share of each label that they are.

    Each label gets up to about half of ``max_rows``, by the hash of ``order``; no text
    is needed for that, so texts can be joined to the chosen rows alone.
    """
    labels = labels.where(F.col(label).isin(0, 1))
    by_label = {row[label]: row["count"] for row in labels.groupBy(label).count().collect()}
    shares = {value: min(1.0, max_rows / 2 / count) for value, count in by_label.items()}
    place = F.pmod(F.xxhash64(order), F.lit(1 << 30))
    wanted = F.lit(False)
    for value, share in shares.items():
        wanted = wanted | ((F.col(label) == value) & (place < int(share * (1 << 30))))
    return labels.where(wanted), shares


def fit(
    labelled: DataFrame,
    text: str,
    label: str,
    order: Column,
    max_rows: int = MAX_ROWS,
    max_sentences: int = MAX_SENTENCES,
    shares: dict[int, float] | None = None,
) -> Model:
    """Fit on rows with a label; ``order`` is what the choice of rows hashes.

    With ``shares`` the rows have been chosen already.  The chosen texts, a bounded
    number, are stored once and read for each step.  The driver gets the toxic units and
    the chosen sentences, never the documents.
    """
    spark = labelled.sparkSession
    if shares is None:
        labelled, shares = choose(labelled, label, order, max_rows)
    chosen = stored(labelled.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label")), "toxic-sample")
    by_label = {row.label: row["count"] for row in chosen.groupBy("label").count().collect()}
    blank = np.zeros(1 << BITS), np.zeros((2, 2))
    if len(by_label) < 2:
        share = (by_label.get(1, 0) + 1) / (sum(by_label.values()) + 2)
        return Model(*blank, np.array([0.0, 0.0, np.log(share / (1 - share))]))
    # Rarer classes are taken whole, so the shares of the sample differ from the table's.
    shift = np.log(shares[1] / shares[0])
    marks = spark.sparkContext.broadcast(toxic_units(chosen, "text", "label"))

    @F.pandas_udf("array<struct<words:array<string>,labels:array<int>,place:bigint>>")
    def tagged(texts: pd.Series, labels: pd.Series) -> pd.Series:
        rows = []
        for value, toxic in zip(texts, labels, strict=True):
            own = []
            for words in sentences(value):
                tags = [int(toxic and any(unit in marks.value for unit in units(word))) for word in words]
                own.append((words, tags, crc32(" ".join(words).encode("utf-8", "surrogatepass"))))
            rows.append(own)
        return pd.Series(rows, dtype=object)

    every = chosen.select(F.inline(tagged("text", "label"))).withColumn("toxic", F.array_max("labels"))
    every = stored(every, "toxic-sentences")
    kinds = {row.toxic: row["count"] for row in every.groupBy("toxic").count().collect()}
    if 1 not in kinds:
        model = Model(*blank, np.zeros(3))
    else:
        keep = F.lit(False)
        for kind, count in kinds.items():
            part = min(1.0, max_sentences / count)
            keep = keep | ((F.col("toxic") == kind) & (F.col("place") <= int(part * 0xFFFFFFFF)))
        rows = [(row.words, row.labels) for row in every.where(keep).orderBy("place").select("words", "labels").toLocalIterator()]
        model = Model(*train(rows), np.zeros(3))
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def margins(texts: pd.Series) -> pd.Series:
        found = []
        for value in texts:
            own = sentences(value)
            words = [word for sentence in own for word in sentence]
            lengths = np.array([len(sentence) for sentence in own], np.int64)
            found.append(document_margins(shared.value.token_probabilities(words, lengths)))
        return pd.Series(found, dtype=object)

    pairs = [(row.m, row.label) for row in chosen.select(margins("text").alias("m"), "label").toLocalIterator()]
    curve = logistic_fit(np.array([m for m, _ in pairs]), np.array([y for _, y in pairs]))
    curve[-1] -= shift
    return Model(model.weights, model.transitions, curve)


def predict(model: Model, text: Column) -> Column:
    """``struct<score, spans>``; spans are (start, end, probability) in text order."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("struct<score:double,spans:array<struct<start:int,end:int,probability:double>>>")
    def tag(texts: pd.Series) -> pd.DataFrame:
        found = [row for part in in_parts(list(texts), PART_CHARS) for row in shared.value.many(part)]
        return pd.DataFrame(found, columns=["score", "spans"])

    return tag.asNondeterministic()(text)
