"""Benchmark decontamination by the q-gram lemma and banded alignment.

A passage of m characters that occurs in a text with at most e edits shares at least
m - q + 1 - q * e of its character q-grams with the text, on at most e + 1 neighbouring
diagonals (place in the text minus place in the passage).  Diagonals are counted in
overlapping bands of twice that width, so one band holds them all.  Bands that reach
the bound are kept, and a banded alignment decides.

Documents are read once and never shuffled.  The passages are indexed in blocks of
bounded size, each broadcast on its own, so a large benchmark means more blocks.

Letters are compared in lower case and white space as spaces.  Null and blank texts
and passages match nothing.  A passage too short for the edit budget must occur whole,
between word limits.  Texts of any length are read to the end.  Repeated passages each
report their hits under their own id; null ids are reported as null.  Ids of
whole numbers are reported as 64-bit ones, all others as strings.  Empty tables give
empty results.  Only the id and text columns of the benchmark are read, so clashing
names do not matter; documents keep all their columns, and a column for hits that would
clash with one of them raises a ``ValueError``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import free_name

Q = 10
EDIT_RATE = 0.06
SHORT = 24
BLOCK_CHARS = 2_000_000
FILTER_BITS = 22
HITS = "array<struct<item_id:{},start:int,end:int,edits:int>>"
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def normal(text: str) -> str:
    """Lower case and single spaces for white space, character by character."""
    lowered = text.lower()
    if len(lowered) != len(text):
        lowered = "".join(low if len(low := char.lower()) == 1 else char for char in text)
    for space in "\t\n\r\x0b\x0c\x85\xa0  　":
        lowered = lowered.replace(space, " ")
    return lowered


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram, built by doubling the length of the gram."""
    if len(points) < q:
        return np.empty(0, np.uint64)
    power, width, scale = points.astype(np.uint64), 1, BASE
    total, done, total_scale = None, 0, np.uint64(1)
    left = q
    with np.errstate(over="ignore"):
        while True:
            if left & 1:
                if total is None:
                    total = power
                else:
                    size = len(points) - (done + width) + 1
                    total = total[:size] * scale + power[done : done + size]
                done += width
            left >>= 1
            if not left:
                break
            power = power[: len(power) - width] * scale + power[width:]
            width, scale = 2 * width, scale * scale
        mixed = total * MIX
        return mixed ^ (mixed >> np.uint64(29))


@dataclass
class Passage:
    item_id: int | None
    text: str
    edits: int
    bound: int


@dataclass
class Index:
    """The q-grams of the passages that share one q."""

    q: int
    passages: list[Passage] = field(default_factory=list)

    def seal(self) -> Index:
        grams, owners, places = [], [], []
        for number, passage in enumerate(self.passages):
            found = gram_hashes(codes(passage.text), self.q)
            grams.append(found)
            owners.append(np.full(len(found), number, np.int32))
            places.append(np.arange(len(found), dtype=np.int32))
        hashes = np.concatenate(grams)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.owners = np.concatenate(owners)[order]
        self.places = np.concatenate(places)[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - FILTER_BITS)] = True
        self.least = min(passage.bound for passage in self.passages)
        self.edits = np.array([passage.edits for passage in self.passages], np.int64)
        self.bounds = np.array([passage.bound for passage in self.passages], np.int64)
        return self

    def bands(self, points: np.ndarray) -> list[tuple[int, int]]:
        """(passage, band) with enough different shared q-grams."""
        found = gram_hashes(points, self.q)
        at = np.flatnonzero(self.filter[found >> np.uint64(64 - FILTER_BITS)])
        if len(at) < self.least:
            return []
        low = np.searchsorted(self.hashes, found[at], "left")
        count = np.searchsorted(self.hashes, found[at], "right") - low
        if count.sum() < self.least:
            return []
        entry = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        entry = entry + np.arange(len(entry))
        owner, place = self.owners[entry].astype(np.int64), self.places[entry].astype(np.int64)
        enough = np.bincount(owner, minlength=len(self.bounds)) >= self.bounds
        chosen = enough[owner]
        if not chosen.any():
            return []
        owner, place = owner[chosen], place[chosen]
        diagonal = np.repeat(at, count)[chosen] - place
        band = diagonal // (self.edits[owner] + 1)
        # A band b holds the diagonals of the steps b and b + 1.
        keys = np.concatenate([np.stack([owner, band, place]), np.stack([owner, band - 1, place])], 1)
        keys = np.unique(keys, axis=1)
        change = np.any(keys[:2, 1:] != keys[:2, :-1], axis=0)
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        sizes = np.diff(np.concatenate([starts, [keys.shape[1]]]))
        owners, bands = keys[0, starts], keys[1, starts]
        kept = sizes >= self.bounds[owners]
        return list(zip(owners[kept].tolist(), bands[kept].tolist(), strict=True))


def banded_alignment(passage: np.ndarray, text: np.ndarray, low: int, high: int, limit: int):
    """Best (edits, start, end) of the passage in the text on the diagonals low..high.

    The passage must be used whole and the text may start and end anywhere, so the
    first row is free.  Returns None beyond ``limit`` edits.
    """
    width = high - low + 1
    far = limit + 1
    offsets = np.arange(width)
    places = low + offsets  # the number of text characters used, at row 0
    cost = np.where((places >= 0) & (places <= len(text)), 0, far)
    start = places.copy()
    for row in range(1, len(passage) + 1):
        places = low + row + offsets
        inside = (places >= 1) & (places <= len(text))
        same = np.zeros(width, bool)
        same[inside] = text[places[inside] - 1] == passage[row - 1]
        new_cost = np.where(places >= 1, cost + ~same, far)
        new_start = start.copy()
        skip = np.concatenate([cost[1:], [far]]) + 1  # a passage character without a partner
        better = skip < new_cost
        new_cost = np.where(better, skip, new_cost)
        new_start = np.where(better, np.concatenate([start[1:], [0]]), new_start)
        new_cost = np.where((places >= 0) & (places <= len(text)), new_cost, far)
        # A text character without a partner: the best earlier cell plus its distance.
        reach = new_cost - offsets
        best = np.minimum.accumulate(reach)
        origin = np.maximum.accumulate(np.where(reach == best, offsets, 0))
        cost = np.minimum(new_cost, best + offsets)
        start = np.where(best + offsets < new_cost, new_start[origin], new_start)
        cost = np.minimum(np.where((places >= 0) & (places <= len(text)), cost, far), far)
        if cost.min() >= far:
            return None
    at = int(np.argmin(cost))
    if cost[at] > limit:
        return None
    return int(cost[at]), int(start[at]), int(low + len(passage) + at)


def make_passage(item_id: int | None, text: str, rate: float) -> tuple[int, Passage]:
    """A passage with its edit budget, and the longest q for which the bound is useful."""
    edits = int(rate * len(text)) if len(text) >= SHORT else 0
    for q in range(min(Q, len(text)), 0, -1):
        bound = len(text) - q + 1 - q * edits
        if bound >= min(q, len(text) - q + 1):
            break
    return q, Passage(item_id, text, edits, max(bound, 1))


def build(items: list[tuple[int | None, str]], rate: float) -> list[Index]:
    by_q: dict[int, Index] = {}
    for item_id, text in items:
        q, passage = make_passage(item_id, text, rate)
        by_q.setdefault(q, Index(q)).passages.append(passage)
    return [index.seal() for index in by_q.values()]


def whole_word(text: str, start: int, end: int) -> bool:
    before, after = text[start - 1 : start], text[end : end + 1]
    return not (before.isalnum() and text[start].isalnum()) and not (
        after.isalnum() and text[end - 1].isalnum()
    )


def find(text: str | None, indexes: list[Index]) -> list[tuple]:
    """The best hit of each passage that occurs in the text within its budget."""
    if not text:
        return []
    text = normal(text)
    points = codes(text)
    best: dict[tuple[int, int], tuple] = {}
    for index in indexes:
        for owner, band in index.bands(points):
            passage = index.passages[owner]
            step = passage.edits + 1
            # The bound says where to look; edits at the passage's ends need a margin.
            low, high = band * step - step, band * step + 3 * step
            begin = max(0, low)
            exact = text.find(passage.text, begin, max(0, high + len(passage.text)))
            if exact >= 0:
                hit = (0, exact, exact + len(passage.text))
            elif passage.edits:
                hit = banded_alignment(codes(passage.text), points, low, high, passage.edits)
            else:
                hit = None
            if hit is None or (not passage.edits and not whole_word(text, hit[1], hit[2])):
                continue
            key = (index.q, owner)
            if key not in best or hit < best[key][0]:
                best[key] = (hit, passage.item_id)
    return sorted(
        ((item, start, end, edits) for (edits, start, end), item in best.values()),
        key=lambda hit: (hit[1], hit[2], hit[0] is None, 0 if hit[0] is None else hit[0]),
    )


def _search(index, id_type: str):
    @F.pandas_udf(HITS.format(id_type))
    def search(texts: pd.Series) -> pd.Series:
        return pd.Series([find(value, index.value) for value in texts], dtype=object)

    # Nondeterministic for the planner, so that a filter on the hits runs it only once.
    return search.asNondeterministic()


def hits(
    benchmark: DataFrame,
    text: Column,
    item_id: str = "item_id",
    item_text: str = "text",
    rate: float = EDIT_RATE,
    block_chars: int = BLOCK_CHARS,
) -> Column:
    """The hits in a text column: an array of (item, start, end, edits), in text order.

    ``start`` and ``end`` are places in the text, counted in code points.
    """
    spark = benchmark.sparkSession
    whole = isinstance(benchmark.schema[item_id].dataType, T.IntegralType)
    id_type = "bigint" if whole else "string"
    items = benchmark.select(
        F.col(f"`{item_id}`").cast(id_type).alias("item_id"), F.col(f"`{item_text}`").alias("text")
    ).where(r"text rlike '\\S'")
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    found = []
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        cleaned = [(row.item_id, normal(row.text).strip()) for row in part.collect()]
        index = spark.sparkContext.broadcast(build([item for item in cleaned if item[1]], rate))
        found.append(_search(index, id_type)(text))
    return F.concat(*found) if len(found) > 1 else found[0]


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", name: str = "hits", **options) -> DataFrame:
    """The documents that hold a benchmark passage, with their hits in a new column."""
    if name.lower() in {other.lower() for other in docs.columns}:
        raise ValueError(f"The documents have a column {name} already; name another")
    return docs.withColumn(name, hits(benchmark, F.col(f"`{text}`"), **options)).where(F.size(name) > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without any benchmark passage, with the same columns."""
    name = free_name(docs, "hits")
    found = docs.withColumn(name, hits(benchmark, F.col(f"`{text}`"), **options))
    return found.where(F.size(F.col(f"`{name}`")) == 0).drop(name)
