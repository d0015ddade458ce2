"""Ranked lexical search over impact vectors in buckets of their length.

A document is a vector with an integer impact for each of its terms; a query is a vector
of integer weights, and a score is their product.  As in LEMP (Teflioudi, Gemulla and
Mykytiuk, 2015) the vectors are stored in buckets of their Euclidean length, sorted by it,
and searched from the longest bucket down in a few rounds:

* a bucket whose greatest length times the query's length stays under the query's
  threshold, the score of its k-th document so far, is pruned (Cauchy-Schwarz); when that
  holds for all queries of a block the remaining, shorter buckets are not read;
* inside a bucket the coordinates with a query's largest weights give an exact part of
  the score; what the other coordinates can add is bounded by the product of the
  remaining lengths, and by the remaining weights times the document's largest impact;
* the pairs of document and query that survive are scored anew with integers.

Bounds are in doubles, raised by a margin far above their rounding, and only pairs
strictly below a threshold are dropped, so that ties are settled by the ids and the
result is exact.

Queries come in blocks: the driver holds one block's terms, weights and thresholds at a
time, at most ``BLOCK_QUERIES`` queries and about ``BLOCK_TERMS`` terms.  A task keeps the
k best documents of each query in its block and hands on no more.

Cases: a null text and one without a term are not indexed and never found; an item like
that has no results.  Very long texts are read whole.  Repeated rows are ranked each on
its own; a repeated item gives its results again.  A null id counts as the smallest one.
Of equal scores the smaller id comes first.  Empty tables give empty results.  The result
has fixed columns, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import batch_parts, stored
from gleaner.session import new_folder

K = 50
BLOCK_QUERIES = 256
BLOCK_TERMS = 200_000
#: Buckets per doubling of the length.
BUCKETS = 4
#: The first round takes this share of the documents, each later one four times the last.
FIRST_SHARE, GROWTH = 0.02, 4
#: The share of a query's squared length that its focus coordinates have at least.
FOCUS = 0.9
#: How far bounds are raised above their rounding.
MARGIN = 1 + 1e-9
#: What one step of a task holds: pairs of document and query, and coordinates.
PAIRS, COORDINATES = 1 << 20, 200_000
NO_ID = -(1 << 63)

VECTOR = "doc_id long, terms array<string>, impacts array<int>, norm double, peak int, bucket int"
#: Upper-case letters become lower-case ones; all other ASCII but digits and letters, spaces.
TABLE = bytes(
    code + 32 if 65 <= code <= 90 else code if code >= 128 or chr(code).isalnum() else 32 for code in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def saturation_length(n: int, documents: int, total: int) -> int:
    """m: 50 and half of the document's length in hundredths of the mean one."""
    return 50 + (50 * n * documents) // total


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def totals(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """How many documents have a term, and how many terms there are with repeats."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = l = 0
        for batch in batches:
            for part in batch_parts(batch, 0):
                lengths = [len(terms_of(value)) for value in part.column(0).cast(pa.binary()).to_pylist()]
                n, l = n + sum(map(bool, lengths)), l + sum(lengths)
        yield pa.RecordBatch.from_pydict({"n": [n], "l": [l]})

    rows = docs.select(F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    found = rows.mapInArrow(count, "n long, l long").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    return found.n or 0, found.l or 0


def vectors(docs: DataFrame, documents: int, total: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The impact vector of every document with a term."""
    names = [part.split()[0] for part in VECTOR.split(", ")]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch_parts(batch, 1):
                rows, lengths, terms, counts, sizes = [], [], [], [], []
                for row, value in enumerate(part.column(1).cast(pa.binary()).to_pylist()):
                    words = terms_of(value)
                    if not words:
                        continue
                    found = Counter(words)
                    rows.append(row)
                    lengths.append(len(found))
                    sizes.append(saturation_length(len(words), documents, total))
                    terms.extend(found)
                    counts.extend(found.values())
                if not rows:
                    continue
                tf = np.array(counts, np.int64)
                impacts = 10**9 * tf // (1000 * tf + 20 * np.repeat(np.array(sizes, np.int64), lengths))
                starts = np.concatenate([[0], np.cumsum(lengths)])
                norm = np.sqrt(np.add.reduceat(impacts.astype(float) ** 2, starts[:-1]))
                offsets = pa.array(starts, pa.int32())
                bucket = np.floor(BUCKETS * np.log2(np.maximum(norm, 1))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rows)),
                        pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary()).cast(pa.string())),
                        pa.ListArray.from_arrays(offsets, pa.array(impacts.astype(np.int32))),
                        pa.array(norm),
                        pa.array(np.maximum.reduceat(impacts, starts[:-1]).astype(np.int32)),
                        pa.array(bucket),
                    ],
                    names,
                )

    own = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return own.where("text IS NOT NULL").mapInArrow(measured, VECTOR)


@dataclass
class Queries:
    """One block of queries: weights by term, split into focus and other coordinates."""

    vocabulary: list[bytes]
    terms: list[np.ndarray]  # places in the vocabulary, for each query
    weights: np.ndarray  # of the vocabulary
    thresholds: np.ndarray = field(init=False)

    def __post_init__(self):
        size = len(self.terms)
        self.thresholds = np.ones(size, np.int64)  # only scores above 0 count
        every, focus = [], []
        self.norms, self.rest_norms, self.rest_sums = np.zeros(size), np.zeros(size), np.zeros(size)
        for query, places in enumerate(self.terms):
            ordered = places[np.argsort(-self.weights[places], kind="stable")]
            squares = self.weights[ordered].astype(float) ** 2
            held = np.cumsum(squares)
            cut = int(np.searchsorted(held, FOCUS * held[-1])) + 1
            every += [(place, query) for place in ordered.tolist()]
            focus += [(place, query) for place in ordered[:cut].tolist()]
            self.norms[query] = math.sqrt(held[-1])
            self.rest_norms[query] = math.sqrt(squares[cut:].sum())
            self.rest_sums[query] = self.weights[ordered[cut:]].sum()
        self.every, self.focus = self._by_term(every), self._by_term(focus)

    def _by_term(self, pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Where each term's queries start, and the queries."""
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        starts = np.searchsorted(table[:, 0], np.arange(len(self.vocabulary) + 1))
        return starts, table[:, 1]


class Best:
    """The k best documents of each query, as far as a task has come."""

    def __init__(self, thresholds: np.ndarray, k: int):
        self.k, self.thresholds = k, thresholds.copy()
        self.rows = np.empty((0, 3), np.int64)  # query, score, document
        self.held = 0

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        self.rows = np.concatenate([self.rows, np.column_stack([queries, scores, ids])])
        if len(self.rows) > 2 * self.held + 4096:
            self.cut()

    def cut(self) -> None:
        rows = self.rows[np.lexsort((self.rows[:, 2], -self.rows[:, 1], self.rows[:, 0]))]
        first = np.searchsorted(rows[:, 0], rows[:, 0])
        place = np.arange(len(rows)) - first
        self.rows = rows[place < self.k]
        last = rows[place == self.k - 1]
        self.thresholds[last[:, 0]] = np.maximum(self.thresholds[last[:, 0]], last[:, 1])
        self.held = len(self.rows)


def _meetings(rows, terms, index):
    """Each coordinate with every query that has its term: (coordinate, row and query)."""
    starts, queries = index
    counts = starts[terms + 1] - starts[terms]
    coordinate = np.repeat(np.arange(len(terms)), counts)
    within = np.arange(len(coordinate)) - np.repeat(np.cumsum(counts) - counts, counts)
    return coordinate, rows[coordinate], queries[starts[terms][coordinate] + within]


def score_part(asked: Queries, best: Best, ids, norms, peaks, rows, terms, impacts) -> None:
    """Prune, bound and rescore some documents; ``rows, terms, impacts`` are coordinates."""
    shape = (len(ids), len(asked.terms))
    limits = best.thresholds
    alive = norms[:, None] * asked.norms * MARGIN >= limits
    if not alive.any():
        return
    coordinate, row, query = _meetings(rows, terms, asked.focus)
    flat = row * shape[1] + query
    impact = impacts[coordinate].astype(float)
    known = np.bincount(flat, asked.weights[terms[coordinate]] * impact, shape[0] * shape[1]).reshape(shape)
    mass = np.bincount(flat, impact**2, shape[0] * shape[1]).reshape(shape)
    # The margin covers the rounding of the difference of two nearly equal squares.
    left = np.sqrt(np.maximum(norms[:, None] ** 2 * MARGIN - mass, 0))
    more = np.minimum(asked.rest_norms * left, asked.rest_sums * peaks[:, None])
    alive &= (known + more) * MARGIN >= limits
    coordinate, row, query = _meetings(rows, terms, asked.every)
    chosen = alive[row, query]
    coordinate, flat = coordinate[chosen], row[chosen] * shape[1] + query[chosen]
    scores = np.zeros(shape[0] * shape[1], np.int64)
    np.add.at(scores, flat, asked.weights[terms[coordinate]] * impacts[coordinate])
    row, query = np.divmod(np.flatnonzero(scores), shape[1])
    score = scores[row * shape[1] + query]
    found = score >= limits[query]
    best.add(query[found], score[found], ids[row[found]])


def scored(rows: DataFrame, asked: Queries, k: int) -> DataFrame:
    """``query, score, doc_id``: each task's k best documents for every query."""
    n_queries = len(asked.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(asked.thresholds, k)
        known = pa.array(asked.vocabulary, pa.binary()).cast(pa.string())
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch["terms"]).to_numpy())
            start = 0
            while start < len(batch):
                before = ends[start - 1] if start else 0
                stop = int(np.searchsorted(ends, before + COORDINATES, side="right"))
                stop = max(start + 1, min(stop, start + max(1, PAIRS // n_queries)))
                part = batch.slice(start, stop - start)
                start = stop
                terms = pc.fill_null(pc.index_in(part["terms"].flatten(), value_set=known), -1).to_numpy()
                hits = np.flatnonzero(terms >= 0)
                if not len(hits):
                    continue
                owners = pc.list_parent_indices(part["terms"]).to_numpy()[hits]
                impacts = part["impacts"].flatten().to_numpy()[hits].astype(np.int64)
                ids = pc.fill_null(part["doc_id"], NO_ID).to_numpy()
                norms, peaks = part["norm"].to_numpy(), part["peak"].to_numpy()
                score_part(asked, best, ids, norms, peaks, owners, terms[hits], impacts)
        best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(best.rows[:, i]) for i in range(3)], ["query", "score", "doc_id"])

    return rows.select("doc_id", "terms", "impacts", "norm", "peak").mapInArrow(
        run, "query long, score long, doc_id long"
    )


class ImpactIndex:
    """Impact vectors of all documents in buckets of their length, longest first."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text"):
        self.spark: SparkSession = docs.sparkSession
        self.documents, self.total = totals(docs, text)
        rows = vectors(docs, self.documents, self.total, key, text) if self.documents else None
        if rows is None:
            rows = self.spark.createDataFrame([], VECTOR)
        self.vectors = stored(rows.sortWithinPartitions("bucket", F.desc("norm")), "vectors", "bucket")
        # One row for each quarter of a doubling: few, whatever the number of documents.
        counted = self.vectors.groupBy("bucket").agg(F.count("*").alias("n")).collect()
        self.buckets = sorted(((row.bucket, row.n) for row in counted), reverse=True)

    def frequencies(self, vocabulary: list[bytes]) -> np.ndarray:
        """In how many documents each term of a block occurs."""
        terms = self.spark.createDataFrame([(t.decode(), i) for i, t in enumerate(vocabulary)], "term string, place long")
        found = self.vectors.select(F.explode("terms").alias("term")).join(F.broadcast(terms), "term")
        counts = np.zeros(len(vocabulary), np.int64)
        for row in found.groupBy("place").agg(F.count("*").alias("n")).collect():
            counts[row.place] = row.n
        return counts

    def rounds(self) -> Iterator[list[int]]:
        """Buckets to search together, from the longest vectors down."""
        wanted, chosen, held = FIRST_SHARE * self.documents, [], 0
        for bucket, n in self.buckets:
            chosen.append(bucket)
            held += n
            if held >= wanted:
                yield chosen
                wanted, chosen, held = wanted * GROWTH, [], 0
        if chosen:
            yield chosen

    def search_block(self, texts: list[list[bytes]], k: int) -> DataFrame:
        """``query, rank, score, doc_id`` for the terms of some queries."""
        vocabulary = sorted({term for terms in texts for term in terms})
        places = {term: place for place, term in enumerate(vocabulary)}
        weights = [weight(self.documents, int(df)) for df in self.frequencies(vocabulary)]
        terms = [np.array([places[term] for term in found], np.int64) for found in texts]
        asked = Queries(vocabulary, terms, np.array(weights, np.int64))
        order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
        best = None
        for buckets in self.rounds():
            longest = 2 ** ((buckets[0] + 1) / BUCKETS)
            if (longest * asked.norms * MARGIN < asked.thresholds).all():
                break
            found = scored(self.vectors.where(F.col("bucket").isin(buckets)), asked, k)
            found = found if best is None else found.unionByName(best.drop("rank"))
            ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            best = stored(ranked, "ranked")
            for row in best.where(F.col("rank") == k).collect():  # at most one a query
                asked.thresholds[row.query] = max(asked.thresholds[row.query], row.score)
        return best

    def search(self, items: DataFrame, k: int = K, key: str = "item_id", text: str = "text") -> DataFrame:
        """``item_id, rank, doc_id, score``: the k best documents of every item."""
        folder = new_folder(self.spark, "searched")
        id_type = items.schema[key].dataType
        empty = self.spark.createDataFrame([], "rank int, doc_id long, score long")
        empty = empty.select(F.lit(None).cast(id_type).alias("item_id"), "rank", "doc_id", "score")
        empty.write.parquet(folder)

        def search_and_add(block: list[tuple[object, list[bytes]]]) -> None:
            names = self.spark.createDataFrame(
                [Row(query=i, item_id=item) for i, (item, _) in enumerate(block)],
                f"query long, item_id {id_type.simpleString()}",
            )
            found = self.search_block([terms for _, terms in block], k)
            doc = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
            rows = found.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int"), doc, "score")
            rows.write.mode("append").parquet(folder)

        block, held = [], 0
        asked = items.select(F.col(f"`{key}`").alias("item"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
        for row in asked.toLocalIterator() if self.documents else ():
            terms = list(dict.fromkeys(terms_of(row.text.encode())))
            if not terms:
                continue
            block.append((row.item, terms))
            held += len(terms)
            if len(block) >= BLOCK_QUERIES or held >= BLOCK_TERMS:
                search_and_add(block)
                block, held = [], 0
        if block:
            search_and_add(block)
        return self.spark.read.schema(empty.schema).parquet(folder)
