"""Line deduplication with levelled, sorted runs of line keys.

A line's key is the line without white space at its ends and with A-Z in lower case.
Keys of at least ``MIN_CHARS`` code points that ``min_docs`` documents or more hold are
boilerplate: their lines stay in the document with the largest id only.

``LineRuns`` keeps, for each key, how many documents held it and the largest id among
them, in runs: tables bucketed and sorted by 128 bits of the key's hash.  Documents come
in batches of descending ids.  A batch is first grouped by key, inside its tasks and
then across them, then merge-anti-joined with the keys that the runs have settled (in
``min_docs`` documents already, so nothing about them can change), and what is left
becomes a run of level 0.  ``fanout`` runs of a level are merged into one run of the
next, so a batch meets few runs.  All runs have the same buckets: neither the join nor
the merge moves a stored run between executors.

At the end the settled keys meet the lines once more, and each document gets the list of
its own lines to drop.  A key that a third of all documents hold is one row per task
before the shuffle and one row in a run; lines meet it in a broadcast join as long as
the settled keys are few, else in a join whose skewed partitions the planner splits.

Cases: a null or empty text is one empty line and stays as it is.  A row without an id
neither counts nor loses lines.  Rows with one id count as one document; each of them
is cleaned.  Of several equal lines in the document that keeps a key, all stay.  Very
long texts are read whole, a few megabytes at a time.  An empty table gives an empty one.
Other columns pass through; only columns called ``n_lines`` or ``n_dropped`` are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from gleaner.llm.common import batch_parts, small, stored
from gleaner.session import new_folder

#: White space that is stripped, and the shortest key that counts.
SPACES = " \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 2

KEY = ["h", "g"]
ENTRY = "h long, g long, n long, last long"


def line_keys(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lines whose key is long enough, and their hashes as two integers."""
    keys = pc.ascii_trim(pc.ascii_lower(lines), characters=SPACES)
    places = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), MIN_CHARS).to_numpy(zero_copy_only=False))
    digests = b"".join(map(xxhash.xxh3_128_digest, keys.take(pa.array(places)).cast(pa.binary()).to_pylist()))
    return places, np.frombuffer(digests, "<i8").reshape(-1, 2)


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, h, g``: every key of every document with an id, once a row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch_parts(batch, "text"):
                split = pc.split_pattern(part["text"], "\n")
                places, hashes = line_keys(split.flatten())
                parents = pc.list_parent_indices(split).to_numpy()[places]
                rows = np.unique(np.column_stack([parents, hashes]), axis=0)
                ids = part["doc_id"].take(pa.array(rows[:, 0]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(rows[:, 1]), pa.array(rows[:, 2])], ["doc_id", *KEY])

    own = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return own.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(hashed, "doc_id long, h long, g long")


class LineRuns:
    """Sorted runs of ``h, g, n, last`` on levels, in a folder that all executors share.

    Batches must come in descending order of ids, each id in one batch only: then the
    largest document of a key is known once the key is there.
    """

    def __init__(self, spark: SparkSession, folder: str, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self._spark, self._folder = spark, folder
        self._min_docs, self._fanout = min_docs, fanout
        self._buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def _write(self, entries: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        # The grouping before has dealt the rows by the same hash: no further shuffle.
        rows = entries.write.bucketBy(self._buckets, *KEY).sortBy(*KEY)
        rows.option("path", f"{self._folder}/{name}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _runs(self) -> list[DataFrame]:
        return [self._spark.table(name) for level in self.levels for name in level]

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """One row per key of any run: a merge join of sorted buckets, run after run."""

        def merged(one: DataFrame, other: DataFrame) -> DataFrame:
            other = other.withColumnsRenamed({"n": "more", "last": "other"})
            n = F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))
            return one.join(other, KEY, "full").select(*KEY, n.alias("n"), F.greatest("last", "other").alias("last"))

        return reduce(merged, runs)

    def settled(self) -> DataFrame:
        """``h, g, last`` of the keys that enough documents hold."""
        runs = self._runs()
        if not runs:
            return self._spark.createDataFrame([], ENTRY).select(*KEY, "last")
        return self._merged(runs).where(F.col("n") >= self._min_docs).select(*KEY, "last")

    def add(self, lines: DataFrame) -> None:
        """Take in one batch of ``doc_id, h, g`` (each once) and compact full levels."""
        entries = lines.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
        known = F.lit(0)
        for place, run in enumerate(self._runs()):  # the entries stay where they are
            count = f"known_{place}"
            entries = entries.join(run.select(*KEY, F.col("n").alias(count)).hint("merge"), KEY, "left")
            known = known + F.coalesce(count, F.lit(0))
        fresh = entries.where(known < self._min_docs)
        self._write(fresh.select(*KEY, "n", "last"), 0)
        level = 0
        while len(self.levels[level]) >= self._fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self._merged([self._spark.table(name) for name in full]), level + 1)
            for name in full:
                self._spark.sql(f"DROP TABLE {name}")
            level += 1


def lines_by_batch(docs: DataFrame, batches: int, key: str, text: str) -> tuple[DataFrame, list[int]]:
    """``doc_id, h, g, batch``: batches are ranges of ids, 0 has the largest."""
    ids = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id")).where("doc_id IS NOT NULL")
    shares = [1 - step / batches for step in range(1, batches)]
    bounds = ids.approxQuantile("doc_id", shares, 0.01) if shares else []
    batch = sum(((F.col("doc_id") <= int(bound)).cast("int") for bound in bounds), F.lit(0))
    lines = stored(lines_of(docs, key, text).withColumn("batch", batch), "lines", "batch")
    twice = stored(ids.groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if not twice.isEmpty():  # rows with one id are one document
        twice = small(twice)
        once = lines.join(twice, "doc_id", "left_anti")
        lines = once.union(lines.join(twice, "doc_id", "left_semi").distinct())
    return lines, list(range(len(bounds) + 1))


def dedup_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """The documents without repeated lines, with ``n_lines`` (before) and ``n_dropped``."""
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    lines, numbers = lines_by_batch(docs, batches, key, text)
    runs = LineRuns(spark, new_folder(spark, "line-runs"), min_docs, fanout)
    for number in numbers:
        runs.add(lines.where(F.col("batch") == number).drop("batch"))
    settled = stored(runs.settled(), "settled")
    gone = lines.join(small(settled), KEY).where("doc_id != last")
    # As many entries as the document has lines to lose.
    gone = gone.groupBy("doc_id").agg(F.collect_list(F.struct(*KEY)).alias("keys"))
    return _without(docs, gone, key, text)


def _without(docs: DataFrame, gone: DataFrame, key: str, text: str) -> DataFrame:
    """Drop from every document the lines with its listed keys."""
    schema = StructType(list(docs.schema.fields)).add("n_lines", LongType()).add("n_dropped", LongType())
    names, place = docs.columns, docs.columns.index(text)

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch_parts(batch, place):
                old, texts = part.column(place), []
                split = pc.split_pattern(pc.fill_null(old, ""), "\n")
                n_lines = pc.list_value_length(split).cast(pa.int64())
                n_dropped = np.zeros(len(part), np.int64)
                for row, keys in enumerate(part.column(len(names)).to_pylist()):
                    if keys is None:
                        texts.append(old[row].as_py())
                        continue
                    lines, wanted = split[row].values, {(k["h"], k["g"]) for k in keys}
                    places, hashes = line_keys(lines)
                    drop = {p for p, pair in zip(places.tolist(), map(tuple, hashes.tolist())) if pair in wanted}
                    n_dropped[row] = len(drop)
                    texts.append("\n".join(line for p, line in enumerate(lines.to_pylist()) if p not in drop))
                columns = [part.column(i) for i in range(len(names))]
                columns[place] = pa.array(texts, old.type)
                yield pa.RecordBatch.from_arrays([*columns, n_lines, pa.array(n_dropped)], schema.names)

    ids = [F.col(f"`{name}`") for name in names]
    gone = gone.withColumnsRenamed({"doc_id": "gone_id", "keys": "gone_keys"})
    own = docs.select(*(column.alias(f"c{i}") for i, column in enumerate(ids)))
    number = names.index(key)
    # Always the same plan, whatever the sizes: both sides are dealt by id and merged.
    both = own.join(gone.hint("merge"), F.col(f"c{number}") == F.col("gone_id"), "left").drop("gone_id")
    return both.mapInArrow(rewritten, schema)
