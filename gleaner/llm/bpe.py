"""Byte-level BPE: ranked merges folded by higher-order functions over distinct words.

A task packs documents of ``CHUNK_BYTES`` into a chunk: the distinct words that no earlier
chunk of the task had, as arrays of byte ids, and for every document the places of its
words.  Texts are split into words a megabyte at a time, before anything is copied per word.
Spark folds the merges over each of these words, looking pairs up in a literal rank map, and
the chunk is unpacked into one row of ids per document, with their digest if asked for.
There is no shuffle; a task holds one chunk and the words it knows, about ``KNOWN_WORDS`` of
them, after which it starts anew.  A word of over ``LONG_BYTES`` bytes is merged by a heap of
its pairs instead, with the same result.  Decoding concatenates the binary pieces of the ids.
A rank file may have 65,536 pieces at most, as a pair of ids is one 32-bit number.

Null texts count as empty and get an empty array; any other text, however long,
round-trips byte for byte.  Repeated rows stay repeated, and an empty table gives an
empty one.  Columns of the input other than the text are carried along unchanged; an
output column that would clash with one of them raises a ``ValueError``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import batch_parts, let

BUCKETS = 8192
CHUNK_BYTES = 4 << 20
#: A task starts its list of known words anew once it has so many.
KNOWN_WORDS = 1 << 19
#: Words of more bytes are merged by a heap of pairs, as the fold takes the square of their length.
LONG_BYTES = 256
#: Bytes of text split into words at a time.
PART_BYTES = 1 << 20
#: Above every rank: a pair that joins to no piece.
NONE = 1 << 16


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by rank, and the rank of every pair of pieces that join to a piece."""

    pieces: tuple[bytes, ...]
    pairs: tuple[tuple[int, int, int], ...]
    byte_ids: tuple[int, ...]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Read a rank file: one base64 piece and its rank on each line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    if max(ranks.values()) >= 1 << 16:
        raise ValueError(f"{path} has ids above 65,535")
    pieces = [b""] * (max(ranks.values()) + 1)
    pairs = []
    for piece, rank in ranks.items():
        pieces[rank] = piece
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                pairs.append((left, right, rank))
    return Vocabulary(tuple(pieces), tuple(pairs), tuple(ranks[bytes([i])] for i in range(256)))


def _bucket(left: int, right: int) -> int:
    return (left << 4 ^ right) & (BUCKETS - 1)


def _signed(left: int, right: int) -> int:
    """A pair as one 32-bit number, as the shifts of Spark's integers give it."""
    pair = left << 16 | right
    return pair - (1 << 32) if pair >= 1 << 31 else pair


@lru_cache(maxsize=4)
def _rank_map_json(path: str) -> str:
    buckets: list[dict[int, int]] = [{-1: -1} for _ in range(BUCKETS)]
    for left, right, rank in vocabulary(path).pairs:
        buckets[_bucket(left, right)][_signed(left, right)] = rank
    return json.dumps(buckets, separators=(",", ":"))


def rank_map(path: str) -> Column:
    """A literal ``array<map<pair, rank>>``; a pair's bucket keeps each lookup short.

    It is folded from one string: an expression for each bucket would cost the driver
    hundreds of MB to parse and to plan.
    """
    return F.from_json(F.lit(_rank_map_json(path)), "array<map<string,int>>").cast("array<map<int,int>>")


def _rank(ranks: Column, left: Column, right: Column) -> Column:
    """The rank of a pair, NULL if it joins to no piece; the same sums as above."""
    place = F.shiftleft(left, 4).bitwiseXOR(right).bitwiseAND(BUCKETS - 1)
    return F.element_at(F.get(ranks, place), F.shiftleft(left, 16).bitwiseOR(right))


def _packed(rank: Column, piece: Column) -> Column:
    """An id with the rank of its pair with the next id above it; ``NONE`` without one."""
    return F.shiftleft(F.coalesce(rank, F.lit(NONE)).cast("long"), 16).bitwiseOR(piece)


def _id(packed: Column) -> Column:
    return packed.bitwiseAND(0xFFFF).cast("int")


def _merge(state: Column, ranks: Column) -> Column:
    """Join the leftmost pair of the lowest rank; the rank is the id of the joined piece.

    Equal ranks are equal pairs, so the least item is the lowest rank's, and its first
    place is the leftmost pair.
    """

    def joined(after: Column, new: Column) -> Column:
        step = F.transform(
            state,
            lambda x, i: F.when(i > after, x)
            .when(i < after - 2, x)
            .when(i == after, F.lit(-1).cast("long"))
            .when(i == after - 1, _packed(_rank(ranks, new, _id(F.get(state, after + 1))), new))
            .otherwise(_packed(_rank(ranks, _id(x), new), _id(x))),
        )
        return F.array_remove(step, F.lit(-1).cast("long"))

    return let(
        F.array_min(state),
        lambda low: F.when(
            low < NONE << 16,
            # Counted from one, so it is the place of the pair's second id counted from zero.
            let(F.array_position(state, low).cast("int"), lambda at: joined(at, F.shiftright(low, 16).cast("int"))),
        ).otherwise(state),
    )


def fold_merges(word: Column, ranks: Column) -> Column:
    """The ids of one word, given as the ids of its bytes; ids below zero are merged already."""
    start = F.transform(word, lambda x, i: _packed(_rank(ranks, x, F.get(word, i + 1)), x))
    merged = F.transform(word, lambda x: -1 - x)
    return F.when(F.size(word) < 1, word).when(F.get(word, F.lit(0)) < 0, merged).when(F.size(word) < 2, word).otherwise(
        F.aggregate(
            F.sequence(F.lit(2), F.size(word)),
            start,
            lambda state, _: _merge(state, ranks),
            lambda state: F.transform(state, _id),
        )
    )


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word by a heap of its pairs, in time that stays near linear."""
    ends = list(range(1, len(word) + 1))  # where the piece that starts at a place ends
    before = list(range(-1, len(word) - 1))

    def pair(start: int) -> int | None:
        middle = ends[start]
        return ranks.get(word[start : ends[middle]]) if middle < len(word) else None

    heap = [(rank, start) for start in range(len(word)) if (rank := pair(start)) is not None]
    heapq.heapify(heap)
    while heap:
        rank, start = heapq.heappop(heap)
        if not ends[start] or pair(start) != rank:  # joined away, or its pair has changed
            continue
        middle = ends[start]
        ends[start], ends[middle] = ends[middle], 0
        if ends[start] < len(word):
            before[ends[start]] = start
        for place in (before[start], start):
            if place >= 0 and (found := pair(place)) is not None:
                heapq.heappush(heap, (found, place))
    return [ranks[word[start:end]] for start, end in enumerate(ends) if end]


class _Chunk:
    """Documents as places of distinct words, of which ``known`` has those of earlier chunks."""

    def __init__(self, known: pa.StringArray):
        self.kept, self.lengths, self.places = [], [], []
        self.known, self.before = known, len(known)
        self.bytes = 0

    def add(self, kept: pa.Array, texts: pa.Array, split: regex.Pattern) -> None:
        self.kept.append(kept)
        words: list[str] = []
        for text in texts.to_pylist():
            found = split.findall(text) if text else []
            self.lengths.append(len(found))
            words += found
        coded = pa.array(words, pa.string()).dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=self.known)
        fresh = found.is_null()
        places = found.fill_null(0).to_numpy().copy()
        places[fresh.to_numpy(zero_copy_only=False)] = np.arange(found.null_count) + len(self.known)
        self.known = pa.concat_arrays([self.known, coded.dictionary.filter(fresh)])
        self.places.append(places[coded.indices.to_numpy()])

    def _new_words(self, byte_ids: np.ndarray, ranks: Broadcast) -> pa.ListArray:
        """The ids of the bytes of each new word; a long one is merged, with ids below zero."""
        fresh = self.known.slice(self.before)
        sizes = pc.binary_length(fresh).to_numpy().astype(np.int64)
        ends = np.cumsum(sizes)
        spelled = b"".join(fresh.cast(pa.binary()).to_pylist())
        long = np.flatnonzero(sizes > LONG_BYTES)
        parts = np.split(byte_ids[np.frombuffer(spelled, np.uint8)], np.stack([ends[long] - sizes[long], ends[long]], 1).ravel())
        for at, i in enumerate(long):
            merged = merge_long(spelled[ends[i] - sizes[i] : ends[i]], ranks.value)
            parts[2 * at + 1] = -1 - np.array(merged, np.int32)
            sizes[i] = len(merged)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))

    def row(self, byte_ids: np.ndarray, ranks: Broadcast) -> pa.RecordBatch:
        words = self._new_words(byte_ids, ranks)
        kept = pa.concat_arrays(self.kept)
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept),
                pa.array([np.array(self.lengths, "<i4").tobytes()]),
                pa.array([np.concatenate(self.places).astype("<i4").tobytes()]),
                pa.array([self.before], pa.int32()),
                pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
            ],
            names=["kept", "lengths", "places", "before", "words"],
        )


def _pack(byte_ids: np.ndarray, pattern: str, ranks: Broadcast):
    """Arrow batches of documents -> chunks, each with the words new to its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, chunk = regex.compile(pattern), _Chunk(pa.array([], pa.string()))
        for batch in batches:
            for part in batch_parts(batch, "text", min(PART_BYTES, CHUNK_BYTES)):
                size = pc.sum(pc.binary_length(part["text"])).as_py() or 0
                if chunk.kept and chunk.bytes + size > CHUNK_BYTES:
                    yield chunk.row(byte_ids, ranks)
                    chunk = _Chunk(chunk.known if len(chunk.known) < KNOWN_WORDS else chunk.known[:0])
                chunk.add(part["kept"], part["text"], split)
                chunk.bytes += size
        if chunk.kept:
            yield chunk.row(byte_ids, ranks)

    return run


def _unpack(digest: bool):
    """Chunks with their new words encoded -> one row of ids for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            for row in range(batch.num_rows):
                chunk = batch.slice(row, 1)
                kept, words = chunk.column("kept").flatten(), chunk.column("words").flatten()
                known = words = pa.concat_arrays([known, words]) if chunk.column("before")[0].as_py() else words
                lengths = np.frombuffer(chunk.column("lengths")[0].as_buffer(), "<i4")
                places = np.frombuffer(chunk.column("places")[0].as_buffer(), "<i4")
                sizes = words.value_lengths().to_numpy(zero_copy_only=False)[places]
                ids = words.take(pa.array(places)).flatten()
                ends = np.concatenate([[0], np.cumsum(sizes)])
                offsets = ends[np.concatenate([[0], np.cumsum(lengths)])]
                columns = [kept, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), ids)]
                if digest:
                    packed = ids.to_numpy(zero_copy_only=False).astype("<u4")
                    spans = zip(offsets[:-1], offsets[1:], strict=True)
                    columns.append(pa.array([hashlib.sha256(packed[a:b].tobytes()).hexdigest() for a, b in spans], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["kept", "ids", "digest"][: len(columns)])

    return run


def encode(
    docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", digest: str | None = None
) -> DataFrame:
    """All columns but ``text``, and ``ids array<int>``: what the rank file makes of the text.

    ``digest`` names a column for the SHA-256 of the ids as little-endian unsigned 32-bit
    integers, in lower-case hex.
    """
    others = [name for name in docs.columns if name != text]
    added = [name for name in (ids, digest) if name]
    for name in added:
        if name.lower() in {other.lower() for other in others}:
            raise ValueError(f"The documents have a column {name} already; name another")
    kept = F.struct(*(F.col(f"`{name}`").alias(f"c{i}") for i, name in enumerate(others)), F.lit(0).alias("last"))
    rows = docs.select(kept.alias("kept"), F.col(f"`{text}`").alias("text"))
    byte_ids = np.array(vocabulary(path).byte_ids, np.int32)
    kept_type = rows.schema["kept"].dataType
    chunk = T.StructType(
        [
            T.StructField("kept", T.ArrayType(kept_type)),
            T.StructField("lengths", T.BinaryType()),
            T.StructField("places", T.BinaryType()),
            T.StructField("before", T.IntegerType()),
            T.StructField("words", T.ArrayType(T.ArrayType(T.IntegerType()))),
        ]
    )
    ranks = docs.sparkSession.sparkContext.broadcast(
        {piece: rank for rank, piece in enumerate(vocabulary(path).pieces) if piece}
    )
    chunks = rows.mapInArrow(_pack(byte_ids, pattern, ranks), chunk)
    encoded = chunks.withColumn(
        "words",
        let(rank_map(path), lambda ranks: F.transform("words", lambda w: fold_merges(w, ranks))),
    )
    result = T.StructType(
        [T.StructField("kept", kept_type), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    )
    if digest:
        result = result.add("digest", T.StringType())
    return encoded.mapInArrow(_unpack(bool(digest)), result).select(
        *(F.col(f"kept.c{i}").alias(name) for i, name in enumerate(others)),
        *(F.col(found).alias(name) for found, name in zip(("ids", "digest"), added)),
    )


def decode(ids: Column, path: str) -> Column:
    """The bytes that the ids stand for; null ids give null."""
    written = F.split(F.lit(",".join(piece.hex() for piece in vocabulary(path).pieces)), ",")
    return let(
        written,
        lambda pieces: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")),
    )
