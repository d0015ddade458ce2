"""A Merkle manifest of a dataset as a tree of SHA-256 midstates.

Every row is a leaf: the digest of its fields, each as byte count and value.  The leaves
of a source, in order of their ids, and the subroots of all sources, in order of the
sources, form trees of ``ARITY`` children a parent; a parent is the digest of its
children's digests.  While a parent is built, the state of the hash is copied before each
child goes in.  To fold a changed child, the copy of its slot is resumed and takes in the
new digest and the right siblings only; what lies left of it is in the state already.

On Spark the nodes of one level are numbered without a global sort in one task: they are
dealt by ranges of (group, order), numbered where they lie, and shifted by the counts of
the ranges before.  ``LEVELS`` levels make a chunk of at most 256 neighbours, which is
one row; its digest is a node of the next tier, so the number of rounds is the logarithm
of the largest group to base 256.  A hot source has many chunks and so many tasks.  On
the way down each chunk hands its members the slots and siblings above them, and the
lowest tier folds every leaf through its own chunk and then through the path above.
Copied states live as long as the task that holds their chunk: a hash object cannot be
stored, so a lost task builds its chunk's states again from the stored digests.

Cases: a null field is ``-``; an empty text has length 0.  A null source is a source of
its own and comes first; null ids come first in theirs.  Rows with equal ids are ordered
by their leaves, and equal rows are leaves of their own.  A source of one row has its
leaf as subroot; a table of one source has its subroot as root.  Texts are digested whole
inside the JVM.  An empty table gives an empty manifest.  The result has fixed columns,
so other columns of the input cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import stored

#: Children of a parent, and the fields of a leaf in their order.
ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 2
CHUNK = ARITY**LEVELS

NODE = "grp string, place string, id long, digest string, altered string"
NODE_NAMES = [field.split()[0] for field in NODE.split(", ")]
#: A step up: how many siblings lie left, and all siblings' digests in order.
PATH = "array<struct<slot:int,siblings:array<string>>>"


def packed(value: Column) -> Column:
    """Byte count, colon and value, or a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(packed(values[name]) for name in FIELDS)), 256)


def leaves(docs: DataFrame, changed: Column | None = None, text: Column | None = None) -> DataFrame:
    """One node for each row; ``altered`` is its digest with another text where changed."""
    fields = {name: F.col(f"`{name}`") for name in FIELDS}
    own = leaf(fields)
    other = own if changed is None else F.when(changed, leaf(fields | {"text": text})).otherwise(own)
    return docs.select(
        group_of(fields["source"]).alias("grp"),
        F.lit(None).cast("string").alias("place"),
        fields["doc_id"].cast("long").alias("id"),
        own.alias("digest"),
        other.alias("altered"),
    )


def group_of(source: Column) -> Column:
    """A source as a key without nulls that sorts like it, null first."""
    return F.coalesce(F.concat(F.lit("+"), source.cast("string")), F.lit(""))


def numbered(nodes: DataFrame) -> DataFrame:
    """Add ``pos``, from 0 within each group by (place, id, digest), and the group's ``size``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, last, local = TaskContext.get().partitionId(), -1, None, 0
        for batch in batches:
            runs, places = [], []
            for group in batch.column(0).to_pylist():
                if group != last:
                    last, run, local = group, run + 1, 0
                runs.append(run)
                places.append(local)
                local += 1
            own = [pa.array([part] * len(batch), pa.int32()), pa.array(runs, pa.int32()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, "part", "run", "local"])

    order = ["grp", "place", "id", "digest"]
    dealt = nodes.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(dealt.mapInArrow(count, f"{NODE}, part int, run int, local long"), "numbered")
    # A row for each range and group in it: few, whatever the number of nodes.
    counts = placed.groupBy("part", "run").agg(F.first("grp").alias("grp"), F.count("*").alias("n"))
    whole = Window.partitionBy("grp")
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("part", "run", F.coalesce(before, F.lit(0)).alias("shift"), F.sum("n").over(whole).alias("size"))
    joined = placed.join(shifts, ["part", "run"])
    return joined.select(*NODE_NAMES, (F.col("local") + F.col("shift")).alias("pos"), "size")


def digest_of(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def chunk_levels(digests: list[str], size: int) -> list[list[str]]:
    """The levels of a chunk from its members to its top: ``LEVELS`` of them above the
    members, or fewer where the whole group (of ``size``) ends in one node earlier."""
    levels = [digests]
    for _ in range(LEVELS):
        if size <= 1:
            break
        below = levels[-1]
        levels.append([digest_of(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
        size = -(-size // ARITY)
    return levels


CHUNKS = (
    "grp string, pos long, size long, "
    "members array<struct<place:string,id:long,digest:string,altered:string>>, top string"
)


def grow(nodes: DataFrame, label: str) -> list[DataFrame]:
    """Tiers of ``CHUNKS`` from numbered nodes up to the tier where every group is one
    chunk; each round has a 256th of the rows before."""
    names = [field.split()[0] for field in CHUNKS.split(", ")]

    @F.udf("string")
    def top(digests, size):
        return chunk_levels(digests, size)[-1][0]

    tiers = []
    while True:
        # A group of this key is one chunk: at most 256 nodes.
        chunks = nodes.groupBy("grp", F.expr(f"pos div {CHUNK}").alias("pos")).agg(
            F.max("size").alias("size"),
            F.array_sort(F.collect_list(F.struct("pos", "place", "id", "digest", "altered"))).alias("members"),
        )
        chunks = chunks.withColumn("members", F.transform("members", lambda member: member.dropFields("pos")))
        chunks = chunks.withColumn("top", top(F.col("members.digest"), F.col("size")))
        tiers.append(stored(chunks.select(*names), f"{label}-{len(tiers)}"))
        if tiers[-1].where(F.col("size") > CHUNK).isEmpty():
            return tiers
        nodes = tiers[-1].select(
            "grp", "pos", F.expr(f"(size + {CHUNK - 1}) div {CHUNK}").alias("size"),
            *(F.lit(None).cast(kind).alias(name) for name, kind in (("place", "string"), ("id", "long"))),
            F.col("top").alias("digest"), F.col("top").alias("altered"),
        )


def members_of(levels: list[list[str]]) -> Iterator[list[tuple[int, list[str]]]]:
    """For each member of a chunk: its slot and its siblings, level by level."""
    for place in range(len(levels[0])):
        path = []
        for level in levels[:-1]:
            start = place - place % ARITY
            run = level[start : start + ARITY]
            slot = place - start
            path.append((slot, run[:slot] + run[slot + 1 :]))
            place //= ARITY
        yield path


def given(chunks: DataFrame) -> DataFrame:
    """``grp, pos, place, path, subroot`` of all members of chunks with path and subroot."""

    @F.udf(f"array<{PATH}>")
    def paths_of(digests, size, path):
        upper = [(step.slot, step.siblings) for step in path]
        return [own + upper for own in members_of(chunk_levels(digests, size))]

    paths = paths_of(F.col("members.digest"), F.col("size"), F.col("path"))
    zipped = F.arrays_zip(F.col("members.place").alias("place"), paths.alias("path"))
    rows = chunks.select("grp", "subroot", (F.col("pos") * CHUNK).alias("first"), F.posexplode(zipped).alias("nth", "x"))
    return rows.select("grp", (F.col("first") + F.col("nth")).alias("pos"), "x.place", "x.path", "subroot")


def hand_down(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest tier with the ``path`` above each chunk and its group's ``subroot``;
    ``above`` has both for each group."""
    chunks = tiers[-1].join(above, "grp")
    for tier in reversed(tiers[:-1]):
        chunks = tier.join(given(chunks).drop("place"), ["grp", "pos"])
    return chunks


class Node:
    """A parent with a copied hash state before each child's slot."""

    def __init__(self, children: list[str]):
        self.children, self.states = children, []
        state = hashlib.sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def fold(self, slot: int, replacement: str) -> str:
        """The parent's digest with another child: resume before it, add what is right of it."""
        state = self.states[slot].copy()
        state.update("".join([replacement, *self.children[slot + 1 :]]).encode())
        return state.hexdigest()


class Tree:
    """The nodes of one chunk and of the path above it, with their states."""

    def __init__(self, digests: list[str], size: int, above: list[tuple[int, list[str]]]):
        self.levels = chunk_levels(digests, size)
        self.nodes = [
            [Node(level[i : i + ARITY]) for i in range(0, len(level), ARITY)] for level in self.levels[:-1]
        ]
        self.above, digest = [], self.levels[-1][0]
        for slot, siblings in above:
            node = Node([*siblings[:slot], digest, *siblings[slot:]])
            self.above.append((slot, node))
            digest = node.digest
        self.root = digest
        self.upper = "".join(sibling for _, siblings in above for sibling in siblings)

    def fold(self, place: int, replacement: str) -> str:
        for level in self.nodes:
            replacement = level[place // ARITY].fold(place % ARITY, replacement)
            place //= ARITY
        for slot, node in self.above:
            replacement = node.fold(slot, replacement)
        return replacement

    def proofs(self) -> Iterator[str]:
        for path in members_of(self.levels):
            own = "".join(sibling for _, siblings in path for sibling in siblings)
            yield hashlib.sha256((own + self.upper).encode()).hexdigest()


RESULT = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
    "folded_root string, verified boolean"
)


def folded(chunks: DataFrame) -> DataFrame:
    """``RESULT`` for every leaf of the lowest tier's chunks (with ``subroot`` and ``path``)."""
    names = [field.split()[0] for field in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in range(len(batch)):  # at most 256 leaves at a time
                row = batch.slice(chunk, 1).to_pylist()[0]
                members = row["members"]
                above = [(step["slot"], step["siblings"]) for step in row["path"]]
                tree = Tree([m["digest"] for m in members], row["size"], above)
                found = []
                for place, (member, proof) in enumerate(zip(members, tree.proofs(), strict=True)):
                    root = tree.fold(place, member["altered"])
                    found.append((member["id"], member["digest"], row["subroot"], tree.root, proof, root, root == tree.root))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, pa_type) for column, pa_type in zip(zip(*found), TYPES, strict=True)], names
                )

    return chunks.select("size", "members", "subroot", "path").mapInArrow(run, RESULT)


TYPES = [pa.int64(), *[pa.string()] * 5, pa.bool_()]


def manifest(docs: DataFrame, changed: Column | None = None, text: Column | None = None) -> DataFrame:
    """``RESULT``: every row's leaf, its source's subroot, the root, the digest of its
    proof (siblings from the leaf to the root), and the root folded from the leaf, with
    another text where ``changed``."""
    tiers = grow(numbered(leaves(docs, changed, text)), "leaves")
    # In the highest tier a whole group is one chunk: its top is the subroot.
    subroots = tiers[-1].select(
        F.lit("").alias("grp"), F.col("grp").alias("place"), F.lit(None).cast("long").alias("id"),
        F.col("top").alias("digest"), F.col("top").alias("altered"),
    )
    sources = grow(numbered(subroots), "sources")
    nothing = F.array().cast(PATH)
    top = sources[-1].select("grp", nothing.alias("path"), F.lit(None).cast("string").alias("subroot"))
    over = given(hand_down(sources, top.distinct())).select(F.col("place").alias("grp"), "path")
    over = over.join(subroots.select(F.col("place").alias("grp"), F.col("digest").alias("subroot")), "grp")
    return folded(hand_down(tiers, over))
