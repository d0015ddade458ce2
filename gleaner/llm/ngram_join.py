"""N-gram Jaccard self-join with a token-group matrix.

A document is the set of its distinct five-word shingles.  Two documents link when
100 * intersection >= 75 * union.  Equal sets are collapsed first, then:

1. *Groups.*  Sets that share one of a few min-hashes are compared with the smallest
   set of that min-hash; verified links join similar sets into groups.
2. *Matrix.*  For each group the union of its members' first tokens is stored as
   (token, group) rows; a large group has a row for each part of about PART members.
   Tokens of one group only are dropped.
3. *Bound.*  Groups meet, part by part, where they hold the same first tokens; two parts
   qualify if they share enough of them for one pair of members to reach the similarity.
4. *Open.*  Of each two groups that meet, the pair that looks closest is compared first,
   and groups that it links become one.  Where groups stay apart, the sets of the smaller part
   of each two that qualified meet the other part by their own tokens, and the members of the
   parts that a set may reach, of a similar size, are compared with it by their whole sets.
   Links within one component change nothing, so none of them has to be looked for.

Tokens are ordered with the most frequent ones of a sample last.  Sets of n and m tokens
that link share ``o = ceil(PERCENT (n + m) / (100 + PERCENT))``, so they share
``1 + EXTRA`` among the first ``n - o + 1 + EXTRA`` of the one and the first
``m - o + 1 + EXTRA`` of the other; which tokens count thus depends on both sizes.  The
order is the same for all sets.  The sample steers cost, never results.

A null, blank or empty text has an empty set and links with nothing, not even with
another empty one.  Very long texts give long sets, nothing is cut.  Repeated rows fall
together.  Null ids take part in links but are never the id of a component, unless no
member has one.  An empty table gives an empty one.  Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import batch_parts, free_name, small, stored
from gleaner.llm.graph import components

SIZE = 5
PERCENT = 75
#: Min-hashes of a set; sets that share one of the first BANDS are compared to form groups.
SKETCH = 16
BANDS = 4
#: First tokens beyond the fewest that decide; they make the bound on groups stricter.
EXTRA = 2
#: About so many members of a group share one row of the matrix; the fewer, the tighter.
PART = 64
#: The order of tokens: so many frequent ones of one document in SAMPLE go last.
SAMPLE = 64
FREQUENT = 100_000
#: Bytes of text that a task takes apart at a time; as Python's words they are many times larger.
PART_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
SEEDS = np.random.default_rng(20).integers(1, 2**63, SKETCH, dtype=np.uint64)


def mix(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(32))


def shingle_sets(texts: list[str | None], size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text.

    Words are runs without space, tab, line feed, vertical tab, form feed and carriage
    return; A-Z count as a-z.  Fewer words than ``size`` make one shingle together.
    """
    # bytes.lower and bytes.split know just these letters and spaces.
    words = [(text or "").encode("utf-8", "surrogatepass").lower().split() for text in texts]
    coded = pa.array([word for own in words for word in own], pa.binary()).dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(word) for word in coded.dictionary.to_pylist()], np.uint64)
    hashes = known[coded.indices.to_numpy()] if len(known) else known
    sets, start = [], 0
    with np.errstate(over="ignore"):
        for own in words:
            part = hashes[start : start + len(own)]
            start += len(own)
            width = min(size, len(part))
            total = np.full(len(part) - width + 1 if width else 0, width, np.uint64)
            for place in range(width):
                total = total * BASE + part[place : place + len(total)]
            sets.append(np.unique(mix(total)))
    return sets


def probe_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


SET_FIELDS = "key binary, place long, n long, lows array<long>, tokens array<long>"


def _describe(frequent: np.ndarray):
    """Batches of (id, text) -> id and set description; ``frequent`` is sorted by hash."""
    types = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def describe(tokens: np.ndarray) -> tuple:
        n = len(tokens)
        if not n:
            return None, None, 0, None, None
        lows = [int(mix(tokens ^ seed).min() >> np.uint64(1)) for seed in SEEDS]
        at = np.searchsorted(frequent, tokens)
        common = frequent[np.minimum(at, len(frequent) - 1)] == tokens if len(frequent) else at < 0
        ordered = np.concatenate([tokens[~common], tokens[common]])
        length = min(n, probe_size(n) + EXTRA)
        key = xxhash.xxh3_128_digest(tokens.tobytes())
        place = int.from_bytes(key[:8], "big", signed=True)
        return key, place, n, lows, ordered[:length].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch_parts(batch, "text", PART_BYTES):
                rows = [describe(tokens) for tokens in shingle_sets(part.column("text").to_pylist())]
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *columns],
                    names=["id", "key", "place", "n", "lows", "tokens"],
                )

    return run


def _tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of text -> key and whole set."""
    for batch in batches:
        for part in batch_parts(batch, "text", PART_BYTES):
            sets = [own for own in shingle_sets(part.column("text").to_pylist()) if len(own)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([xxhash.xxh3_128_digest(own.tobytes()) for own in sets], pa.binary()),
                    pa.array([own.view(np.int64) for own in sets], pa.list_(pa.int64())),
                ],
                names=["key", "tokens"],
            )


def frequent_tokens(docs: DataFrame) -> np.ndarray:
    """At most ``FREQUENT`` tokens that several documents of a sample share."""
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    counts = (
        sample.mapInArrow(_tokens_of, "key binary, tokens array<long>")
        .select(F.explode("tokens").alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("n"))
        .where("n > 2")
    )
    rows = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()["token"]
    return np.sort(rows.to_numpy(np.int64).view(np.uint64))


def _linked(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= PERCENT * (F.size(a) + F.size(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of keys whose whole sets link."""
    keys = stored(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "keys")
    wanted = keys.join(sets.select("key", "id"), "key").select("id").distinct()
    wanted = stored(wanted, "wanted")
    texts = docs.join(small(wanted), docs["id"].eqNullSafe(wanted["id"]), "left_semi").select("text")
    whole = texts.mapInArrow(_tokens_of, "key binary, tokens array<long>")
    # Rows that repeat an id give a set once; both joins below work on this exchange.
    whole = whole.join(small(keys), "key", "left_semi").dropDuplicates(["key"])
    return (
        pairs.join(whole.select(F.col("key").alias("a"), F.col("tokens").alias("ta")), "a")
        .join(whole.select(F.col("key").alias("b"), F.col("tokens").alias("tb")), "b")
        .where(_linked(F.col("ta"), F.col("tb")))
        .select("a", "b")
    )


def _ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _similar_sizes(a: str, b: str) -> Column:
    low, high = F.least(a, b), F.greatest(a, b)
    return low * 100 >= high * PERCENT


def group_links(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between sets and the most typical set that shares one of their min-hashes.

    The typical set of those that share a min-hash agrees most with their commonest
    min-hashes; copies of one original are mostly linked with it.
    """
    keyed = sets.select("key", F.posexplode(F.slice("lows", 1, BANDS)).alias("band", "low"))
    several = keyed.groupBy("band", "low").agg(F.min("key").alias("a"), F.max("key").alias("b"))
    several = stored(several.where("a != b").select("band", "low"), "several")
    keyed = stored(keyed.join(small(several), ["band", "low"], "left_semi"), "sharing")
    keyed = stored(keyed.join(sets.select("key", "n", "lows"), "key"), "sharing-sketches")
    common = [F.mode(F.get("lows", F.lit(i)), True) for i in range(SKETCH)]
    typical = keyed.groupBy("band", "low").agg(F.array(*common).alias("common"))

    def agreeing(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)

    first = (
        keyed.join(typical, ["band", "low"])
        .withColumn("agreeing", agreeing("lows", "common"))
        .groupBy("band", "low")
        .agg(F.max(F.struct("agreeing", (-F.col("n")).alias("size"), "key", "n", "lows")).alias("first"))
    )
    pairs = (
        keyed.join(first, ["band", "low"])
        .where((F.col("key") != F.col("first.key")) & _similar_sizes("n", "first.n"))
        .where(2 * agreeing("lows", "first.lows") >= SKETCH)
        .select(F.col("key").alias("a"), F.col("first.key").alias("b"))
    )
    return _verified(stored(_ordered_pairs(pairs), "group-pairs"), sets, docs)


def group_parts(roots: DataFrame) -> DataFrame:
    """``key, root_place, root_part``: the group of each linked set and its part of it."""
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    sizes = roots.groupBy("root").agg(F.ceil(F.count("*") / PART).alias("parts"))
    return roots.join(sizes, "root").select(
        F.col("node").alias("key"),
        _place("root").alias("root_place"),
        F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("root_part"),
    )


def _of_groups(sets: DataFrame, parts: DataFrame) -> DataFrame:
    """Sets with ``group, part``; a set without a link is a group of its own."""
    return sets.join(small(parts), "key", "left").withColumns(
        {"group": F.coalesce("root_place", "place"), "part": F.coalesce("root_part", F.lit(0))}
    )


def _first_tokens(described: DataFrame, sets: DataFrame, parts: DataFrame) -> DataFrame:
    """Each set once with its first tokens and, if it is linked, its group."""
    # One row of equal texts has the tokens of all.
    repeated = stored(sets.where("copies > 1").select("key", F.col("id").alias("own_id")), "repeated")
    one = described.where("n > 0").select("id", "key", "place", "n", "tokens").join(small(repeated), "key", "left")
    one = one.where(F.col("own_id").isNull() | (F.col("id") == F.col("own_id"))).join(small(parts), "key", "left")
    return one.select("place", F.col("n").cast("int"), "root_place", "root_part", "tokens")


def _in_groups(tokens: DataFrame, *names: str) -> DataFrame:
    """``names`` with ``group, part``; a set without a link went so far without a group."""
    return tokens.select(
        *names, F.coalesce("root_place", "place").alias("group"), F.coalesce("root_part", F.lit(0)).alias("part"),
        F.col("root_place").isNull().alias("alone"),
    )


def qualifying_groups(first: DataFrame) -> DataFrame:
    """Each two parts of groups that may hold sets like each other, and the tokens that say so.

    ``closest`` is the pair of sets with the fewest tokens before one that both parts hold,
    of sizes that can link if there are any.  A set or group is named here by 64 bits of its
    key.  Sets meet by their parts, so a token that all members of a large group hold makes
    one row for each part of it.  Tokens are dealt out once: finding the tokens of several
    groups, the matrix and the bound all work on the same exchange.
    """
    dealt = first.select("place", "n", "root_place", "root_part", F.posexplode("tokens").alias("at", "token")).repartition("token")
    same = Window.partitionBy("token")
    tokens = _in_groups(dealt, "token", "place", "n", "at")
    shared = tokens.select("*", F.min("group").over(same).alias("low"), F.max("group").over(same).alias("high"))
    held = ["group", "part", "alone", "smallest", "largest", "reach", "sets", "best"]
    matrix = (
        shared.where("low != high")
        .groupBy("token", "group", "part", "alone")
        .agg(
            F.min("n").alias("smallest"),
            F.max("n").alias("largest"),
            F.max(_largest_partner("n", "at")).cast("int").alias("reach"),
            F.count("*").alias("sets"),
            F.min(F.struct("at", "place", "n")).alias("best"),
        )
    )
    others = matrix.select("token", *(F.col(name).alias(f"other_{name}") for name in held))
    larger = F.greatest(F.min("smallest"), F.min("other_smallest"))
    token = F.struct("token", *(f"{side}{name}" for side in ("", "other_") for name in ("smallest", "largest", "reach")))
    unlike = (~_similar_sizes("best.n", "other_best.n")).cast("int").alias("unlike")
    before = (F.col("best.at") + F.col("other_best.at")).alias("before")
    closest = F.struct(unlike, before, F.col("best.place").alias("place"), F.col("other_best.place").alias("with"))
    return (
        matrix.join(others, "token")
        .where((F.col("group") < F.col("other_group")) & (F.col("smallest") <= F.col("other_reach")) & (F.col("other_smallest") <= F.col("reach")))
        .where(
            (F.col("smallest") * PERCENT <= F.col("other_largest") * 100)
            & (F.col("other_smallest") * PERCENT <= F.col("largest") * 100)
        )
        .groupBy("group", "part", "alone", "other_group", "other_part", "other_alone")
        .agg(
            F.collect_list(token).alias("tokens"),
            F.min(closest).alias("closest"),
            F.max("sets").alias("sets"),
            F.max("other_sets").alias("other_sets"),
            F.ceil(larger * PERCENT / 100).alias("needed"),
        )
        .where(F.size("tokens") >= F.least(F.lit(1 + EXTRA), "needed"))
        .drop("needed")
    )


def closest_pairs(qualifying: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: for each two groups the pair of sets that looks closest."""
    pairs = qualifying.groupBy("group", "other_group").agg(F.min("closest").alias("pair")).select("pair.place", "pair.with").distinct()
    names = sets.select("place", "key")
    return _ordered_pairs(
        pairs.join(names.withColumnRenamed("key", "a"), "place")
        .join(names.select(F.col("place").alias("with"), F.col("key").alias("b")), "with")
    )


def apart_groups(qualifying: DataFrame, roots: DataFrame) -> DataFrame:
    """Of the groups that qualify those that are not one by now, without pairs of single sets: those are compared."""
    now = stored(roots.select(_place("node").alias("was"), _place("root").alias("now")), "groups-now")
    # Groups are looked up once for each two that meet, whatever the number of their parts.
    met = qualifying.where("not (alone and other_alone)").select("group", "other_group").distinct()
    for name in ("group", "other_group"):
        own = now.select(F.col("was").alias(name), F.col("now").alias(f"{name}_now"))
        met = met.join(small(own), name, "left").withColumn(f"{name}_now", F.coalesce(f"{name}_now", name))
    apart = met.where("group_now != other_group_now").select("group", "other_group")
    return qualifying.join(apart, ["group", "other_group"], "left_semi")


def opened_pairs(apart: DataFrame, first: DataFrame, sets: DataFrame, parts: DataFrame) -> DataFrame:
    """``a, b``: sets and the members of those parts of other groups that each of them may be like.

    Of two parts the one with fewer sets at a token is taken apart, so a set beside a large
    group meets its parts, and its members do not meet the set one by one.
    """
    names = ["group", "part", "smallest", "largest", "reach"]
    shared = apart.select("group", "part", "other_group", "other_part", "sets", "other_sets", F.inline("tokens"))
    kept = shared.where("sets <= other_sets").select("token", *names, *(f"other_{name}" for name in names))
    turned = shared.where("sets > other_sets").select(
        "token", *(F.col(f"other_{name}").alias(name) for name in names), *(F.col(name).alias(f"other_{name}") for name in names)
    )
    matrix = kept.unionByName(turned).drop("smallest", "largest", "reach")
    places = stored(matrix.select("group", "part").distinct(), "apart-parts")
    own = _in_groups(first, "place", "n", "tokens").drop("alone").join(small(places), ["group", "part"], "left_semi")
    own = own.select("group", "part", "place", "n", F.posexplode("tokens").alias("at", "token"))
    larger = F.greatest("n", F.min("other_smallest"))
    probes = (
        own.join(matrix, ["token", "group", "part"])
        .where((F.col("other_smallest") <= _largest_partner("n", "at")) & (F.col("n") <= F.col("other_reach")))
        .where((F.col("n") * PERCENT <= F.col("other_largest") * 100) & (F.col("other_smallest") * PERCENT <= F.col("n") * 100))
        .groupBy("place", "n", "other_group", "other_part")
        .agg(F.count("*").alias("held"), F.min("at").alias("first_at"), F.ceil(larger * PERCENT / 100).alias("needed"))
        .where(F.col("held") >= F.least(F.lit(1 + EXTRA), "needed"))
    )
    members = _of_groups(sets, parts).select(
        F.col("key").alias("b"), F.col("n").alias("m"), F.col("group").alias("other_group"), F.col("part").alias("other_part")
    )
    opened = probes.join(members, ["other_group", "other_part"]).where(_similar_sizes("n", "m") & _early("n", "m", "first_at"))
    return _ordered_pairs(opened.select("place", "b").join(sets.select("place", F.col("key").alias("a")), "place"))


def _early(n: str, m: Column | str, at: str) -> Column:
    """Whether a token is among the first ones of a set of ``n`` that decide on one of ``m``.

    Sets of these sizes link if they share ``o = ceil(PERCENT (n + m) / (100 + PERCENT))``
    tokens.  Then they share ``1 + EXTRA`` (or ``o``, if fewer) of each one's first
    ``n - o + 1 + EXTRA`` tokens.
    """
    m = F.col(m) if isinstance(m, str) else m
    return PERCENT * (F.col(n) + m) <= (100 + PERCENT) * (F.col(n) - F.col(at) + EXTRA)


def _largest_partner(m: str, at: str) -> Column:
    """The largest set for which a token is still among a set of ``m``'s first ones."""
    return F.floor((100 + PERCENT) * (F.col(m) - F.col(at) + EXTRA) / PERCENT) - F.col(m)


def _place(key: str) -> Column:
    """The 64 bits of a key that name it in the matrix: its first bytes."""
    return F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("long")


def jaccard_components(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` for every row."""
    docs = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    described = docs.mapInArrow(
        _describe(frequent_tokens(docs)), f"id {dict(docs.dtypes)['id']}, {SET_FIELDS}"
    )
    described = stored(described, "described")
    sets = described.where("n > 0").groupBy("key", "place", "n", "lows").agg(
        F.min("id").alias("id"), F.count("*").alias("copies")
    )
    sets = stored(sets, "sets")
    near = stored(group_links(sets, docs), "group-links")
    roots = components(near)
    parts = stored(group_parts(roots), "group-parts")
    first = _first_tokens(described, sets, parts)
    qualifying = stored(qualifying_groups(first), "qualifying")
    closest = stored(closest_pairs(qualifying, sets), "closest-pairs")
    near = stored(near.unionByName(_verified(closest, sets, docs)), "merging-links")
    apart = stored(apart_groups(qualifying, components(near)), "apart-groups")
    pairs = stored(opened_pairs(apart, first, sets, parts), "opened-pairs")
    roots = components(near.unionByName(_verified(pairs, sets, docs)))
    classes = sets.select("key", "id").join(roots, sets["key"] == F.col("node"), "left").withColumn(
        "root", F.coalesce("root", "key")
    )
    classes = stored(classes.select("key", "id", "root"), "classes")
    names = classes.groupBy("root").agg(F.min("id").alias("component_id"))
    named = classes.join(names, "root").select("key", "component_id")
    return described.select("id", "n", "key").join(named, "key", "left").select(
        F.col("id").alias(id),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
    )


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose id names their component, so one document of each stays.

    Rows that repeat an id are all kept or all left out; rows without an id are kept
    only where no linked row has one.
    """
    found = jaccard_components(docs, id, text).where(F.col(f"`{id}`").eqNullSafe(F.col("component_id")))
    name = free_name(docs, "kept_id")
    kept = stored(found.select(F.col(f"`{id}`").alias(name)).distinct(), "kept")
    return docs.join(small(kept), docs[id].eqNullSafe(kept[name]), "left_semi")
