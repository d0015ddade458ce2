"""A stored snapshot of a corpus, refreshed incrementally, as plain Parquet tables.

Layout under the index folder::

    state/                              one row per refresh; the last one counts
    <data>/passages/slot=<n>/           sorted by path and ordinal
    <data>/postings/slot=<n>/           sorted by term
    <data>/terms/slot=<n>/              per term and file: its frequency and what bounds its score
    manifests/<name>/                   path, stamp, ...; bucketed and sorted by path
    skipped/<name>/                     what a refresh could not read

A path's hash names its slot; their number is chosen when an index is built.  A refresh
lists the source anew and compares manifests, which lie in the same buckets of the path,
so the comparison moves neither side.  Only new and changed documents are read and
tokenized; then the slots of all paths that were added, changed or removed are written
again by dynamic partition overwrite, and the state comes last.  A source that fails
leaves everything as it was.  A state without a manifest says that slots are being
written; if writing breaks off, the next refresh finds it and rebuilds.  Open the corpus
anew after a refresh, and don't let refreshes of one index overlap.  ``rebuild`` reads
everything again into a new data folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import changes as C
from gleaner.operators import lexical as L
from gleaner.operators import passages as P
from gleaner.plans import corpus as corpora
from gleaner.session import materialize, materialize_counted, passing_folder, scratch, setting

FORMAT = "3"
#: Slots of an index, from its number of documents: a bounded number of folders.
DOCUMENTS_PER_SLOT, FEWEST_SLOTS, MOST_SLOTS = 50_000, 16, 1024
DOCUMENTS_PER_TASK = 5_000
#: Passages that stay are written again where they are read, unless more paths than this
#: left them, or their slots have gathered so many files for each task that deals them.
MOVED_IN_PLACE, FILES_IN_PLACE = 1_000_000, 4
#: Bytes of stored passages that a task turns into postings, which it has to sort.
BYTES_PER_TASK = 16 << 20
STATE = (
    "version long, settings string, data string, slots int, manifest string, skipped string, "
    "documents long, passages long, tokens long"
)
PASSAGES = (
    "path string, ordinal int, text string, digest string, source string, dl int, "
    "runs array<string>, slot int"
)
POSTINGS = "term string, path string, ordinal int, tf_path int, tf_text int, dl int, slot int"
TERMS = "term string, df long, most double, shortest int, slot int"
MANIFEST = "path string, stamp string, source string, passages long, tokens long"

Progress = Callable[[str, dict], None]


class Source(Protocol):
    """Where an index gets its documents."""

    identity: str

    def listing(self) -> DataFrame:
        """What there is now, stored; the other two methods get it back."""

    def manifest(self, listing: DataFrame) -> DataFrame:
        """``path, stamp`` of every document in the listing."""

    def read(self, listing: DataFrame, paths: DataFrame | None) -> DataFrame:
        """``path, stamp, text, source, reason`` of the named documents, or of all."""


@dataclass(frozen=True)
class Refresh:
    documents: int
    passages: int
    updated: int
    skipped: int
    removed: int


def slot_of(path: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(slots)).cast("int")


def tasks_per_slot(documents: int, slots: int) -> int:
    return -(-max(documents, 1) // (slots * DOCUMENTS_PER_TASK))


def dealt(rows: DataFrame, slots: int, documents: int) -> DataFrame:
    """Rows by their path: its hash gives a place, and the place its slot, so that large
    slots are written by several tasks and small ones by one."""
    places = slots * tasks_per_slot(documents, slots)
    return rows.repartitionById(places, slot_of(F.col("path"), places))


class Index:
    def __init__(self, spark: SparkSession, folder: str, chunk_chars: int = P.CHUNK_CHARS):
        self._spark = spark
        self._folder = folder.rstrip("/")
        self._chunk_chars = P.check_chunk_chars(chunk_chars)

    def _settings(self, identity: str) -> str:
        return json.dumps(
            {"format": FORMAT, "chunk_chars": self._chunk_chars, "source": identity},
            sort_keys=True,
        )

    def _last_state(self) -> tuple[Row | None, bool]:
        """The last complete state, and whether a later refresh broke off."""
        try:
            states = self._spark.read.schema(STATE).parquet(f"{self._folder}/state")
            last = states.orderBy(F.desc("version")).limit(2).collect()
            whole = states.where("manifest IS NOT NULL").orderBy(F.desc("version")).first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None, False
        if len(last) == 2 and last[0].version == last[1].version:
            raise RuntimeError(f"Two refreshes of {self._folder} overlapped; rebuild it")
        return whole, bool(last) and last[0].manifest is None

    def _current(self) -> Row:
        state, _ = self._last_state()
        if state is None:
            raise ValueError(f"{self._folder} holds no index yet")
        return state

    def _add_state(self, *values) -> None:
        row = self._spark.createDataFrame([values], STATE).coalesce(1)
        row.write.mode("append").parquet(f"{self._folder}/state")

    # Reading

    def _table(self, state: Row, kind: str, schema: str) -> DataFrame:
        """One table; the row that marks a slot as written has no values."""
        rows = self._spark.read.schema(schema).parquet(f"{self._folder}/{state.data}/{kind}")
        return rows.where(F.col(schema.split()[0]).isNotNull())

    def _passages(self, state: Row) -> DataFrame:
        return self._table(state, "passages", PASSAGES)

    def _postings(self, state: Row, terms: list[str] | None) -> DataFrame:
        rows = self._table(state, "postings", POSTINGS)
        # The term's row groups are found by their least and greatest terms.
        return rows if terms is None else rows.where(F.col("term").isin(terms))

    def _term_stats(self, state: Row, wanted: DataFrame) -> DataFrame:
        """``term, df, most, shortest`` of the wanted terms, summed up over the slots."""
        rows = self._table(state, "terms", TERMS).join(wanted.select("term").distinct(), "term", "left_semi")
        return rows.groupBy("term").agg(
            F.sum("df").alias("df"), F.max("most").alias("most"), F.min("shortest").alias("shortest")
        )

    def _in_slots(self, state: Row, paths: DataFrame) -> DataFrame:
        """Passages in the slots of some paths; what is collected are numbers of slots."""
        rows = paths.select(slot_of(F.col("path"), state.slots).alias("slot")).distinct()
        numbers = [row.slot for row in rows.collect()]
        found = self._passages(state)
        return found.where(F.col("slot").isin(numbers)) if numbers else found.where("false")

    def _lookup(self, state: Row, keys: DataFrame, prepare: corpora.Prepare) -> DataFrame:
        """Passages by (path, ordinal), prepared once however many keys name them."""
        wanted = keys.select("path", "ordinal").distinct()
        found = self._in_slots(state, keys).join(wanted, ["path", "ordinal"], "left_semi")
        return prepare(found).join(keys, ["path", "ordinal"])

    def _texts(self, state: Row, paths: DataFrame) -> DataFrame:
        wanted = self._in_slots(state, paths).join(paths.select("path"), "path", "left_semi")
        return P.rebuild(wanted, self._chunk_chars)

    def _manifest(self, state: Row) -> DataFrame:
        return C.open_manifest(self._spark, f"{self._folder}/manifests/{state.manifest}", MANIFEST, state.slots)

    def documents(self) -> DataFrame:
        return self._manifest(self._current())

    def passages(self) -> DataFrame:
        return self._passages(self._current())

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """All postings, or those of the given terms, pruned at the scan."""
        return self._postings(self._current(), terms)

    def term_df(self, wanted: DataFrame) -> DataFrame:
        """``term, df``: in how many passages each wanted term occurs."""
        return self._term_stats(self._current(), wanted).select("term", "df")

    def skipped(self) -> DataFrame:
        """``path, reason`` of what the last refresh could not read."""
        folder = f"{self._folder}/skipped/{self._current().skipped}"
        return self._spark.read.schema("path string, reason string").parquet(folder)

    def corpus(self) -> corpora.Corpus:
        """The corpus as it is stored now."""
        state = self._current()
        return corpora.Corpus(
            documents=self._manifest(state),
            passages=self._passages(state),
            postings=lambda terms: self._postings(state, terms),
            term_stats=lambda wanted: self._term_stats(state, wanted),
            fetch=lambda keys, prepare: self._lookup(state, keys, prepare),
            texts=lambda paths: self._texts(state, paths),
            document_count=state.documents,
            passage_count=state.passages,
            mean_length=state.tokens / state.passages if state.tokens else 1.0,
            chunk_chars=self._chunk_chars,
        )

    # Refreshing

    def refresh(self, source: Source, rebuild: bool = False, progress: Progress | None = None) -> Refresh:
        """Bring the index up to date with what the source holds now.

        ``progress`` is called with the name of each finished step and its counters,
        which the step's own job has observed.
        """
        settings = self._settings(source.identity)
        before, broken_off = self._last_state()
        if before is not None and before.settings != settings:
            raise ValueError(f"{self._folder} was built from another source or chunk size")
        with scratch(self._spark):
            return self._refresh(source, settings, before, rebuild or broken_off, progress or (lambda *_: None))

    def _refresh(self, source: Source, settings: str, before: Row | None, rebuild: bool, progress: Progress) -> Refresh:
        name, listing = uuid.uuid4().hex[:12], source.listing()
        if before is None or rebuild:
            listed = listing.count()
            slots = min(MOST_SLOTS, max(FEWEST_SLOTS, -(-listed // DOCUMENTS_PER_SLOT)))
            data, paths, diff = f"data-{name}", None, None
        else:
            slots, data = before.slots, before.data
            new = C.store_manifest(source.manifest(listing), passing_folder(self._spark, "listed"), slots)
            diff, counted = materialize_counted(
                C.snapshot_diff(self._manifest(before), new), "diff",
                removed=F.count_if(F.col("class") == C.REMOVED), listed=F.count("*"),
            )
            listed = counted["listed"]
            progress("compared", counted)
            paths = diff.where(F.col("class").isin(C.ADDED, C.CHANGED)).select("path")

        staged, counted = self._staged(source.read(listing, paths))
        progress("read", counted)
        fresh = self._fresh_documents(staged)
        refused = staged.where("reason IS NOT NULL").select("path", "reason")
        refused.write.parquet(f"{self._folder}/skipped/{name}")

        accepted = staged.where("reason IS NULL").select("path", "text", "source")
        version = before.version + 1 if before else 1
        touched = None
        if diff is None:
            self._write_slots(data, accepted, slots, None, listed)
        else:
            moved = materialize(diff.where(F.col("class") != C.KEPT).select("path"), "moved")
            places = moved.select(slot_of(F.col("path"), slots).alias("slot")).distinct()
            touched = [row.slot for row in places.collect()]
            if touched:
                self._add_state(version, settings, data, slots, None, None, 0, 0, 0)
                stored = self._passages(before).where(F.col("slot").isin(touched))
                in_place = moved.count() <= MOVED_IN_PLACE
                kept = stored.join(F.broadcast(moved) if in_place else moved, "path", "left_anti")
                if not in_place or len(stored.inputFiles()) > FILES_IN_PLACE * len(touched) * tasks_per_slot(listed, slots):
                    kept = dealt(kept, slots, listed)
                self._write_slots(data, accepted, slots, kept, listed, touched)
        progress("written", {"slots": slots if touched is None else len(touched)})

        sizes = self._written(data, "passages", PASSAGES, range(slots) if touched is None else touched)
        sizes = sizes.groupBy("path").agg(F.count("*").alias("passages"), F.sum("dl").alias("tokens"))
        found = self._write_manifest(name, slots, fresh, sizes, None if diff is None else (before, new))
        updated, skipped = counted["documents"], counted["skipped"]
        removed = self._removed(before, name, slots)
        self._add_state(
            version + 1, settings, data, slots, name, name, found["documents"], found["passages"], found["tokens"]
        )
        done = Refresh(found["documents"], found["passages"], updated, skipped, removed)
        progress("done", vars(done))
        return done

    def _write_manifest(
        self, name: str, slots: int, fresh: DataFrame, sizes: DataFrame, both: tuple[Row, DataFrame] | None
    ) -> dict:
        """Unchanged rows, bucket by bucket, and fresh ones with the sizes of what was written
        for them; the writing jobs sum them up."""
        folder = f"{self._folder}/manifests/{name}"
        totals = {"documents": 0, "passages": 0, "tokens": 0}
        sums = [F.coalesce(F.sum(column), F.lit(0)).alias(column) for column in ("passages", "tokens")]
        if both is not None:
            before, new = both
            same = new.select("path", F.col("stamp").alias("listed"))
            kept = self._manifest(before).join(same.hint("merge"), "path").where("stamp <=> listed").drop("listed")
            seen = Observation()
            stored = C.store_manifest(kept.observe(seen, F.count("*").alias("documents"), *sums), folder, slots, True)
            if not stored.isEmpty():
                totals = seen.get
        seen, empty = Observation(), fresh.isEmpty()
        fresh = fresh.join(sizes, "path")
        C.store_manifest(fresh if empty else fresh.observe(seen, F.count("*").alias("documents"), *sums), folder, slots)
        return totals if empty else {key: totals[key] + value for key, value in seen.get.items()}

    def _removed(self, before: Row | None, name: str, slots: int) -> int:
        """How many documents of the state before are not in the new manifest."""
        if before is None:
            return 0
        new = C.open_manifest(self._spark, f"{self._folder}/manifests/{name}", MANIFEST, slots)
        return C.removed_docs(self._manifest(before), new).count()

    def _staged(self, read: DataFrame) -> tuple[DataFrame, dict]:
        """One pass over the source: its documents, and a row for each refusal; the same job
        counts them and their passages."""
        refused = F.col("reason").isNotNull()
        rows = read.withColumn("text", F.when(~refused, F.col("text")))
        return materialize_counted(
            rows, "staged",
            documents=F.count_if(~refused), skipped=F.count_if(refused),
            passages=F.coalesce(F.sum(F.when(~refused, T.window_count(F.col("text"), self._chunk_chars))), F.lit(0)),
        )

    def _fresh_documents(self, staged: DataFrame) -> DataFrame:
        per_document = staged.where("reason IS NULL").groupBy("path").agg(
            F.max("stamp").alias("stamp"), F.max("source").alias("source"), F.count("*").alias("copies")
        )
        checked = per_document.withColumn("path", P.unique_path(F.col("path"), F.col("copies"))).drop("copies")
        return materialize(checked, "fresh")

    def _write_slots(
        self, data: str, accepted: DataFrame, slots: int, kept: DataFrame | None, documents: int,
        touched: list[int] | None = None,
    ) -> None:
        """Write whole slots of the three tables, each from the one before: accepted documents,
        and the passages that are kept of those slots.

        Documents are dealt to their slots before they are cut and tokenized, because their
        passages and runs are larger.
        """
        numbers = list(range(slots)) if touched is None else touched
        passages = L.term_frequencies(P.chunk(dealt(accepted, slots, documents), self._chunk_chars), keep=["text", "digest", "source"])
        passages = passages.withColumn("slot", slot_of(F.col("path"), slots))
        if kept is not None:
            passages = passages.unionByName(kept)
        # From here on tasks read files of few slots, in their order: no shuffle.  They read
        # few bytes, because they sort them, or many more postings.
        with setting(self._spark, "spark.sql.files.maxPartitionBytes", str(BYTES_PER_TASK)):
            self._overwrite(data, "passages", passages, PASSAGES, numbers, "path", "ordinal")
            rows = self._written(data, "passages", PASSAGES, numbers)
            self._overwrite(data, "postings", L.postings_of(rows, "slot"), POSTINGS, numbers, "term")
            # Each task counts the runs it reads; readers add up the rows of a term.
            counted = rows.select("slot", "runs", "dl").mapInArrow(L.count_terms, TERMS)
            self._overwrite(data, "terms", counted, TERMS, numbers, "term")

    def _written(self, data: str, kind: str, schema: str, numbers: Iterable[int]) -> DataFrame:
        rows = self._table(Row(data=data), kind, schema)
        return rows.where(F.col("slot").isin(list(numbers)))

    def _overwrite(self, data: str, kind: str, rows: DataFrame, schema: str, numbers: list[int], *order: str) -> None:
        """Replace the named slots; each gets a row without values, so that an empty one
        is replaced too."""
        names = [field.split()[0] for field in schema.split(", ")]
        marks = self._spark.createDataFrame([(n,) for n in numbers], "slot int").coalesce(1)
        both = rows.select(*names).unionByName(marks, allowMissingColumns=True)
        ordered = both.sortWithinPartitions("slot", *order)
        writer = ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("slot").parquet(f"{self._folder}/{data}/{kind}")
