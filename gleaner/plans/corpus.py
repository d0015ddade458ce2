"""What a search needs to know about a corpus, stored or scanned."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from gleaner.fixed import MAX_QUERY_TERMS
from gleaner.functions import text as T
from gleaner.operators import lexical as L
from gleaner.operators import passages as P
from gleaner.session import materialize

#: What a scorer makes of passages before they meet the queries.
Prepare = Callable[[DataFrame], DataFrame]
#: Up to so many distinct words of a batch go to the scan as literals, to prune it.
LITERAL_TERMS = 5_000
#: Candidates judged by one task.
PAIRS_PER_TASK = 20_000


def as_they_are(passages: DataFrame) -> DataFrame:
    return passages


@dataclass(frozen=True)
class Corpus:
    """``documents(path)`` and ``passages`` with their statistics.

    ``postings`` gives the postings of some terms or of all, and ``term_stats`` the
    document frequency, greatest weighted frequency and shortest passage of a frame of
    terms; ``fetch`` turns ``(path, ordinal, ...)`` rows into prepared passages, and
    ``texts`` distinct paths into whole documents.
    """

    documents: DataFrame
    passages: DataFrame
    postings: Callable[[list[str] | None], DataFrame]
    term_stats: Callable[[DataFrame], DataFrame]
    fetch: Callable[[DataFrame, Prepare], DataFrame]
    texts: Callable[[DataFrame], DataFrame]
    document_count: int
    passage_count: int
    mean_length: float
    chunk_chars: int

    def is_exhaustive(self, limit: int) -> bool:
        return limit == 0 or self.document_count <= limit

    def _postings_of(self, terms: DataFrame) -> DataFrame:
        """Postings of a frame of terms: at the scan if they are few, else by the join."""
        words = [row.term for row in terms.select("term").distinct().limit(LITERAL_TERMS + 1).collect()]
        return self.postings(words if len(words) <= LITERAL_TERMS else None)

    def _scores(self, terms: DataFrame, limit: int, single: bool) -> DataFrame:
        mean, count = F.lit(self.mean_length), F.lit(self.passage_count)
        if single:
            entries = self.postings([row.term for row in terms.collect()])
            weights = L.term_weights(L.term_df(entries, terms), terms, count)
            return L.bm25_scores(L.term_matches(entries, weights), mean)
        weights = L.bounded_weights(self.term_stats(terms), terms, count, mean)
        return L.pruned_scores(self._postings_of, materialize(weights, "weights"), mean, limit)

    def shortlist(
        self,
        queries: DataFrame,
        limit: int,
        single: bool = False,
        max_terms: int | None = MAX_QUERY_TERMS,
    ) -> DataFrame:
        """``query_id, path, ordinal, bm25, tier``: ``limit`` documents per query.

        ``single`` says that ``queries`` has one row: its terms become literals, so that
        the postings scan reads nothing else.  Many queries are answered by bounds first
        and exact scores second.  ``max_terms`` bounds the terms of a query (None: all
        of them count).
        """
        terms = L.explode_terms(queries, max_terms)
        scores = self._scores(terms, limit, single)
        lexical = L.lexical_shortlist(L.best_passage(scores), limit, single)
        # Short rows without text; both the fill and the final union read them.
        lexical = materialize(lexical, "lexical")
        return L.complete_shortlist(lexical, queries, self.documents, limit)

    def candidates(
        self,
        queries: DataFrame,
        limit: int,
        single: bool = False,
        max_terms: int | None = MAX_QUERY_TERMS,
        prepare: Prepare = as_they_are,
    ) -> DataFrame:
        """``query_id, path, ordinal, digest, source`` and the text to be judged, or what
        ``prepare`` makes of it; a passage is prepared once for all its queries.

        A corpus within the limit offers every passage to every query.  Judging a whole
        corpus (``limit`` 0) is for one query at a time; a table of queries would pair
        all of them with all passages.
        """

        def offered(rows: DataFrame) -> DataFrame:
            kept = [name for name in ("text", "judged") if name in rows.columns]
            return rows.select("query_id", "path", "ordinal", *kept, "digest", "source")

        if not self.is_exhaustive(limit):
            keys = self.shortlist(queries, limit, single, max_terms)
            keys = materialize(keys.select("query_id", "path", "ordinal"), "shortlist")
            # Keys are small, judging them is not: their bytes must not decide the tasks.
            tasks = keys.sparkSession.sparkContext.defaultParallelism
            tasks = max(tasks, -(-keys.count() // PAIRS_PER_TASK))
            return offered(self.fetch(keys.repartition(tasks, "path", "ordinal"), prepare))
        passages = prepare(self.passages)
        if single:
            only = queries.select("query_id").first().query_id
            return offered(passages.withColumn("query_id", F.lit(only).cast("long")))
        if limit == 0:
            raise ValueError("Judging every passage needs a single query; give a shortlist size")
        # At most `limit` documents: queries meet them on their numbered places.
        places = F.sequence(F.lit(0), F.lit(max(self.document_count, 1) - 1))
        asked = queries.select("query_id", F.explode(places).alias("place"))
        numbered = L.numbered_paths(self.documents, limit)
        return offered(asked.join(numbered, "place").join(passages, "path"))


def _statistics(frequencies: DataFrame) -> Row:
    """Counts of a scanned corpus; a repeated path fails, as it does in an index."""
    per_document = frequencies.groupBy("path").agg(
        F.count("*").alias("passages"),
        F.sum("dl").alias("tokens"),
        F.count_if(F.col("ordinal") == 0).alias("copies"),
    )
    path = P.unique_path(F.col("path"), F.col("copies"))
    return per_document.select("passages", "tokens", path.alias("path")).agg(
        F.coalesce(F.sum("passages"), F.lit(0)).alias("passages"),
        F.count("path").alias("documents"),
        (F.sum("tokens") / F.sum("passages")).alias("mean_length"),
    ).first()


def scan(
    documents: DataFrame,
    query: str,
    chunk_chars: int = P.CHUNK_CHARS,
    max_terms: int | None = MAX_QUERY_TERMS,
) -> Corpus:
    """A corpus read once for one query, without building an index.

    It refuses the documents that an index refuses.  The text is tokenized in a single pass that keeps, per passage, its length
    and the frequencies of the query's own terms.
    """
    P.check_chunk_chars(chunk_chars)
    if "source" not in documents.columns:
        documents = documents.withColumn("source", F.lit(None).cast("string"))
    documents = P.accepted(documents.select("path", "text", "source"))
    spark = documents.sparkSession
    terms = spark.range(1).select(T.query_terms(F.lit(query), max_terms).alias("terms")).first().terms
    passages = P.chunk(documents, chunk_chars)
    frequencies = materialize(L.term_frequencies(passages, terms), "frequencies")
    counts = _statistics(frequencies)
    return Corpus(
        documents=documents.select("path"),
        passages=passages,
        postings=lambda _: L.postings_of(frequencies),
        term_stats=lambda wanted: L.term_stats(L.postings_of(frequencies), wanted),
        fetch=lambda keys, prepare: prepare(P.cut_selected(documents, keys, chunk_chars)),
        texts=lambda paths: documents.join(paths, "path").select("path", "text"),
        document_count=counts.documents,
        passage_count=counts.passages,
        mean_length=counts.mean_length or 1.0,
        chunk_chars=chunk_chars,
    )
