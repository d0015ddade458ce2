"""Searches: shortlist, judge, pool and rank, for one query or a table of them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gleaner.fixed import MAX_QUERY_TERMS, MIN_SHORTLIST, SHORTLIST_PER_RESULT
from gleaner.operators import judging as J
from gleaner.operators import passages as P
from gleaner.operators import query_specs as Q
from gleaner.operators import ranking as K
from gleaner.plans.corpus import Corpus, scan
from gleaner.session import materialize, materialize_counted
from gleaner.sources.scores import ScoreCache

#: Judgements stored at a time; what a failing scorer can lose.
BATCH_ROWS = 1_000_000

Scorer = J.ColumnScorer | J.BatchScorer


@dataclass(frozen=True)
class Effort:
    """What a ranking took: passages judged in all, of them known from the cache and asked
    of the scorer, and the tokens the scorer reported."""

    judged: int = 0
    known: int = 0
    asked: int = 0
    input_tokens: int = 0
    output_tokens: int = 0


#: Called with the effort so far, each time judgements have been stored.
Progress = Callable[[Effort], None]


@dataclass(frozen=True)
class Ranking:
    """Results as ``query_id, rank, score, path, passage, source``, and their effort."""

    results: DataFrame
    effort: Effort
    exhaustive: bool = False


def shortlist_size(k: int) -> int:
    return max(MIN_SHORTLIST, SHORTLIST_PER_RESULT * k)


def check_limits(k: int, candidates: int | None) -> int:
    """The shortlist size to use; 0 judges every passage."""
    if k < 1:
        raise ValueError("k must be positive")
    if candidates is None:
        return shortlist_size(k)
    if candidates < 0 or 0 < candidates < k:
        raise ValueError("candidates must be at least k, or 0 for all")
    return candidates


def one_query(
    spark: SparkSession, query: str, yes: str | None = None, no: str | None = None
) -> DataFrame:
    """A query table of one row."""
    if (yes is None) != (no is None):
        raise ValueError("Give both yes and no, or neither")
    for name, value in (("query", query), ("yes", yes), ("no", no)):
        if value is not None and not value.strip():
            raise ValueError(f"{name} must not be blank")
    parts = {"query": query, "yes": yes, "no": no}
    texts = [F.lit(part and part.strip()).cast("string").alias(n) for n, part in parts.items()]
    return spark.range(0, 1, 1, 1).select(F.col("id").alias("query_id"), *texts)


def read_query(spark: SparkSession, spec: str) -> DataFrame:
    """A query table of one row from one written specification."""
    written = spark.range(0, 1, 1, 1).select(F.col("id").alias("query_id"), F.lit(spec).alias("spec"))
    row = Q.query_specs(written).first()
    if row.error is not None:
        raise ValueError(f"Cannot read the query: {row.error}")
    return one_query(spark, row.query, row.yes, row.no)


def asked_of(queries: DataFrame, scorer: Scorer) -> DataFrame:
    """The queries as the scorer gets them, with the namespace of their scores."""
    asked = J.effective_criteria(queries.select("query_id", "query", "yes", "no"))
    return J.with_namespace(asked, scorer.name, scorer.version)


def judgements(
    candidates: DataFrame, queries: DataFrame, scorer: Scorer = J.TOKEN_OVERLAP
) -> DataFrame:
    return _judgements(candidates, asked_of(queries, scorer))


def _judgements(candidates: DataFrame, asked: DataFrame) -> DataFrame:
    """Candidates with their queries: with the text to judge, or with counted terms."""
    if "judged" in candidates.columns:
        return candidates.join(asked.withColumn("asked", J.asked_terms()), "query_id")
    return J.with_state(candidates.join(asked, "query_id"))


def score(judged: DataFrame, scorer: Scorer, spread: bool = False) -> DataFrame:
    """``spread`` says that the rows were stored in many files and need not be dealt out."""
    return J.checked_scores(scorer.score(J.checked_states(judged), spread))


def _usage() -> dict[str, Column]:
    """Counters of a writing job: rows, and the tokens their scorer reported."""
    return {"asked": F.count("*")} | {name: F.coalesce(F.sum(name), F.lit(0)) for name in J.TOKENS}


def rerank(
    candidates: DataFrame,
    queries: DataFrame,
    k: int,
    scorer: Scorer = J.TOKEN_OVERLAP,
    cache: ScoreCache | None = None,
    batch_rows: int = BATCH_ROWS,
    single: bool = False,
    progress: Progress | None = None,
) -> Ranking:
    """Judge candidates and keep the k best documents of each query.

    Judgements are stored before anything is ranked.  With a cache only unknown ones go
    to the scorer, in writes of about ``batch_rows``, so a failing scorer loses at most
    one of them; no ranking comes out of a failed run.  Passage texts are read for the
    judgements that the scorer has to make, and only once.  The jobs that store judgements
    count them as they go, and ``progress`` gets the sums after each.
    """
    asked = asked_of(queries, scorer)
    if cache is None:
        scored = score(_judgements(candidates, asked), scorer)
        scored = scored.select("query_id", "path", "ordinal", "source", "score", *J.TOKENS)
        scored, counted = materialize_counted(scored, "scored", **_usage())
        effort = Effort(judged=counted["asked"], **counted)
        if progress:
            progress(effort)
        return Ranking(K.top_k(K.max_passage_score(scored), k, single), effort)

    # The keys need no text: digests are stored with the passages.
    keyed = J.with_keys(candidates.drop("text", "judged").join(asked, "query_id"))
    keyed = keyed.select("query_id", "path", "ordinal", "source", "key", "namespace")
    known = F.count_if(F.col("score").isNotNull())
    keyed, counted = materialize_counted(cache.lookup(keyed, asked), "keyed", judged=F.count("*"), known=known)
    effort = Effort(**counted)
    if progress:
        progress(effort)
    missing = effort.judged - effort.known
    scored = keyed
    if missing:
        run = uuid.uuid4().hex
        batches = -(-missing // batch_rows)
        dealt = F.pmod(F.xxhash64("key"), F.lit(batches)).cast("int").alias("batch")
        names = ["query_id", "path", "ordinal", "key", "namespace"]
        if effort.known:
            wanted = keyed.where("score IS NULL").select(*names, dealt)
            unknown = _judgements(candidates.join(wanted, names[:3]), asked.drop("namespace")).drop("text")
        else:
            # Nothing is known: every candidate is wanted, and no text has to meet its key.
            unknown = J.with_keys(_judgements(candidates, asked)).drop("text").withColumn("batch", dealt)
        unknown = materialize(unknown, "unknown", "batch") if batches > 1 else unknown
        for batch in range(batches):
            rows = unknown.where(F.col("batch") == batch)
            if batches > 1 and rows.isEmpty():
                continue
            seen = Observation()
            counters = [value.alias(name) for name, value in _usage().items()]
            cache.append(score(rows, scorer, batches > 1).observe(seen, *counters), run)
            more = seen.get
            effort = Effort(
                effort.judged, effort.known,
                *(getattr(effort, name) + more[name] for name in ("asked", *J.TOKENS)),
            )
            if progress:
                progress(effort)
        scored = cache.lookup(keyed.drop("score"), asked)
    return Ranking(K.top_k(K.max_passage_score(scored), k, single), effort)


def search(
    corpus: Corpus,
    queries: DataFrame,
    k: int,
    candidates: int | None = None,
    scorer: Scorer = J.TOKEN_OVERLAP,
    cache: ScoreCache | None = None,
    batch_rows: int = BATCH_ROWS,
    single: bool = False,
    max_terms: int | None = MAX_QUERY_TERMS,
    progress: Progress | None = None,
) -> Ranking:
    """Rank a corpus for every row of a query table.

    ``max_terms`` bounds the terms of a query that the shortlist uses (None: all);
    ``terms_left_out`` tells which queries have more.
    """
    limit = check_limits(k, candidates)
    offered = corpus.candidates(queries, limit, single, max_terms, scorer.prepare)
    ranking = rerank(offered, queries, k, scorer, cache, batch_rows, single, progress)
    return Ranking(ranking.results, ranking.effort, corpus.is_exhaustive(limit))


def search_documents(
    documents: DataFrame,
    query: str,
    k: int,
    yes: str | None = None,
    no: str | None = None,
    candidates: int | None = None,
    scorer: Scorer = J.TOKEN_OVERLAP,
    chunk_chars: int = P.CHUNK_CHARS,
    max_terms: int | None = MAX_QUERY_TERMS,
) -> DataFrame:
    """One query over ``documents(path, text[, source])``, without an index."""
    asked = one_query(documents.sparkSession, query, yes, no)
    corpus = scan(documents, query, chunk_chars, max_terms)
    found = search(corpus, asked, k, candidates, scorer, single=True, max_terms=max_terms)
    return found.results


def with_text(results: DataFrame, corpus: Corpus) -> DataFrame:
    """Attach the whole text of the returned documents, and of no others."""
    results = materialize(results, "results")
    return results.join(corpus.texts(results.select("path").distinct()), "path", "left")
