"""The registered queries: one per operator, over whole tables."""

from __future__ import annotations

from dataclasses import astuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.catalogue import tables as D
from gleaner.functions import text as T
from gleaner.operators import changes as C
from gleaner.operators import judging as J
from gleaner.operators import lexical as L
from gleaner.operators import passages as P
from gleaner.operators import query_specs as Q
from gleaner.operators import ranking as K
from gleaner.plans import search as S
from gleaner.session import new_folder
from gleaner.sources import fields as A
from gleaner.sources import files
from gleaner.sources import report
from gleaner.sources.fields import DocumentSource
from gleaner.sources.index import Index
from gleaner.sources.scores import ScoreCache


def probe(spark: SparkSession, criteria: bool = False) -> DataFrame:
    if criteria:
        return S.one_query(spark, D.PROBE, D.PROBE_YES, D.PROBE_NO)
    return S.one_query(spark, D.PROBE)


def _passages(spark, folder):
    return P.chunk(D.documents(spark, folder))


# Sources


def quarantine(spark, folder):
    """Damaged and decorated bytes of every document, decoded or refused."""
    body = (
        F.when(F.col("lang") == "fr", F.concat(F.lit("﻿"), "text"))
        .when(F.col("lang") == "de", F.replace("text", F.lit("\n"), F.lit("\r\n")))
        .when(F.col("lang") == "es", F.replace("text", F.lit("\n"), F.lit("\r")))
        .otherwise(F.col("text"))
    )
    damage = (
        F.when(F.col("toxic") == 1, F.unhex(F.lit("FF")))
        .when(F.col("quality") == 0, F.unhex(F.lit("00")))
        .otherwise(F.unhex(F.lit("")))
    )
    raw = D.labelled(spark, folder).select(
        "path",
        F.concat(F.encode(body, "UTF-8"), damage).alias("content"),
        F.lit(None).cast("string").alias("failure"),
    )
    return files.decode(raw).select("path", "reason", P.digest(F.col("text")).alias("digest"))


def field_union(spark, folder):
    return A.field_values(D.field_tables(spark, folder), D.FIELDS, D.KEYS)


def record_keys(spark, folder):
    turns = D.table(spark, folder, "conversations")
    keyed = A.with_key(turns, ["text"], ["turn", "conv_id"], strict=True)
    return keyed.select("key", P.digest(F.col("text")).alias("digest"))


def key_fallback(spark, folder):
    """Documents keyed by their label's id, which unlabelled ones lack."""
    labels = D.table(spark, folder, "labels").select("doc_id", F.col("doc_id").alias("label"))
    rows = D.table(spark, folder, "documents").join(labels, "doc_id", "left")
    keyed = A.with_key(rows.select("label", "text"), ["text"], ["label"])
    return keyed.select("key", P.digest(F.col("text")).alias("digest"))


def synthetic_keys(spark, folder):
    view = D.table(spark, folder, "documents").select("lang", "text")
    keyed = A.with_key(view, ["lang", "text"], [])
    return keyed.select("key", "lang", P.digest(F.col("text")).alias("digest"))


def binary_key_hex(spark, folder):
    rows = D.table(spark, folder, "customer").select(
        F.encode("c_name", "UTF-8").alias("id"), "c_mktsegment"
    )
    return A.with_key(rows, ["c_mktsegment"], ["id"], strict=True)


def locators(spark, folder):
    pages = {"web pages": D.table(spark, folder, "pages")}
    values = A.field_values(pages, ["web pages.html"], {"web pages": ["url", "page_id"]})
    return A.records(values).select("path", "source", P.digest(F.col("text")).alias("digest"))


def report_tsv(spark, folder):
    return report.report_tsv(results_with_text(spark, folder))


def report_json(spark, folder):
    corpus, asked = D.corpus(spark, folder), probe(spark, criteria=True)
    cache = ScoreCache(spark, new_folder(spark, "scores"))
    found = S.search(corpus, asked, D.TOP, cache=cache, single=True)
    stats = {"documents": corpus.document_count, "scored": found.effort.judged}
    name = J.TOKEN_OVERLAP.name
    return report.report_json(found.results, asked, "documents", name, found.exhaustive, stats)


# Passages and text


def chunk_passages(spark, folder):
    return _passages(spark, folder).select("path", "ordinal", "text")


def passage_digests(spark, folder):
    return _passages(spark, folder).select("path", "ordinal", "digest")


def value_digests(spark, folder):
    values = field_union(spark, folder)
    return values.select("table", "field", "key", P.digest(F.col("value")).alias("digest"))


def skip_reasons(spark, folder):
    value = F.when(F.col("quality") == 0, F.lit(None)).when(
        F.col("toxic") == 1, F.concat("text", F.lit("\x00"))
    ).otherwise(F.col("text"))
    rows = D.labelled(spark, folder).select(value.alias("text"))
    reason = F.coalesce(P.skip_reason(F.col("text")), F.lit("indexed"))
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def token_counts(spark, folder):
    return L.postings(_passages(spark, folder))


def query_terms(spark, folder):
    terms = T.query_terms(F.col("query"))
    return D.benchmark_queries(spark, folder).select(
        "query_id", F.array_join(terms, " ").alias("terms"), F.size(terms).alias("n_terms")
    )


def state_text(spark, folder):
    """Files and table cells side by side."""
    cells = A.records(A.field_values(D.field_tables(spark, folder), ["part.p_name"], D.KEYS))
    both = D.documents(spark, folder).unionByName(cells)
    return J.with_state(P.chunk(both)).select("path", "ordinal", "state")


def oversized_states(spark, folder):
    """Whole documents as single passages, against the size of one request."""
    whole = D.documents(spark, folder).withColumn("ordinal", F.lit(0))
    judged = J.with_state(whole.withColumn("query", F.lit(D.PROBE)))
    return J.oversized_states(judged).select("path", "state_bytes")


def query_specs(spark, folder):
    return Q.query_specs(D.specs(spark, folder, "plain"))


def query_specs_json(spark, folder):
    return Q.query_specs(D.specs(spark, folder, "json"))


def effective_criteria(spark, folder):
    parsed = Q.query_specs(D.specs(spark, folder, "plain")).where("error IS NULL")
    return J.effective_criteria(parsed).select("query_id", "query", "yes", "no")


def _judged(spark, folder, criteria=True):
    offered = _passages(spark, folder).withColumn("query_id", F.lit(0).cast("long"))
    return S.judgements(offered, probe(spark, criteria))


def _keyed(spark, folder):
    return J.with_keys(_judged(spark, folder))


def score_keys(spark, folder):
    return _keyed(spark, folder).select("path", "ordinal", "key")


# Changes


def snapshot_diff(spark, folder):
    """Two manifests stored in the same buckets of their paths, compared where they lie."""
    states = [D.documents(spark, folder), D.takedown(spark, folder)]
    stored = [
        C.store_manifest(D.manifest(rows), new_folder(spark, "manifest"), D.MANIFEST_BUCKETS) for rows in states
    ]
    return C.snapshot_diff(*stored)


def removed_docs(spark, folder):
    return C.removed_docs(
        D.documents(spark, folder).select("path"), D.takedown(spark, folder)
    )


def cascade_keep(spark, folder):
    kept = C.cascade_keep(_passages(spark, folder), D.takedown(spark, folder))
    return kept.select("path", "ordinal", "digest")


def refresh_stats(spark, folder):
    return C.refresh_counts(snapshot_diff(spark, folder))


def refresh_cycle(spark, folder):
    """One source, refreshed four times: built, unchanged, changed, and rebuilt."""
    state = [D.damaged(spark, folder)]
    source = DocumentSource(lambda: state[-1], "documents")
    index = Index(spark, new_folder(spark, "index-cycle"))
    done = [index.refresh(source), index.refresh(source)]
    state.append(D.damaged_takedown(spark, folder))
    done += [index.refresh(source), index.refresh(source, rebuild=True)]
    counters = ("documents", "passages", "updated", "skipped", "removed")
    rows = [(step, *astuple(counted)) for step, counted in enumerate(done, 1)]
    return spark.createDataFrame(rows, "step int, " + ", ".join(f"{name} long" for name in counters))


def compacted_cycle(spark, folder):
    """A search after a refresh that wrote the slots of changed documents again."""
    state = [D.damaged(spark, folder)]
    source = DocumentSource(lambda: state[-1], "documents")
    index = Index(spark, new_folder(spark, "index-changed"))
    index.refresh(source)
    state.append(D.damaged_takedown(spark, folder))
    index.refresh(source)
    found = S.search(index.corpus(), probe(spark), D.TOP, single=True).results
    return found.select("rank", "path", "score", "passage")


def scan_agrees(spark, folder):
    """Damaged documents searched through an index and without one."""
    damaged = D.damaged(spark, folder)
    index = Index(spark, new_folder(spark, "index-damaged"))
    index.refresh(DocumentSource(damaged, "damaged"))
    stored = S.search(index.corpus(), probe(spark), D.TOP, single=True).results
    scanned = S.search_documents(damaged, D.PROBE, D.TOP)
    columns = ["rank", "path", "score", "passage"]
    return stored.select(F.lit("stored").alias("way"), *columns).unionByName(
        scanned.select(F.lit("scanned").alias("way"), *columns)
    )


def terms_left_out(spark, folder):
    """How many terms of each benchmark text a limit of eight leaves out."""
    return L.terms_left_out(D.benchmark_queries(spark, folder), 8)


# Lexical retrieval, on the stored index


def term_df(spark, folder):
    terms = L.explode_terms(D.benchmark_queries(spark, folder))
    return D.document_index(spark, folder).term_df(terms.select("term"))


def corpus_stats(spark, folder):
    lengths = L.term_frequencies(_passages(spark, folder), [])
    return L.corpus_stats(lengths).select("n", F.round("avgdl", 6).alias("avgdl"))


def _matches(spark, folder):
    corpus, terms = D.corpus(spark, folder), L.explode_terms(probe(spark))
    found = corpus.postings([row.term for row in terms.collect()])
    weights = L.term_weights(L.term_df(found, terms), terms, F.lit(corpus.passage_count))
    return corpus, L.term_matches(found, weights)


def term_matches(spark, folder):
    _, matches = _matches(spark, folder)
    return matches.select(
        "query_id", "term", "path", "ordinal", "tf_path", "tf_text", "dl",
        F.round("idf", 6).alias("idf"),
    )


def bm25_scores(spark, folder):
    corpus, matches = _matches(spark, folder)
    return L.bm25_scores(matches, F.lit(corpus.mean_length))


def best_passage(spark, folder):
    return L.best_passage(bm25_scores(spark, folder))


def bm25_shortlist(spark, folder):
    return L.lexical_shortlist(best_passage(spark, folder), 100)


def shortlist(spark, folder):
    return D.corpus(spark, folder).shortlist(probe(spark), D.SHORTLIST, single=True)


def shortlist_fill(spark, folder):
    return shortlist(spark, folder).where("tier = 1").select("query_id", "path", "ordinal")


def lexical_reach(spark, folder):
    asked = D.benchmark_queries(spark, folder).unionByName(
        probe(spark).withColumn("query_id", F.lit(-1).cast("long"))
    )
    return L.lexical_reach(D.corpus(spark, folder).shortlist(asked, D.SHORTLIST))


def candidates(spark, folder):
    found = D.corpus(spark, folder).candidates(probe(spark), D.SHORTLIST, single=True)
    return found.select("query_id", "path", "ordinal", "digest")


def exhaustive_candidates(spark, folder):
    found = D.corpus(spark, folder).candidates(probe(spark), 0, single=True)
    return found.select("query_id", "path", "ordinal", "digest")


def index_counts(spark, folder):
    documents = D.document_index(spark, folder).documents()
    return documents.agg(
        F.count("*").alias("documents"), F.sum("passages").alias("passages")
    )


def first_passages(spark, folder):
    first = P.first_passages(D.document_index(spark, folder).passages())
    return first.select("path", "digest")


def passages_with_source(spark, folder):
    files_too = D.document_index(spark, folder).passages()
    both = D.field_index(spark, folder).passages().unionByName(files_too)
    return both.select("path", "ordinal", "digest", "source")


# Judging and ranking


def cache_lookup(spark, folder):
    """Judgements of labelled documents are known, the others are not."""
    keyed = _keyed(spark, folder)
    known = D.labelled(spark, folder).where("quality IS NOT NULL").select(
        "path", ((F.col("quality") + F.col("toxic")) / 2).alias("score")
    )
    stored = keyed.select("path", "key").join(known, "path")
    return J.cache_lookup(keyed, stored).select(
        "path", "ordinal", "score", F.col("score").isNull().alias("missing")
    )


def cache_merge(spark, folder):
    """Stored scores of labelled passages, and fresh ones that replace some."""
    rows = _keyed(spark, folder).select("path", "key").join(D.labelled(spark, folder), "path")
    stored = rows.where("quality IS NOT NULL").withColumn("score", F.col("quality") / 2)
    fresh = rows.where("toxic = 1 OR quality IS NULL").withColumn("score", F.lit(1.0))
    return J.cache_merge(stored, fresh)


def ranking_stats(spark, folder):
    """A first search asks the scorer, a second one only the cache."""
    corpus, asked = D.corpus(spark, folder), probe(spark)
    cache = ScoreCache(spark, new_folder(spark, "scores"))
    rows = []
    for run in (1, 2):
        effort = S.search(corpus, asked, D.TOP, D.SHORTLIST, cache=cache, single=True).effort
        rows.append((run, *astuple(effort)))
    counters = ("scored", "cache_hits", "scorer_calls", "input_tokens", "output_tokens")
    return spark.createDataFrame(rows, "run int, " + ", ".join(f"{name} long" for name in counters))


def _sized(batch):
    """A scorer that bills every code point it reads and one for its answer."""
    sizes = batch["state"].str.len()
    return batch.assign(score=sizes % 11 / 10, input_tokens=sizes, output_tokens=1)


def scorer_usage(spark, folder):
    """What judging every passage took, as reported by the scorer: first without, then
    with the judgements of the first run."""
    corpus, asked = D.corpus(spark, folder), probe(spark)
    cache, scorer = ScoreCache(spark, new_folder(spark, "scores")), J.BatchScorer("sized", "1", lambda: _sized)
    rows = []
    for run in (1, 2):
        found = S.search(corpus, asked, D.TOP, 0, scorer, cache, single=True, batch_rows=50_000)
        rows.append((run, *astuple(found.effort)))
    counters = ("judged", "known", "asked", "input_tokens", "output_tokens")
    return spark.createDataFrame(rows, "run int, " + ", ".join(f"{name} long" for name in counters))


def max_passage_score(spark, folder):
    scored = S.score(_judged(spark, folder), J.TOKEN_OVERLAP)
    return K.max_passage_score(scored).select("path", "score", "passage")


def top_k(spark, folder):
    scored = S.score(_judged(spark, folder, criteria=False), J.TOKEN_OVERLAP)
    return K.top_k(K.max_passage_score(scored), 25, single=True).select("path", "score", "passage")


def ranked_results(spark, folder):
    scored = S.score(_judged(spark, folder), J.TOKEN_OVERLAP)
    return K.top_k(K.max_passage_score(scored), 50, single=True).select("rank", "path", "score")


def label_separation(spark, folder):
    """The same query with and without criteria, over all labelled documents."""
    labels = D.labelled(spark, folder).where("quality IS NOT NULL")
    labels = labels.select("path", (F.col("quality") == 1).alias("wanted"))
    both = probe(spark).unionByName(
        probe(spark, criteria=True).withColumn("query_id", F.lit(1).cast("long"))
    )
    everyone = F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>"))
    offered = _passages(spark, folder).withColumn("query_id", everyone)
    scored = S.score(S.judgements(offered, both), J.TOKEN_OVERLAP)
    return K.label_separation(K.max_passage_score(scored), labels)


def rerank(spark, folder):
    asked = probe(spark, criteria=True)
    offered = D.corpus(spark, folder).candidates(asked, D.SHORTLIST, single=True)
    results = S.rerank(offered, asked, D.TOP, single=True).results
    return results.select("rank", "path", "score", "passage")


def search_documents(spark, folder):
    """One query over raw documents, without an index."""
    results = S.search_documents(D.documents(spark, folder), D.PROBE, D.TOP)
    return results.select("rank", "path", "score", "passage")


def search_index(spark, folder):
    """The same query over the stored index."""
    found = S.search(D.corpus(spark, folder), probe(spark), D.TOP, single=True)
    return found.results.select("rank", "path", "score", "passage")


def search_fields(spark, folder):
    """One ranking over fields of six tables."""
    corpus = D.field_index(spark, folder).corpus()
    found = S.search(corpus, probe(spark), D.TOP, D.SHORTLIST, single=True)
    return found.results.select("rank", "path", "score", "passage", "source")


def batch_search(spark, folder):
    """Every benchmark text as a query, in one job."""
    asked = D.benchmark_queries(spark, folder)
    results = S.search(D.corpus(spark, folder), asked, D.TOP, D.SHORTLIST).results
    return results.select("query_id", "rank", "path", "score", "passage")


def document_text(spark, folder):
    return P.rebuild(D.document_index(spark, folder).passages())


def results_with_text(spark, folder):
    corpus = D.corpus(spark, folder)
    found = S.search(corpus, probe(spark), D.TOP, single=True)
    shown = S.with_text(found.results, corpus)
    return shown.select("query_id", "rank", "path", "score", "text")


REGISTERED = (
    quarantine, field_union, record_keys, key_fallback, synthetic_keys, binary_key_hex,
    locators, report_tsv, report_json,
    chunk_passages, passage_digests, value_digests, skip_reasons, token_counts, query_terms,
    state_text, oversized_states, query_specs, query_specs_json, effective_criteria, score_keys,
    snapshot_diff, removed_docs, cascade_keep, refresh_stats, refresh_cycle,
    compacted_cycle, scan_agrees, terms_left_out,
    term_df, corpus_stats, term_matches, bm25_scores, best_passage, bm25_shortlist, shortlist,
    shortlist_fill, lexical_reach, candidates, exhaustive_candidates, index_counts,
    first_passages, passages_with_source,
    cache_lookup, cache_merge, ranking_stats, scorer_usage, max_passage_score, top_k, ranked_results,
    label_separation, rerank, search_documents, search_index, search_fields, batch_search,
    document_text, results_with_text,
)


def queries():
    return {query.__name__: query for query in REGISTERED}
