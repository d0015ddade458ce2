"""Lexical retrieval: term frequencies, corpus statistics and BM25.

Frequencies are counted inside each passage's own row, so turning passages into
postings needs no shuffle.  Scores join the (small) query terms to postings and
are summed by ``(query_id, path, ordinal)``.

Many queries at a time are answered in two passes over bounds.  A term's stored greatest
frequency and shortest passage bound what it can add to any passage.  A query's rarest
terms give a floor under the score of its last result; terms whose bounds, taken together,
stay under the floor cannot bring in a passage, so the postings of the most common words
are looked up for surviving passages only and never multiplied by all queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.fixed import MAX_QUERY_TERMS
from gleaner.functions import relevance as R
from gleaner.functions import text as T
from gleaner.operators.ranking import top_per_group
from gleaner.session import materialize

PASSAGE = ("path", "ordinal")
#: A floor comes from terms that occur in this many times the wanted number of passages.
SEED_SHARE = 4
#: Scores are rounded to six digits; a bound this far below a floor cannot reach it.
SLACK = 2e-6
# Equal tokens of the text, then of the path (marked by a slash), or of the path alone.
# Nothing that was taken has to be given back.
FIELD_RUN = r"(([^ /]++) )\1*+(?:(\2/ )\3*+)?|([^ /]++/ )\4*+"


def term_frequencies(
    passages: DataFrame, terms: Sequence[str] | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per passage: ``dl``, its token count, and ``runs`` of equal tokens.

    With ``terms`` only those are kept, which keeps the rows of a one-off scan
    small; lengths always count every token.  ``keep`` names columns to carry.
    """
    words = passages.select(
        *PASSAGE,
        *keep,
        T.tokens(F.col("path")).alias("path_words"),
        T.tokens(F.col("text")).alias("text_words"),
    )

    def wanted(column: str) -> Column:
        if terms is None:
            return F.col(column)
        return F.filter(column, lambda word: word.isin(list(terms)))

    # A slash marks the tokens of the path and sorts them behind their equals.
    marked = F.transform(wanted("path_words"), lambda word: F.concat(word, F.lit("/")))
    runs = F.regexp_extract_all(
        T.sorted_line(F.concat(wanted("text_words"), marked)), F.lit(FIELD_RUN), F.lit(0)
    )
    length = (F.size("path_words") + F.size("text_words")).alias("dl")
    return words.select(*PASSAGE, *keep, length, runs.alias("runs"))


def run_term(run: Column) -> Column:
    return F.substring_index(F.substring_index(run, " ", 1), "/", 1)


def run_counts(run: Column, term: Column) -> tuple[Column, Column]:
    """How often the term of a run stands in the path and in the text."""
    # Equal tokens have equal bytes, which need not be counted.
    in_path = F.octet_length(run) - F.octet_length(F.replace(run, F.lit("/")))
    tokens = ((F.octet_length(run) - in_path) / (F.octet_length(term) + 1)).cast("int")
    return in_path, tokens - in_path


def postings_of(frequencies: DataFrame, *keep: str) -> DataFrame:
    counted = frequencies.select(*PASSAGE, "dl", *keep, F.explode("runs").alias("run"))
    named = counted.withColumn("term", run_term(F.col("run")))
    in_path, in_text = run_counts(F.col("run"), F.col("term"))
    return named.select("term", *PASSAGE, in_path.alias("tf_path"), in_text.alias("tf_text"), "dl", *keep)


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``slot, runs, dl`` -> ``term, df, most, shortest, slot``, a row for each term
    of a slot: in how many passages it stands, and what bounds its part of a score.

    Equal runs are counted by their codes; only distinct ones are taken apart.
    """
    sums = [("df", "sum"), ("most", "max"), ("shortest", "min")]

    def added(parts: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(parts).group_by(["term", "slot"], use_threads=False).aggregate(sums)
        found = found.select(["term", *(f"{name}_{how}" for name, how in sums), "slot"])
        return found.rename_columns(["term", *(name for name, _ in sums), "slot"])

    total = None
    for batch in batches:
        slots = batch.column("slot").to_numpy()
        for slot in np.unique(slots):
            own = batch.filter(pa.array(slots == slot))
            runs = own.column("runs")
            coded = runs.flatten().dictionary_encode()
            codes, distinct = coded.indices.to_numpy(), coded.dictionary
            lengths = np.repeat(own.column("dl").to_numpy(), runs.value_lengths().to_numpy())
            shortest = np.full(len(distinct), np.iinfo(np.int32).max, np.int32)
            np.minimum.at(shortest, codes, lengths)
            # A space ends each token, and a slash before it marks one of the path.
            in_path = pc.count_substring(distinct, "/").to_numpy()
            in_text = pc.count_substring(distinct, " ").to_numpy() - in_path
            part = pa.table(
                {
                    "term": pc.replace_substring_regex(distinct, "[/ ].*", ""),
                    "df": np.bincount(codes, minlength=len(distinct)),
                    "most": R.weighted_frequency(in_path, in_text).astype(np.float64),
                    "shortest": shortest,
                    "slot": np.full(len(distinct), slot, np.int32),
                }
            )
            total = added([part] if total is None else [total, part])
    if total is not None:
        yield from total.to_batches()


def postings(passages: DataFrame, terms: Sequence[str] | None = None) -> DataFrame:
    """``term, path, ordinal, tf_path, tf_text, dl`` for every distinct term."""
    return postings_of(term_frequencies(passages, terms))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """Passage count and mean passage length, from any frame with ``dl``."""
    return lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def explode_terms(queries: DataFrame, limit: int | None = MAX_QUERY_TERMS) -> DataFrame:
    """``query_id, term``: at most ``limit`` rows per query, or all its terms."""
    terms = T.query_terms(F.col("query"), limit)
    return queries.select("query_id", F.explode(terms).alias("term"))


def terms_left_out(queries: DataFrame, limit: int | None = MAX_QUERY_TERMS) -> DataFrame:
    """``query_id, left_out``: how many distinct terms of a query the limit leaves out."""
    every = F.size(T.distinct_terms(F.col("query")))
    used = F.size(T.query_terms(F.col("query"), limit))
    return queries.select("query_id", (every - used).alias("left_out"))


def term_df(entries: DataFrame, query_terms: DataFrame) -> DataFrame:
    """How many passages hold each wanted term.

    The semi-join comes first, so only wanted terms are aggregated, and partial
    counts collapse a very common term inside each task.
    """
    wanted = query_terms.select("term").distinct()
    found = entries.join(wanted, "term", "left_semi")
    return found.groupBy("term").agg(F.count("*").alias("df"))


def term_stats(entries: DataFrame, query_terms: DataFrame) -> DataFrame:
    """``term, df, most, shortest``: frequency, and what bounds a term's part of a score."""
    found = entries.join(query_terms.select("term").distinct(), "term", "left_semi")
    weighted = R.weighted_frequency(F.col("tf_path"), F.col("tf_text"))
    return found.groupBy("term").agg(
        F.count("*").alias("df"), F.max(weighted).cast("double").alias("most"), F.min("dl").alias("shortest")
    )


def term_weights(frequencies: DataFrame, query_terms: DataFrame, passages: Column) -> DataFrame:
    """``query_id, term, idf`` of the query terms that occur at all."""
    return query_terms.join(frequencies, "term").select(
        "query_id", "term", R.idf(passages, F.col("df")).alias("idf")
    )


def term_matches(entries: DataFrame, weights: DataFrame) -> DataFrame:
    """Postings of the weighted query terms."""
    return entries.join(weights, "term")


def _part(mean_length: Column) -> Column:
    """What one posting of a weighted term adds to its passage."""
    weighted = R.weighted_frequency(F.col("tf_path"), F.col("tf_text"))
    return R.bm25_term(F.col("idf"), weighted, F.col("dl"), mean_length)


def bm25_scores(matches: DataFrame, mean_length: Column) -> DataFrame:
    """``query_id, path, ordinal, bm25`` for every passage holding a query term."""
    part = _part(mean_length)
    return matches.groupBy("query_id", *PASSAGE).agg(F.round(F.sum(part), 6).alias("bm25"))


def bounded_weights(
    stats: DataFrame, query_terms: DataFrame, passages: Column, mean_length: Column
) -> DataFrame:
    """``query_id, term, idf, before, rest`` of the query terms that occur.

    ``stats`` has each term's ``df``, greatest weighted frequency ``most`` and
    ``shortest`` passage.  Terms are taken from the one that can add most to the one that
    can add least: ``before`` is the number of postings of the terms ahead, ``rest`` what
    a term and all behind it can add together.
    """
    weight = R.idf(passages, F.col("df"))
    bound = R.bm25_term(weight, F.col("most"), F.col("shortest"), mean_length)
    own = query_terms.join(stats, "term").select("query_id", "term", "df", weight.alias("idf"), bound.alias("bound"))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "term")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    behind = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return own.select(
        "query_id", "term", "idf",
        F.coalesce(F.sum("df").over(ahead), F.lit(0)).alias("before"),
        F.sum("bound").over(behind).alias("rest"),
    )


def _partial(entries: DataFrame, weights: DataFrame, mean_length: Column) -> DataFrame:
    matches = term_matches(entries, weights.select("query_id", "term", "idf"))
    return matches.groupBy("query_id", *PASSAGE).agg(F.sum(_part(mean_length)).alias("bm25"))


def _floors(partial: DataFrame, limit: int) -> DataFrame:
    """``query_id, floor``: the ``limit``-th best document has at least this score, as it
    has it by some of its query's terms alone."""
    # The greatest number alone: it is aggregated by hashing, a struct would be sorted for.
    best = partial.groupBy("query_id", "path").agg(F.max("bm25").alias("bm25"))
    last = top_per_group(best, "query_id", [F.desc("bm25"), F.asc("path")], limit).where(F.col("rank") == limit)
    return last.select("query_id", (F.col("bm25") - SLACK).alias("floor"))


def pruned_scores(
    postings: Callable[[DataFrame], DataFrame], weights: DataFrame, mean_length: Column, limit: int
) -> DataFrame:
    """``query_id, path, ordinal, bm25`` of every passage that can be in a document among
    the ``limit`` best of its query, and of no passage that a bound rules out.

    ``postings`` gives the postings of a frame of terms; ``weights`` is a stored
    ``bounded_weights``.
    """
    seeds = weights.where(F.col("before") < SEED_SHARE * limit)
    floors = materialize(_floors(_partial(postings(seeds), seeds, mean_length), limit), "floors")
    judged = weights.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    judged = materialize(judged, "floored")
    essential, others = judged.where("rest >= floor"), judged.where("rest < floor")

    first = materialize(_partial(postings(essential), essential, mean_length), "first")
    # More terms, higher floors: what cannot reach them needs no look-up.
    more = others.groupBy("query_id").agg(F.max("rest").alias("more"))
    higher = _floors(first, limit).join(more, "query_id")
    first = first.join(higher, "query_id", "left").where("floor IS NULL OR bm25 + more >= floor")
    first = materialize(first.select("query_id", *PASSAGE, "bm25"), "survivors")
    # Common words: one look-up for each surviving passage, whatever their postings.
    probes = first.select("query_id", *PASSAGE).join(others.select("query_id", "term", "idf"), "query_id")
    found = probes.join(postings(others), ["term", *PASSAGE])
    rest = found.select("query_id", *PASSAGE, _part(mean_length).alias("bm25"))
    return first.unionByName(rest).groupBy("query_id", *PASSAGE).agg(F.round(F.sum("bm25"), 6).alias("bm25"))


def best_passage(scores: DataFrame) -> DataFrame:
    """The best passage of each document; an earlier one wins a tie."""
    best = F.max(F.struct("bm25", (-F.col("ordinal")).alias("back"))).alias("best")
    return scores.groupBy("query_id", "path").agg(best).select(
        "query_id",
        "path",
        (-F.col("best.back")).alias("ordinal"),
        F.col("best.bm25").alias("bm25"),
    )


def lexical_shortlist(best: DataFrame, limit: int, single: bool = False) -> DataFrame:
    """The ``limit`` best documents of each query, by BM25 and then path."""
    order = [F.desc("bm25"), F.asc("path")]
    return top_per_group(best, "query_id", order, limit, single).drop("rank")


def numbered_paths(documents: DataFrame, limit: int) -> DataFrame:
    """``place, path`` of the first ``limit`` documents in path order."""
    # The ordered limit already holds one partition of at most `limit` rows.
    first = documents.select("path").orderBy("path").limit(limit)
    return first.agg(F.sort_array(F.collect_list("path")).alias("paths")).select(
        F.posexplode("paths").alias("place", "path")
    )


def fill_shortlist(
    lexical: DataFrame, queries: DataFrame, documents: DataFrame, limit: int
) -> DataFrame:
    """First passages, in path order, for the places lexical matches left free.

    Of the first ``limit`` documents at most as many are already selected as
    places are taken, so looking further than those is never needed.  Queries
    meet documents on a numbered place: an equi-join of at most ``limit`` rows
    per query that still has free places.
    """
    first = numbered_paths(documents, limit)
    taken = lexical.groupBy("query_id").agg(F.count("*").alias("taken"))
    short = (
        queries.select("query_id")
        .join(taken, "query_id", "left")
        .select("query_id", (F.lit(limit) - F.coalesce("taken", F.lit(0))).alias("free"))
        .where("free > 0")
        .withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(limit - 1))))
    )
    offered = short.join(first, "place").join(
        lexical.select("query_id", "path"), ["query_id", "path"], "left_anti"
    )
    chosen = top_per_group(offered, "query_id", [F.asc("path")], limit).where("rank <= free")
    return chosen.select("query_id", "path", F.lit(0).alias("ordinal"))


def complete_shortlist(
    lexical: DataFrame, queries: DataFrame, documents: DataFrame, limit: int
) -> DataFrame:
    """Lexical matches first (tier 0), then the fill (tier 1)."""
    fill = fill_shortlist(lexical, queries, documents, limit)
    return lexical.withColumn("tier", F.lit(0)).unionByName(
        fill.withColumn("bm25", F.lit(None).cast("double")).withColumn("tier", F.lit(1))
    )


def lexical_reach(shortlist: DataFrame) -> DataFrame:
    """How much of each shortlist the query's own words reached."""
    return shortlist.groupBy("query_id").agg(
        F.count_if(F.col("tier") == 0).alias("lexical"), F.count("*").alias("shortlisted")
    )
