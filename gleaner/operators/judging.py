"""Judging passages: what a scorer sees, cache keys and score validity.

Judgements carry ``query_id, query, yes, no, path, ordinal, text, digest,
source``: one row per query and candidate passage.  Passages that come from an index
have their token runs stored with them.  A scorer that rests on tokens alone turns the
runs into counted terms once a passage, before it meets its queries, and such judgements
carry ``judged`` instead of the text: no text is copied, tokenized or measured per query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from gleaner.fixed import STATE_LIMIT
from gleaner.functions import relevance as R
from gleaner.functions import text as T
from gleaner.operators import lexical as L

TOKENS = ("input_tokens", "output_tokens")
KEPT = ("query_id", "path", "ordinal", "source", "key", "namespace")
DEFAULT_YES = "The text is about what the query asks for, even in other words."
DEFAULT_NO = "The text is about something else, even if it shares words with the query."


@dataclass(frozen=True)
class ColumnScorer:
    """A scorer written as one Column expression; it stays inside the JVM.

    ``stored`` is the same judgement from the distinct terms of the query and its
    criteria and from ``judged``, for a scorer that needs only tokens.
    """

    name: str
    version: str
    expression: Callable[[Column, Column, Column, Column], Column]
    stored: Callable[[Column, Column, Column, Column], Column] | None = None

    def prepare(self, passages: DataFrame) -> DataFrame:
        """Count the terms of every passage, where its token runs are stored."""
        return counted_passages(passages) if self.stored and "runs" in passages.columns else passages

    def score(self, judgements: DataFrame, spread: bool = False) -> DataFrame:
        if self.stored and "judged" in judgements.columns:
            value = self.stored(*(F.col(f"asked.{c}") for c in ("query", "yes", "no")), F.col("judged"))
        else:
            value = self.expression(*(F.col(c) for c in ("query", "yes", "no", "state")))
        return judgements.withColumns(
            {"score": value.cast("double")} | {name: F.lit(0).cast("long") for name in TOKENS}
        )


@dataclass(frozen=True)
class BatchScorer:
    """A scorer called on pandas batches, for models and remote judges.

    ``open`` runs once per task and returns the function that scores a batch of
    ``query, yes, no, state`` into ``score`` and, if it likes, ``input_tokens`` and
    ``output_tokens``.  Only those four columns and the ``KEPT`` ones reach Python.
    ``parallelism`` bounds how many tasks call it at the same time.
    """

    name: str
    version: str
    open: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]
    parallelism: int = 16

    def prepare(self, passages: DataFrame) -> DataFrame:
        return passages

    def score(self, judgements: DataFrame, spread: bool = False) -> DataFrame:
        """``spread`` rows lie in many files: their tasks are only kept to ``parallelism``."""
        seen = ["query", "yes", "no", "state"]
        kept = [name for name in KEPT if name in judgements.columns]
        sent = judgements.select(*kept, *seen)
        fields = [field for field in sent.schema.fields if field.name in kept]
        schema = StructType(
            [*fields, StructField("score", DoubleType()), *(StructField(name, LongType()) for name in TOKENS)]
        )
        opener = self.open

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            judge = opener()
            for batch in batches:
                if batch.empty:
                    continue
                reply = judge(batch[seen])
                used = {name: reply[name].to_numpy() if name in reply else 0 for name in TOKENS}
                yield batch[kept].assign(score=reply["score"].to_numpy(), **used)

        dealt = sent.coalesce(self.parallelism) if spread else sent.repartition(self.parallelism)
        return dealt.mapInPandas(run, schema)


def _is_default(yes: Column, no: Column) -> Column:
    """With the default criteria the judgement rests on the query alone."""
    return (yes == DEFAULT_YES) & (no == DEFAULT_NO)


def _overlap_judgement(query: Column, yes: Column, no: Column, state: Column) -> Column:
    default = _is_default(yes, no)
    return R.lexical_judgement(
        query,
        F.when(~default, yes),
        F.when(~default, no),
        state,
    )


TOKEN_OVERLAP = ColumnScorer("token-overlap", "1", _overlap_judgement, R.stored_judgement)


def asked_terms() -> Column:
    """The distinct terms of a query and of its criteria (none for the default ones),
    and the bytes the query takes up in a request."""
    default = _is_default(F.col("yes"), F.col("no"))
    return F.struct(
        T.distinct_terms(F.col("query")).alias("query"),
        *(F.when(~default, T.distinct_terms(F.col(name))).alias(name) for name in ("yes", "no")),
        json_bytes(F.col("query")).alias("bytes"),
    )


def counted_passages(passages: DataFrame) -> DataFrame:
    """``judged`` in place of text and runs: the terms of the text a judge would see in
    groups of equal counts, its number of tokens, and its bytes in a request.

    The runs count the tokens of the whole path; a judge sees the name of a file only.
    """
    named = F.col("source").isNull()
    rows = passages.withColumns(
        {
            "path_words": F.size(T.tokens(F.col("path"))),
            "name_words": F.when(named, T.tokens(T.basename(F.col("path")))).otherwise(F.array().cast("array<string>")),
        }
    )

    def entry(run: Column) -> Column:
        term = L.run_term(run)
        in_name = F.size(F.filter("name_words", lambda word: word == term))
        return F.struct(term.alias("term"), (L.run_counts(run, term)[1] + in_name).alias("n"))

    def group(entries: Column, n: Column) -> Column:
        equal = F.filter(entries, lambda counted: counted["n"] == n)
        return F.struct(n.alias("n"), F.transform(equal, lambda counted: counted["term"]).alias("terms"))

    def groups(entries: Column) -> Column:
        counts = F.array_distinct(F.transform(entries, lambda counted: counted["n"]))
        return F.transform(counts, lambda n: group(entries, n))

    terms = F.filter(F.transform("runs", entry), lambda counted: counted["n"] > 0)
    length = F.col("dl") - F.col("path_words") + F.size("name_words")
    judged = F.struct(T.let(terms, groups).alias("groups"), length.alias("length"), json_bytes(state_text()).alias("bytes"))
    return rows.withColumn("judged", judged).drop("text", "runs", "path_words", "name_words")


def effective_criteria(queries: DataFrame) -> DataFrame:
    """A caller's yes/no pair replaces the default pair as a whole."""
    both = F.col("yes").isNotNull() & F.col("no").isNotNull()
    return queries.withColumns(
        {
            "yes": F.when(both, F.col("yes")).otherwise(DEFAULT_YES),
            "no": F.when(both, F.col("no")).otherwise(DEFAULT_NO),
        }
    )


def state_text() -> Column:
    """A file's passage follows its name; a table cell stands alone."""
    named = F.concat(T.basename(F.col("path")), F.lit("\n\n"), F.col("text"))
    return F.when(F.col("source").isNull(), named).otherwise(F.col("text"))


def json_bytes(text: Column) -> Column:
    """Size of a text as a JSON string, with its quotes."""
    return F.octet_length(F.to_json(F.array(text))) - 2


#: The same request without its two strings.
EMPTY_REQUEST = len('{"query": , "text": }')


def state_bytes() -> Column:
    """Size of ``{"query": ..., "text": ...}`` written with spaced separators."""
    return json_bytes(F.col("query")) + json_bytes(F.col("state")) + EMPTY_REQUEST


def with_state(judgements: DataFrame) -> DataFrame:
    return judgements.withColumn("state", state_text())


def oversized_states(judgements: DataFrame) -> DataFrame:
    """The judgements whose state is too large to send, with its size."""
    sized = judgements.withColumn("state_bytes", state_bytes())
    return sized.where(F.col("state_bytes") > STATE_LIMIT)


def checked_states(judgements: DataFrame) -> DataFrame:
    """Fail the job on the first oversized state; nothing is cut to fit."""
    message = F.concat(
        F.lit("Cannot judge "), F.col("path"),
        F.lit(": query and passage exceed one request; lower chunk_chars or shorten the query"),
    )
    if "judged" in judgements.columns:
        size = F.col("asked.bytes") + F.col("judged.bytes") + EMPTY_REQUEST
        failed = F.raise_error(message).cast(judgements.schema["judged"].dataType)
        return judgements.withColumn("judged", F.when(size > STATE_LIMIT, failed).otherwise(F.col("judged")))
    checked = F.when(state_bytes() > STATE_LIMIT, F.raise_error(message)).otherwise(
        F.col("state")
    )
    return judgements.withColumn("state", checked)


def checked_scores(scored: DataFrame) -> DataFrame:
    """Fail the job on a score that is missing, not finite or outside [0, 1]."""
    score = F.col("score")
    valid = score.isNotNull() & ~F.isnan(score) & score.between(0.0, 1.0)
    message = F.concat(F.lit("Scoring "), F.col("path"), F.lit(" gave an invalid score"))
    return scored.withColumn(
        "score", F.when(valid, score).otherwise(F.raise_error(message).cast("double"))
    )


def with_namespace(queries: DataFrame, name: str, version: str) -> DataFrame:
    """Add ``namespace``: the query, its criteria and the scorer as one digest."""
    asked = F.array("query", F.lit(name), F.lit(version), "yes", "no")
    return queries.withColumn("namespace", F.sha2(F.to_json(asked), 256))


def with_keys(judgements: DataFrame) -> DataFrame:
    """Add ``key``: the namespace and everything that identifies the passage."""
    judged = F.array(
        "namespace", "path", F.col("ordinal").cast("string"), "digest", "source"
    )
    return judgements.withColumn("key", F.sha2(F.to_json(judged), 256))


def cache_lookup(keyed: DataFrame, scores: DataFrame) -> DataFrame:
    """Known scores by key; ``score`` is NULL where the scorer must be asked."""
    return keyed.join(scores.select("key", "score"), "key", "left")


def cache_merge(scores: DataFrame, fresh: DataFrame) -> DataFrame:
    """One score per key; a fresh one replaces a stored one."""
    both = scores.select("key", "score", F.lit(0).alias("age")).unionByName(
        fresh.select("key", "score", F.lit(1).alias("age"))
    )
    newest = F.max_by("score", "age").alias("score")
    return both.groupBy("key").agg(newest)
