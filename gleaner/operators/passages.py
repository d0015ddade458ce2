"""Documents to overlapping passages and back.

``documents`` has ``path, text, source`` (``source`` is a JSON string for a table
cell and NULL for a file); ``passages`` adds ``ordinal`` and ``digest``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.fixed import CHUNK_CHARS, CHUNK_RANGE
from gleaner.functions import text as T


def check_chunk_chars(size: int) -> int:
    low, high = CHUNK_RANGE
    if not low <= size <= high:
        raise ValueError(f"chunk_chars must be between {low} and {high}")
    return size


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def skip_reason(text: Column) -> Column:
    """Why a value cannot be a document, or NULL if it can."""
    return F.when(text.isNull(), "null value").when(
        F.contains(text, F.lit("\x00")), "text holds a NUL character"
    )


def accepted(documents: DataFrame) -> DataFrame:
    """The documents that may be searched, stored or not."""
    return documents.where(skip_reason(F.col("text")).isNull())


def unique_path(path: Column, copies: Column) -> Column:
    """The path, or a failure where several documents have it."""
    message = F.concat(F.lit("More than one document has the path "), path)
    return F.when(copies > 1, F.raise_error(message).cast("string")).otherwise(path)


def chunk(documents: DataFrame, size: int = CHUNK_CHARS) -> DataFrame:
    """Cut every document into windows; a narrow, shuffle-free step."""
    kept = [name for name in documents.columns if name != "text"]
    cut = documents.select(
        *kept, F.posexplode(T.windows(F.col("text"), size)).alias("ordinal", "text")
    )
    return cut.withColumn("digest", digest(F.col("text")))


def cut_selected(
    documents: DataFrame, wanted: DataFrame, size: int = CHUNK_CHARS
) -> DataFrame:
    """Cut only the windows named by ``wanted(path, ordinal, ...)``."""
    found = documents.join(wanted, "path")
    found = found.withColumn("text", T.window_at(F.col("text"), F.col("ordinal"), size))
    return found.withColumn("digest", digest(F.col("text")))


def first_passages(passages: DataFrame) -> DataFrame:
    return passages.where(F.col("ordinal") == 0)


def rebuild(passages: DataFrame, size: int = CHUNK_CHARS) -> DataFrame:
    """Whole texts from passages, without repeating the overlaps.

    One group is one document, which was one row before it was cut.
    """
    overlap = T.overlap_for(size)
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    fresh = F.transform(
        parts,
        lambda part: F.when(part["ordinal"] == 0, part["text"]).otherwise(
            F.substring(part["text"], F.lit(overlap + 1), F.char_length(part["text"]))
        ),
    )
    return passages.groupBy("path").agg(F.array_join(fresh, "").alias("text"))
