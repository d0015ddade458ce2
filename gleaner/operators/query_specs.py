"""Reading a table of written queries.

A specification is plain text, ``query | yes: ... | no: ...``, or a JSON object
with ``query`` and optionally both ``yes`` and ``no``.  Each row gets either its
parts or the reason it was refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.fixed import MAX_SPEC_BYTES, QUERY_FIELDS
from gleaner.functions import text as T


def _json_value(name: str) -> Column:
    # A missing field and a JSON null differ: only the type tells them apart.
    return F.try_variant_get("object", f"$.{name}", "string")


def _json_type(name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get("object", f"$.{name}", "variant"))


def _section(tag: str) -> Column:
    """The pipe sections carrying a tag, without it."""
    tagged = F.filter("sections", lambda part: F.startswith(part, F.lit(f"{tag}:")))
    return F.transform(tagged, lambda part: F.substring(part, len(tag) + 2, 1 << 30))


def query_specs(specs: DataFrame) -> DataFrame:
    """``query_id, spec`` to ``query_id, spec, query, yes, no, error``."""
    # Wrapped in an array, trailing text after the object is a syntax error too.
    wrapped = F.try_parse_json(F.concat(F.lit("["), F.col("trimmed"), F.lit(",0]")))
    form = (
        F.when(F.startswith("trimmed", F.lit("{")), "json")
        .when(F.contains("trimmed", F.lit("|")), "pipe")
        .otherwise("plain")
    )
    shaped = (
        specs.withColumn("trimmed", T.strip(F.col("spec")))
        .withColumn("form", form)
        .withColumn(
            "parsed", F.when(F.col("form") == "json", wrapped.cast("array<variant>"))
        )
        .withColumn(
            "object", F.when(F.size("parsed") == 2, F.try_element_at("parsed", F.lit(1)))
        )
        .withColumn(
            "names",
            F.when(F.col("object").isNotNull(), F.expr("json_object_keys(trimmed)")),
        )
        .withColumn("pieces", F.split("trimmed", r"\|", -1))
        .withColumn(
            "sections",
            F.transform(F.slice("pieces", 2, F.size("pieces")), lambda part: T.strip(part)),
        )
    )
    is_json, is_pipe = F.col("form") == "json", F.col("form") == "pipe"
    yes_parts, no_parts = _section("yes"), _section("no")
    untagged = F.size(yes_parts) + F.size(no_parts) < F.size("sections")
    unknown = F.size(F.array_except("names", F.array(*map(F.lit, QUERY_FIELDS)))) > 0
    mistyped = F.lit(False)
    for name in QUERY_FIELDS:
        present = F.array_contains("names", name)
        mistyped = mistyped | (present & ~_json_type(name).eqNullSafe(F.lit("STRING")))

    def part(name: str, plain: Column, piped: Column) -> Column:
        value = F.when(is_json, _json_value(name)).when(is_pipe, piped).otherwise(plain)
        return T.strip(value)

    missing = F.lit(None).cast("string")
    parts = shaped.select(
        "query_id",
        "spec",
        part("query", F.col("trimmed"), F.element_at("pieces", 1)).alias("query"),
        part("yes", missing, F.get(yes_parts, F.lit(0))).alias("yes"),
        part("no", missing, F.get(no_parts, F.lit(0))).alias("no"),
        F.when(F.octet_length("spec") > MAX_SPEC_BYTES, "longer than 8192 bytes")
        .when(is_json & F.col("object").isNull(), "not valid JSON")
        .when(is_json & unknown, "unknown field")
        .when(is_json & ~F.array_contains("names", "query"), "no 'query' field")
        .when(is_json & mistyped, "every field must be a string")
        .when(is_pipe & untagged, "a section must start with 'yes:' or 'no:'; use JSON")
        .when(
            is_pipe & ((F.size(yes_parts) > 1) | (F.size(no_parts) > 1)),
            "more than one 'yes:' or 'no:' section",
        )
        .alias("malformed"),
    )
    error = (
        F.when(F.col("malformed").isNotNull(), F.col("malformed"))
        .when(F.col("query") == "", "the query must not be blank")
        .when(F.col("yes").isNull() != F.col("no").isNull(), "needs both 'yes' and 'no'")
        .when((F.col("yes") == "") | (F.col("no") == ""), "a criterion must not be blank")
    )
    checked = parts.withColumn("error", error)
    accepted = [F.when(F.col("error").isNull(), F.col(name)).alias(name) for name in QUERY_FIELDS]
    return checked.select("query_id", "spec", *accepted, "error")
