"""Written queries in every combination of form, presence, blankness and type.

The cases and what they should give follow from the grammar, so the Spark table, the
SQL and the tests all derive from this one product.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

TEXT, JSON = "\x00text", "\x00json"  # places for a text, plain and as a JSON string
ORPHAN = "a section must start with 'yes:' or 'no:'; use JSON"
REPEATED = "more than one 'yes:' or 'no:' section"
BLANK_QUERY, BLANK_PART = "the query must not be blank", "a criterion must not be blank"
ONE_PART, EXTRA = "needs both 'yes' and 'no'", "unknown field"
NO_QUERY, NOT_TEXT, BROKEN = "no 'query' field", "every field must be a string", "not valid JSON"


@dataclass(frozen=True)
class Case:
    """A specification as pieces, and its parts or the reason it is refused."""

    spec: tuple[str, ...]
    query: str | None = None
    yes: str | None = None
    no: str | None = None
    error: str | None = None


def _judged(spec: tuple[str, ...], query: str, yes: str | None, no: str | None) -> Case:
    """What a well-formed specification with these stripped parts gives."""
    if query == "":
        return Case(spec, error=BLANK_QUERY)
    if (yes is None) != (no is None):
        return Case(spec, error=ONE_PART)
    if yes == "" or no == "":
        return Case(spec, error=BLANK_PART)
    return Case(spec, query, yes, no)


def plain_cases() -> list[Case]:
    """Text alone, and sections between pipes in either order."""
    pads = ("", " ", "\t \n")
    cases = [_judged((before, TEXT, after), TEXT, None, None) for before, after in product(pads, pads)]
    cases += [Case((pad,), error=BLANK_QUERY) for pad in pads]
    values = (None, "", "market day")
    for query, yes, no, flipped, loose in product((TEXT, " "), values, values, (False, True), (False, True)):
        sections = [f"{tag}: {value}" for tag, value in (("yes", yes), ("no", no)) if value is not None]
        sections = sections[::-1] if flipped else sections
        sections += ["harbour"] if loose else []
        if not sections:
            continue
        spec = (query, *(piece for section in sections for piece in ("|", section)))
        stripped = query.strip()
        cases.append(Case(spec, error=ORPHAN) if loose else _judged(spec, stripped, yes, no))
    for tag in ("yes", "no"):
        spec = (TEXT, "|yes:sun", "|no:rain", f"|{tag}:snow")
        cases.append(Case(spec, error=REPEATED))
    return cases


def json_cases() -> list[Case]:
    """Objects with and without each field, of right and wrong types, and broken ones."""
    queries = {"absent": None, "text": JSON, "blank": '" "', "number": "7", "null": "null"}
    parts = {"absent": None, "text": '"two\\nlines "', "blank": '""', "list": "[]"}
    meaning = {"absent": None, "text": "two\nlines", "blank": ""}
    cases = []
    for query, yes, no, extra, tail in product(queries, parts, parts, (False, True), ("", ",", " end")):
        fields = [("query", queries[query]), ("yes", parts[yes]), ("no", parts[no])]
        fields += [("other", '"x"')] if extra else []
        written: list[str] = []
        for name, value in fields:
            if value is not None:
                written += [", " if written else "", f'"{name}": ', value]
        spec = ("{", *written, "}", tail)
        if tail:
            cases.append(Case(spec, error=BROKEN))
        elif extra:
            cases.append(Case(spec, error=EXTRA))
        elif query == "absent":
            cases.append(Case(spec, error=NO_QUERY))
        elif query in ("number", "null") or "list" in (yes, no):
            cases.append(Case(spec, error=NOT_TEXT))
        else:
            cases.append(_judged(spec, TEXT if query == "text" else "", meaning[yes], meaning[no]))
    cases.append(Case(("{", '"query": ', JSON), error=BROKEN))
    return cases
