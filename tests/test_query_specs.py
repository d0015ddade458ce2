from __future__ import annotations

import pytest

from gleaner.catalogue.specs import JSON, TEXT, json_cases, plain_cases
from gleaner.operators import judging as J
from gleaner.operators import query_specs as Q
from gleaner.plans import search as S

ABOUT = 'tide "tables" for pilots'
AS_JSON = '"tide \\"tables\\" for pilots"'
CASES = plain_cases() + json_cases()


def written(pieces):
    return "".join({TEXT: ABOUT, JSON: AS_JSON}.get(piece, piece) for piece in pieces)


@pytest.fixture(scope="module")
def parsed(spark):
    specs = [(i, written(case.spec)) for i, case in enumerate(CASES)]
    specs += [(-1, "m" * 8192), (-2, "m" * 8193)]
    frame = spark.createDataFrame(specs, "query_id long, spec string")
    return {row.query_id: row for row in Q.query_specs(frame).collect()}


def test_every_form_gives_its_parts_or_its_reason(parsed):
    for number, case in enumerate(CASES):
        row, query = parsed[number], ABOUT if case.query == TEXT else case.query
        assert (row.query, row.yes, row.no, row.error) == (query, case.yes, case.no, case.error), case


def test_the_product_covers_every_reason(parsed):
    assert len({case.error for case in CASES}) == 10


def test_the_size_limit_counts_bytes(parsed):
    assert parsed[-1].error is None and "8192" in parsed[-2].error


def test_one_specification_becomes_a_query_table(spark):
    row = S.read_query(spark, "lighthouses|no:lamps|yes:towers").first()
    assert (row.query, row.yes, row.no) == ("lighthouses", "towers", "lamps")
    with pytest.raises(ValueError, match="blank"):
        S.read_query(spark, "\n")


def test_defaults_give_way_only_to_a_whole_pair(spark):
    rows = [(1, "a", None, None), (2, "b", "in", "out")]
    frame = spark.createDataFrame(rows, "query_id long, query string, yes string, no string")
    found = {r.query_id: (r.yes, r.no) for r in J.effective_criteria(frame).collect()}
    assert found == {1: (J.DEFAULT_YES, J.DEFAULT_NO), 2: ("in", "out")}


@pytest.mark.parametrize("k, asked, used", [(1, None, 500), (51, None, 510), (3, 0, 0), (3, 3, 3)])
def test_shortlist_sizes(k, asked, used):
    assert S.check_limits(k, asked) == used


@pytest.mark.parametrize("k, asked", [(0, None), (-1, 9), (3, 2), (3, -3)])
def test_impossible_sizes_are_refused(k, asked):
    with pytest.raises(ValueError):
        S.check_limits(k, asked)
