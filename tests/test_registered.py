"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from tests.check_queries import compare

FOLDER = "/root/testdata/sf0.001"
SQL = contract.oracle_sql()
QUERIES = {
    name: query
    for name, query in contract.queries().items()
    if not name.startswith("op") and name != "pipeline"  # these have tests of their own
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_sql(spark, name):
    message, _, good = compare(spark, FOLDER, name, QUERIES[name], SQL.get(name))
    assert good, message


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(contract.queries())


def test_entry_ranks_documents(spark):
    rows = contract.entry(spark).collect()
    assert [r.rank for r in sorted(rows)] == list(range(1, 11))
