from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from gleaner.llm import line_dedup as D
from gleaner.session import new_folder
from tests.check_queries import compare
from tests.llm.conftest import FOLDER, rows_of

SPACES = " \t\n\x0b\x0c\r"
AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, min_docs=3):
    """Cleaned texts by the definition, for (id, text) rows."""
    holders = {}
    for number, text in rows:
        for line in (text or "").split("\n") if number is not None else []:
            key = line.strip(SPACES).translate(AZ)
            if len(key) >= 20:
                holders.setdefault(key, set()).add(number)
    found = []
    for number, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            ids = holders.get(line.strip(SPACES).translate(AZ), ())
            if len(ids) < min_docs or number is None or number == max(ids):
                kept.append(line)
        found.append((number, len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept)))
    return sorted(found, key=repr)


def cleaned(frame, **options):
    found = D.dedup_lines(frame, **options)
    return sorted((tuple(r) for r in found.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def odd_rows(seed=5, count=80):
    rng = random.Random(seed)
    stock = [f"Line number {i} of the common stock" for i in range(12)] + ["short", "", "  ", "Ä" * 19, "É" * 20]
    rows = []
    for number in range(count):
        picked = [rng.choice(stock) for _ in range(rng.randrange(6))]
        picked = [rng.choice(("", " ", "\t\x0b", "\r"))[: rng.randrange(2)] + p + rng.choice(("", " \r", "\x0c")) for p in picked]
        picked = [p.upper() if rng.random() < 0.2 else p for p in picked]
        rows.append((number - 7, "\n".join(picked + [f"own line of document {number}"] * rng.randrange(3))))
    return rows


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 2), (5, 3)])
def test_lines_match_the_definition(spark, batches, fanout):
    rows = odd_rows()
    assert cleaned(frame(spark, rows), batches=batches, fanout=fanout) == brute(rows)


def test_nulls_repeated_rows_and_ties(spark):
    line = "the same line in many documents"
    rows = [
        (1, line), (1, f"{line}\n{line}"), (1, line), (2, line.upper()),  # two documents: nothing goes
        (None, line), (None, None), (3, None), (4, ""), (5, "\n"),
    ]
    assert cleaned(frame(spark, rows)) == brute(rows)
    more = [*rows, (6, f" {line}\n{line}\nend"), (6, line)]
    assert cleaned(frame(spark, more)) == brute(more)
    assert cleaned(frame(spark, more), min_docs=2) == brute(more, 2)


def test_very_long_texts_and_common_lines(spark):
    common = "a line that every second document holds"
    long = "\n".join(f"line {i} of a very long document" for i in range(60_000))
    rows = [(i, common if i % 2 else f"document {i} has a line of its own") for i in range(3000)]
    rows += [(5000, long), (5001, long + "\n" + common), (5002, long)]
    found = {row[0]: row[2] for row in cleaned(frame(spark, rows))}
    assert found[5000] == found[5001] == 60_000 and found[5002] == 0
    assert sum(found[i] for i in range(3000)) == 1500


def test_empty_tables_and_clashing_names(spark, docs, nothing, clashing):
    assert D.dedup_lines(nothing).collect() == []
    wide = clashing.withColumns({name: F.lit(1) for name in ("h", "g", "n", "last", "batch", "n_lines", "gone_id", "c1")})
    found = D.dedup_lines(wide)
    assert sorted(found.columns) == sorted([*wide.columns, "n_dropped"])
    names = ["doc_id", "text", "n_lines", "n_dropped"]
    assert rows_of(found.select(*names)) == rows_of(D.dedup_lines(docs).select(*names))


def test_full_levels_are_merged_and_settled_keys_stay_out(spark):
    runs = D.LineRuns(spark, new_folder(spark, "test-runs"), min_docs=2, fanout=2)
    for top in (40, 30, 20, 10):
        rows = [(top, 1, 1), (top, 2, top)] + [(top - 1, 1, 1)]
        runs.add(spark.createDataFrame(rows, "doc_id long, h long, g long"))
        if top == 40:
            assert [tuple(r) for r in runs.settled().collect()] == [(1, 1, 40)]
    assert list(map(len, runs.levels)) == [0, 0, 1]
    entries = spark.table(runs.levels[2][0])
    # The settled key counts its first batch only: later batches joined it away.
    assert [tuple(r) for r in entries.where("h = 1").collect()] == [(1, 1, 2, 40)]
    assert entries.count() == 5


def test_query_matches_its_sql(spark):
    name = "op11_line_dedup"
    message, _, good = compare(spark, FOLDER, name, contract.queries()[name], contract.oracle_sql()[name])
    assert good, message
