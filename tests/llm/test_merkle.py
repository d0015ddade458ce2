from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from gleaner.llm import merkle as M
from gleaner.llm import queries as Q
from tests.llm.conftest import FOLDER, rows_of

AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    parts = []
    for value in row:
        parts.append("-" if value is None else f"{len(str(value).encode())}:{value}")
    return sha(*parts)


def climb(nodes):
    """The root of a list of digests, and for each the runs on its way: (slot, run)."""
    paths, level, owners = [[] for _ in nodes], nodes, [[i] for i in range(len(nodes))]
    while len(level) > 1:
        above, groups = [], []
        for start in range(0, len(level), 16):
            run = level[start : start + 16]
            above.append(sha(*run))
            groups.append([i for owner in owners[start : start + 16] for i in owner])
            for slot, owner in enumerate(owners[start : start + 16]):
                for i in owner:
                    paths[i].append((slot, run))
        level, owners = above, groups
    return level[0], paths


def brute(rows, tampered):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in order:
        own = sorted(by_source[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, *climb([leaf(r) for r in own])))
    root, upper = climb([subroot for _, subroot, _ in trees])
    found = []
    for (own, subroot, paths), over in zip(trees, upper):
        for row, path in zip(own, paths):
            whole = path + over
            text = row[4]
            if tampered(row[0]) and text is not None:
                text = text.translate(AZ)
            digest = leaf((*row[:4], text))
            for slot, run in whole:
                digest = sha(*run[:slot], digest, *run[slot + 1 :])
            siblings = [d for slot, run in whole for d in run[:slot] + run[slot + 1 :]]
            found.append((row[0], leaf(row), subroot, root, sha(*siblings), digest, digest == root))
    return sorted(found, key=repr)


def touched(number):
    return number is not None and zlib.crc32(str(number).encode()) % 5 == 0


def manifest(frame):
    lowered = F.translate("text", Q.ascii_uppercase, Q.ascii_lowercase)
    found = M.manifest(frame, Q.remainder("doc_id", 5) == 0, lowered)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def rows_for(sizes):
    rows, number = [], 0
    for source, size in sizes.items():
        for i in range(size):
            rows.append((number * 7919 % 100_003, source, "en", i, f"Text {i} of É {source}"))
            number += 1
    return rows


@pytest.mark.parametrize(
    "sizes",
    [
        {"only": 1},
        {"one": 1, None: 1, "": 2},
        {"a": 16, "b": 17, "ä": 15, "Z": 256, None: 3},
        {"hot": 4200, "b": 257, "c": 300},  # four levels: the chunks of chunks too
        {f"source {i}": 1 + i % 3 for i in range(300)},  # more sources than one chunk holds
    ],
)
def test_manifest_matches_the_definition(spark, sizes):
    rows = rows_for(sizes)
    assert manifest(spark.createDataFrame(rows, SCHEMA)) == brute(rows, touched)


def test_nulls_ties_repeated_rows_and_long_texts(spark):
    rows = [
        (None, None, None, None, None), (None, None, None, None, "X"), (1, "s", "en", 1, ""), (1, "s", "en", 1, ""),
        (1, "s", "en", 2, "Other"), (1, None, None, 0, "A" * 300_000), (-5, "s", "en", 1, "Minus"),
        (8, "s", None, None, None),
    ]
    assert manifest(spark.createDataFrame(rows, SCHEMA)) == brute(rows, touched)


def test_empty_tables_and_clashing_names(spark):
    frame = spark.createDataFrame(rows_for({"a": 20, "b": 3}), SCHEMA)
    assert M.manifest(frame.where("false")).collect() == []
    wide = frame.withColumns({name: F.lit(name) for name in ("grp", "pos", "digest", "leaf", "root", "part", "size")})
    assert rows_of(M.manifest(wide)) == rows_of(M.manifest(frame))
    assert all(r.verified for r in M.manifest(frame).collect())


def test_folding_resumes_the_state_before_the_slot():
    children = [sha(str(i)) for i in range(16)]
    node = M.Node(children)
    assert node.digest == sha(*children) and len(node.states) == 16
    for slot in range(16):
        other = sha("other")
        assert node.fold(slot, other) == sha(*children[:slot], other, *children[slot + 1 :])
        assert node.fold(slot, children[slot]) == node.digest


def test_query_matches_the_definition_on_whole_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select(*M.FIELDS).collect()]
    found = Q.op12_merkle_manifest(spark, FOLDER)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, touched)
