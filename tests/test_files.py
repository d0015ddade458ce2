"""A tree of files as the source of an index."""

from __future__ import annotations

import os

import pytest
from pyarrow import fs as arrow_fs
from pyspark.sql import functions as F

from gleaner.plans import search as S
from gleaner.sources import files
from gleaner.sources.index import Index


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "library"
    (root / "shelf" / "box").mkdir(parents=True)
    return root


@pytest.fixture
def index(spark, tmp_path):
    return Index(spark, str(tmp_path / "index"), 256)


def texts(spark, root):
    source = files.FileSource(spark, str(root))
    rows = source.read(source.listing(), None).collect()
    return {r.path: r.text if r.reason is None else r.reason for r in rows}


def test_visible_regular_files_at_any_depth_are_documents(spark, tree):
    names = ["_notes", "shelf/ü b.md", "shelf/box/c", "shelf/box/empty"]
    for name in names:
        (tree / name).write_text("" if name.endswith("empty") else name)
    (tree / ".git").mkdir()
    for name in (".git/config", "shelf/.draft"):
        (tree / name).write_text("hidden")
    (tree / "alias").symlink_to(tree / "_notes")
    (tree / "again").symlink_to(tree / "shelf")
    assert texts(spark, tree) == {n: "" if n.endswith("empty") else n for n in names}


@pytest.mark.parametrize(
    "content, result",
    [
        (b"\xef\xbb\xbfsm\xc3\xb8rrebr\xc3\xb8d", "smørrebrød"),
        (b"one\r\n\rtwo\r", "one\n\ntwo\n"),
        (b"ab\x00", "holds a NUL byte"),
        (b"ok \xc3", "not valid UTF-8"),
    ],
)
def test_decoding(spark, tree, content, result):
    (tree / "file").write_bytes(content)
    assert texts(spark, tree) == {"file": result}


def test_one_kept_source_sees_every_change(spark, index, tree):
    source = files.FileSource(spark, str(tree))

    def counters(**options):
        done = index.refresh(source, **options)
        return done.documents, done.updated, done.skipped, done.removed

    assert counters() == (0, 0, 0, 0)
    for name in "abc":
        (tree / name).write_text(f"harbour {name}")
    assert counters() == (3, 3, 0, 0)
    (tree / "a").write_text("harbour master")  # longer, so its stamp differs
    (tree / "b").write_bytes(b"\x00")
    (tree / "c").unlink()
    (tree / "shelf" / "d").write_text("quay")
    assert counters() == (2, 2, 1, 2)
    assert [r.path for r in index.skipped().collect()] == ["b"]
    assert sorted(r.path for r in index.documents().collect()) == ["a", "shelf/d"]
    assert counters(rebuild=True) == (2, 2, 1, 0)


def test_the_stamp_decides_what_is_read(spark, index, tree):
    file = tree / "ledger"
    file.write_text("1234")
    source = files.FileSource(spark, str(tree))
    index.refresh(source)
    stamp = file.stat()
    file.write_text("4321")
    os.utime(file, ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    assert index.refresh(source).updated == 0
    assert [r.text for r in index.passages().collect()] == ["1234"]


def test_a_late_passage_of_a_file_is_found_and_shown(spark, index, tree):
    body = "".join(f"entry {i}: barley, hops\n" for i in range(40)) + "saffron"
    (tree / "shelf" / "ledger").write_text(body)
    (tree / "other").write_text("barley")
    index.refresh(files.FileSource(spark, str(tree)))
    corpus = index.corpus()
    found = S.search(corpus, S.one_query(spark, "saffron"), 1, single=True)
    row = S.with_text(found.results, corpus).first()
    assert found.exhaustive and row.path == "shelf/ledger" and row.passage > 0 and row.text == body


def test_a_large_directory_is_dealt_over_tasks_by_name(spark, tree):
    for i in range(100_000):
        os.close(os.open(tree / "shelf" / f"{i:06}", os.O_CREAT | os.O_WRONLY))
    (tree / "shelf" / "box" / "last").write_text("12345")
    listing = files.FileSource(spark, str(tree)).listing()
    parts = listing.groupBy(F.input_file_name().alias("part")).agg(
        F.count("*").alias("n"), F.min("path").alias("low"), F.max("path").alias("high")
    )
    parts = parts.orderBy("low").collect()
    assert sum(p.n for p in parts) == 100_001 and len(parts) > 4
    assert max(p.n for p in parts) < 2 * files.FILES_PER_TASK
    assert all(before.high < after.low for before, after in zip(parts, parts[1:]))
    assert [(r.path, r.length) for r in listing.where("length > 0").collect()] == [("shelf/box/last", 5)]


def test_a_file_that_goes_during_the_listing_is_left_out(spark, tree):
    (tree / "stays").write_text("x")
    names = spark.createDataFrame([(str(tree / "stays"),), (str(tree / "gone"),)], "full string")
    found = files._with_sizes(names, files.arrow_fs.LocalFileSystem).collect()
    assert [(r.full, r.length) for r in found] == [(str(tree / "stays"), 1)]


def test_other_file_systems_send_sizes_with_the_names(spark, tree):
    for name in ("_notes", "shelf/a", "shelf/.draft", "shelf/box/b"):
        (tree / name).write_text(name)
    root = str(tree)
    source = files.FileSource(spark, "", lambda: arrow_fs.SubTreeFileSystem(root, arrow_fs.LocalFileSystem()))
    found = {r.path: r.length for r in source.listing().collect()}
    assert found == {"_notes": 6, "shelf/a": 7, "shelf/box/b": 11}


def test_a_missing_root_fails(spark, tmp_path):
    with pytest.raises(Exception, match="absent"):
        files.FileSource(spark, str(tmp_path / "absent")).listing()
