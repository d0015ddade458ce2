"""Text files of a directory tree as documents.

Directories are listed and files are read inside tasks through Arrow's file
systems.  Spark's own file readers leave out empty files and names starting with
an underscore, both of which belong to a corpus, and follow symbolic links,
which do not.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import materialize

FileSystemFactory = Callable[[], arrow_fs.FileSystem]
ENTRY = "full string, is_dir boolean, length long, modified long"
ENTRY_NAMES = ["full", "is_dir", "length", "modified"]
NAMES_PER_PAGE = 10_000
FILES_PER_TASK = 20_000
READ_BYTES_PER_TASK = 128 << 20
READ_BYTES_PER_BATCH = 64 << 20
BOM = "EFBBBF"


def _resolve(root: str, filesystem: FileSystemFactory | None) -> tuple[FileSystemFactory, str]:
    if filesystem is not None:
        return filesystem, root.rstrip("/")
    _, base = arrow_fs.FileSystem.from_uri(root)
    return (lambda: arrow_fs.FileSystem.from_uri(root)[0]), base.rstrip("/")


def _named(store: arrow_fs.FileSystem, folder: str) -> Iterator[tuple]:
    """Visible directories and regular files of one directory, as they are met.

    A local directory is streamed and gives names and kinds only; other systems send
    sizes and times along with the names.
    """
    if isinstance(store, arrow_fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for entry in found:
                if entry.name.startswith(".") or entry.is_symlink():
                    continue
                is_dir = entry.is_dir(follow_symlinks=False)
                if is_dir or entry.is_file(follow_symlinks=False):
                    yield entry.path, is_dir, None, None
        return
    for entry in store.get_file_info(arrow_fs.FileSelector(folder)):
        is_dir = entry.type == arrow_fs.FileType.Directory
        if not entry.base_name.startswith(".") and (is_dir or entry.type == arrow_fs.FileType.File):
            yield entry.path, is_dir, entry.size or 0, entry.mtime_ns or 0


def _with_sizes(names: DataFrame, open_fs: FileSystemFactory) -> DataFrame:
    """Sizes and times of named files, each task asking for one range of names.

    So the files of one large directory are dealt over many tasks, and neighbours in it
    are asked for together.  A file that is gone by then is left out.
    """

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = open_fs()
        for batch in batches:
            infos = store.get_file_info(batch["full"].tolist())
            rows = [(i.path, False, i.size or 0, i.mtime_ns or 0) for i in infos if i.type == arrow_fs.FileType.File]
            yield pd.DataFrame(rows, columns=ENTRY_NAMES)

    tasks = max(names.sparkSession.sparkContext.defaultParallelism, -(-names.count() // FILES_PER_TASK))
    return names.select("full").repartitionByRange(tasks, "full").mapInPandas(asked, ENTRY)


def list_files(
    spark: SparkSession, root: str, filesystem: FileSystemFactory | None = None
) -> DataFrame:
    """``path, full, length, modified`` of every regular, visible file under root.

    Each round lists one level of directories in parallel, so the driver loops
    over the depth of the tree and never sees an entry.  Names leave a task in pages;
    where sizes do not come with them, they are asked for by ranges of names afterwards.
    A directory that cannot be read fails the listing instead of making its documents
    look deleted.
    """
    open_fs, base = _resolve(root, filesystem)

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = open_fs()
        for batch in batches:
            for folder in batch["full"]:
                found = _named(store, folder)
                while rows := list(islice(found, NAMES_PER_PAGE)):
                    yield pd.DataFrame(rows, columns=ENTRY_NAMES)

    folders = spark.createDataFrame([(base,)], "full string")
    levels = []
    while True:
        level = materialize(folders.mapInPandas(entries, ENTRY), "listing")
        levels.append(level.where("NOT is_dir"))
        folders = level.where("is_dir").select("full")
        if folders.isEmpty():
            break
        folders = folders.repartition(spark.sparkContext.defaultParallelism, "full")
    found = reduce(DataFrame.unionByName, levels)
    if isinstance(open_fs(), arrow_fs.LocalFileSystem):
        found = materialize(_with_sizes(found, open_fs), "listing")
    relative = F.substring("full", F.lit(len(base) + 2 if base else 1), F.length("full"))
    return found.select(relative.alias("path"), "full", "length", "modified")


def manifest(listing: DataFrame) -> DataFrame:
    """``path, stamp``: size and modification time stand for the content."""
    return listing.select("path", F.concat_ws(":", "modified", "length").alias("stamp"))


def read_files(
    listing: DataFrame, root: str, filesystem: FileSystemFactory | None = None
) -> DataFrame:
    """Bytes of the listed files: ``path, length, modified, content, failure``."""
    open_fs, _ = _resolve(root, filesystem)

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = open_fs()
        for batch in batches:
            rows, held = [], 0
            for row in batch.itertuples(index=False):
                content, failure = None, None
                try:
                    with store.open_input_stream(row.full) as stream:
                        content = stream.readall()
                    after = store.get_file_info(row.full)
                    if (after.mtime_ns or 0) != row.modified or after.size != row.length:
                        failure = "size or time changed during the read"
                except OSError as error:
                    failure = f"unreadable: {error}"
                rows.append((row.path, row.length, row.modified, content, failure))
                held += len(content or b"")
                if held >= READ_BYTES_PER_BATCH:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    names = ["path", "length", "modified", "content", "failure"]
    total = listing.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(listing.sparkSession.sparkContext.defaultParallelism, total // READ_BYTES_PER_TASK)
    return listing.repartition(int(tasks)).mapInPandas(
        contents, "path string, length long, modified long, content binary, failure string"
    )


def decode(raw: DataFrame) -> DataFrame:
    """Add ``text`` and ``reason``; a file with a reason has no text.

    Accepts UTF-8 with or without a byte order mark.  CRLF and lone CR become LF.
    One NUL or one invalid byte refuses the whole file.
    """
    marked = F.hex(F.substring("content", 1, 3)) == BOM
    body = F.when(marked, F.expr("substring(content, 4)")).otherwise(F.col("content"))
    text = F.try_validate_utf8(body.cast("string"))
    reason = (
        F.when(F.col("failure").isNotNull(), F.col("failure"))
        .when(F.col("decoded").isNull(), "not valid UTF-8")
        .when(F.contains("decoded", F.lit("\x00")), "holds a NUL byte")
    )
    unified = F.regexp_replace("decoded", "\r\n?", "\n")
    return (
        raw.withColumn("decoded", text)
        .withColumn("reason", reason)
        .withColumn("text", F.when(F.col("reason").isNull(), unified))
        .drop("decoded", "content", "failure")
    )


class FileSource:
    """A directory tree as the source of an index."""

    def __init__(
        self, spark: SparkSession, root: str, filesystem: FileSystemFactory | None = None
    ):
        self.identity = f"files {root.rstrip('/')}"
        self._spark, self._root, self._filesystem = spark, root, filesystem

    def listing(self) -> DataFrame:
        """The files there are now."""
        return list_files(self._spark, self._root, self._filesystem)

    def manifest(self, listing: DataFrame) -> DataFrame:
        return manifest(listing)

    def read(self, listing: DataFrame, paths: DataFrame | None) -> DataFrame:
        """``path, stamp, text, source, reason`` of all listed files or the named ones."""
        if paths is not None:
            listing = listing.join(paths, "path", "left_semi")
        stamped = decode(read_files(listing, self._root, self._filesystem))
        return stamped.select(
            "path",
            F.concat_ws(":", "modified", "length").alias("stamp"),
            "text",
            F.lit(None).cast("string").alias("source"),
            "reason",
        )
