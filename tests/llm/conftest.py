from __future__ import annotations

import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """The smallest documents, with a null, an empty, a blank and a repeated row."""
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame(
        [(900_001, None), (900_002, ""), (900_003, " \n\t"), (900_004, "one"), (None, "no id at all")],
        "doc_id long, text string",
    )
    return rows.union(odd).union(rows.where("doc_id = 3")).cache()


@pytest.fixture
def nothing(docs):
    return docs.where("false")


@pytest.fixture
def clashing(docs):
    """Extra columns whose names operators may want for themselves."""
    names = ("verdict", "hits", "row", "found", "key", "id", "host", "ranked", "kept_id", "TEXT2")
    return docs.withColumns({name: F.lit(name) for name in names})


def rows_of(frame):
    return sorted(map(repr, frame.collect()))
